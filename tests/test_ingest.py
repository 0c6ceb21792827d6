"""Uploads that fail leave nothing, replaced pages go first, and a batch that comes again counts once."""

from pyspark.sql import functions as F

from plumage.operators import scene as sc
from plumage.sources import ingest

FILES = "project long, name string, hash string, width int, height int, replace boolean"


def scene(spark):
    rows = [
        (1, None, None, None, None, {"name": "p"}), (1, "A", None, 0, None, {"width": "100", "height": "50"}), (1, "B", None, 1, None, {}),
        (1, "A", "m", 0, "mask", {"role": "segment", "blob": "old"}), (1, "A", "t", 1, "text", {"text": "x"}), (1, "B", "b", 0, "mask", {"role": "bubble", "blob": "bb"}),
    ]
    return spark.createDataFrame(rows, sc.SCENE)


def rows(after):
    return {(r.page, r.node): (r.place, dict(r.fields or {})) for r in after.where("page is not null").collect()}


def test_import_in_natural_order_with_replace(spark):
    files = spark.createDataFrame([(1, f"page {n}.png", f"h{n}", 10 + n, 20, False) for n in (10, 9, 1)] + [(2, "x", "h", 1, 1, True)], FILES)
    ops, after = sc.applied(scene(spark), ingest.import_pages(files, scene(spark)))
    got = rows(after)
    assert {p: got[p, None][0] for p, n in got if n is None} == {"A": 0, "B": 1, "h1-2": 2, "h9-3": 3, "h10-4": 4, "h-0": 0}
    assert got["h9-3", "source"][1] == {"role": "source", "blob": "h9", "width": "19", "height": "20"} and not ops.where("error is not null").count()
    again = files.withColumn("replace", F.col("hash") == "h9")
    ops, after = sc.applied(scene(spark), ingest.import_pages(again, scene(spark)))
    assert {p: v[0] for (p, n), v in rows(after).items() if n is None and p != "h-0"} == {"h1-0": 0, "h9-1": 1, "h10-2": 2}
    _, back = sc.applied(after, sc.inverted(ops))
    assert rows(back) == rows(scene(spark))


def test_masks_with_a_step_that_sees_them(spark):
    uploads = spark.createDataFrame([(1, 5, "A", "segment", "new"), (1, 6, "B", "brushInpaint", "brush"), (1, 7, "none", "segment", "z"), (1, 8, "B", "segment", "fails")], "project long, seq long, page string, role string, blob string")
    seen = []

    def step(masks):
        seen.extend((r.seq, r.page, r.role, r.blob) for r in masks.collect())
        made = masks.groupBy("project", "seq", "page").agg(F.concat_ws("+", F.array_sort(F.collect_list("blob"))).alias("b"))
        return ingest.operations(made, project=F.col("project"), seq=F.col("seq") * 1000 + 1, batch=F.col("seq"), op=F.when(F.col("seq") == 8, "failed").otherwise("add_node"), page=F.col("page"), node=F.lit("made"), place=F.lit(0), kind=F.lit("image"), fields=F.create_map(F.lit("blob"), F.col("b")))

    ops, after = sc.applied(scene(spark), ingest.upload_masks(uploads, scene(spark), step))
    assert sorted(seen) == [(5, "A", "segment", "new"), (6, "B", "brushInpaint", "brush"), (6, "B", "bubble", "bb"), (7, "none", "segment", "z"), (8, "B", "bubble", "bb"), (8, "B", "segment", "fails")]
    got = rows(after)
    assert got["A", "m"] == (1, {"role": "segment", "blob": "new"}) and got["A", "made"] == (0, {"blob": "new"})
    assert got["B", "mask-brushInpaint"] == (2, {"role": "brushInpaint", "blob": "brush", "visible": "true"}) and got["B", "made"][1] == {"blob": "bb+brush"}
    assert ("B", "mask-segment") not in got
    assert {(r.seq, r.error) for r in ops.where("error is not null").collect()} == {(7000, "page not found"), (7001, "batch failed"), (8000, "batch failed"), (8001, "unknown operation")}
    _, plain = sc.applied(scene(spark), ingest.upload_masks(uploads.where("seq = 8"), scene(spark)))
    assert rows(plain)["B", "mask-segment"][1]["visible"] == "false"


def test_image_layers_in_the_middle(spark):
    up = spark.createDataFrame([(1, 3, "A", "logo.png", "h", 40, 10), (1, 4, "A", None, "i", 41, 11), (1, 5, "B", "n", "j", 4, 4)], "project long, seq long, page string, name string, hash string, width int, height int")
    got = rows(sc.applied(scene(spark), ingest.add_image_layers(up, scene(spark)))[1])
    one, two, three = got["A", "layer-3"], got["A", "layer-4"], got["B", "layer-5"]
    assert (one[0], one[1]["x"], one[1]["y"], one[1]["name"]) == (2, "30", "20", "logo.png")
    assert (two[0], two[1]["name"]) == (3, "layer.png") and (three[1]["x"], three[1]["y"]) == ("0", "0")


def test_a_batch_that_comes_again_counts_once(spark, tmp_path):
    root, schema = f"{tmp_path}/log", "epoch bigint, v int"
    rows_ = [[(1, 10), (2, 20)], [(3, 30)], [(4, 40), (5, 50)]]
    for k, r in enumerate(rows_):
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    writer = ingest.log_stream(stream, root).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True)
    q = writer.start()
    q.awaitTermination(120)
    assert q.exception() is None
    before = sorted(map(tuple, ingest.read_batches(spark, root, schema).collect()))
    assert sorted((e, v) for e, v, _ in before) == [x for r in rows_ for x in r] and len({b for _, _, b in before}) == 3
    b = before[0][2]
    ingest.append_once(spark.createDataFrame([(e, v) for e, v, k in before if k == b], schema), b, root)  # as after a failure
    assert sorted(map(tuple, ingest.read_batches(spark, root, schema).collect())) == before

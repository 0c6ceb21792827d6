"""Files, masks and image layers as operations on scenes, and logs that a stream appends to once.

Operations are rows of operators.scene.LOG. An upload is one batch: what it changes and what a step makes of it stand or fall
together, the step having seen the change before anything was committed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.functions.text import natural_key
from plumage.operators.scene import FIELDS, ITEMS, LOG

def _blank() -> dict[str, Column]:
    return {n: F.lit(None).cast(t) for n, t in (c.split(" ", 1) for c in LOG.split(", "))}


def operations(rows: DataFrame, **columns: Column) -> DataFrame:
    """Log rows from the columns given; the others are null."""
    return rows.select(*[v.alias(n) for n, v in (_blank() | columns).items()])


def _fields(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))]).cast(FIELDS)


def import_pages(files: DataFrame, scene: DataFrame, batch: int = 0) -> DataFrame:
    """The log that adds files (project, name, hash, width, height, replace) as pages, in natural order of their names, after a project's own.

    Where any of a project's files says ``replace``, its pages go first, as a batch of their own (``batch``; the files are the next), and
    places start at 0. Each page has its file as the source image. A page's name is its file's; its id the file's hash and place.
    """
    own = scene.where("page is not null and node is null").select("project", F.col("page").alias("_page"), F.col("place").alias("_place"))
    fresh = files.groupBy("project").agg(F.max("replace").alias("_replace"))
    gone = own.join(fresh.where("_replace"), "project")
    clear = operations(gone, project=F.col("project"), seq=F.col("_place").cast("long"), batch=F.lit(batch).cast("long"), op=F.lit("remove_page"), page=F.col("_page"))
    start = own.groupBy("project").agg(F.count("*").alias("_pages"))
    order = Window.partitionBy("project").orderBy(natural_key(F.col("name")), "name", "hash")
    f = files.withColumn("_k", F.row_number().over(order) - 1).join(start, "project", "left").join(fresh, "project")
    place = F.col("_k") + F.when(F.col("_replace"), 0).otherwise(F.coalesce("_pages", F.lit(0)))
    image = F.struct(F.lit("source").alias("node"), F.lit("image").alias("kind"), _fields(role=F.lit("source"), blob=F.col("hash"), width=F.col("width"), height=F.col("height")).alias("fields"))
    adds = operations(
        f, project=F.col("project"), seq=F.col("_k").cast("long") + (1 << 32), batch=F.lit(batch + 1).cast("long"), op=F.lit("add_page"), page=F.concat_ws("-", "hash", place), place=place.cast("int"),
        fields=_fields(name=F.col("name"), width=F.col("width"), height=F.col("height")), items=F.array(image).cast(ITEMS),
    )
    return clear.unionAll(adds)


def _sizes(scene: DataFrame) -> DataFrame:
    return scene.where("node is not null").groupBy("project", "page").agg(F.count("*").cast("int").alias("_nodes"))


def upload_masks(uploads: DataFrame, scene: DataFrame, step: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The log that puts masks (project, seq, page, role, blob) on their pages; each is a batch by its ``seq``.

    A page's first mask of the role gets the new content; where it has none, one is added last, shown only if it is a brush's. ``step``
    is given what it would see if the uploads were committed, (project, seq, page, role, blob: every mask of the page, uploads laid over
    the scene), and its operations join their upload's batch. It reads the scene, never writes it.
    """
    masks = scene.where("kind = 'mask'").select("project", "page", F.col("fields")["role"].alias("role"), "node", "place", F.col("fields")["blob"].alias("_blob"))
    first = masks.groupBy("project", "page", "role").agg(F.min_by("node", "place").alias("_node"), F.min_by("_blob", "place").alias("_blob"))
    u = uploads.join(first.drop("_blob"), ["project", "page", "role"], "left").join(_sizes(scene), ["project", "page"], "left")
    there = F.col("_node").isNotNull()
    node = F.coalesce("_node", F.concat(F.lit("mask-"), "role"))
    fields = F.when(there, _fields(blob=F.col("blob"))).otherwise(_fields(role=F.col("role"), blob=F.col("blob"), visible=F.col("role") == "brushInpaint"))
    puts = operations(
        u, project=F.col("project"), seq=F.col("seq") * 1000, batch=F.col("seq"), op=F.when(there, "update_node").otherwise("add_node"), page=F.col("page"), node=node,
        place=F.when(~there, F.coalesce("_nodes", F.lit(0))), kind=F.lit("mask"), fields=fields,
    )
    if step is None:
        return puts
    asked = uploads.select("project", "seq", "page", F.col("role").alias("_role"), F.col("blob").alias("_new"))
    seen = asked.join(first.select("project", "page", "role", "_blob"), ["project", "page"]).where("role <> _role").select("project", "seq", "page", "role", F.col("_blob").alias("blob"))
    return puts.unionByName(step(seen.unionByName(uploads.select("project", "seq", "page", "role", "blob"))))


def add_image_layers(uploads: DataFrame, scene: DataFrame) -> DataFrame:
    """The log that adds pictures (project, seq, page, name, hash, width, height) as a page's last nodes, in its middle, each a batch."""
    pages = scene.where("page is not null and node is null").select("project", "page", F.col("fields")["width"].cast("double").alias("_w"), F.col("fields")["height"].cast("double").alias("_h"))
    u = uploads.join(pages, ["project", "page"], "left").join(_sizes(scene), ["project", "page"], "left")
    earlier = F.row_number().over(Window.partitionBy("project", "page").orderBy("seq")) - 1
    middle = lambda side, own: F.round(F.coalesce((F.col(side) - F.col(own)) * 0.5, F.lit(0.0))).cast("long")
    fields = _fields(role=F.lit("custom"), blob=F.col("hash"), name=F.coalesce("name", F.lit("layer.png")), x=middle("_w", "width"), y=middle("_h", "height"), width=F.col("width"), height=F.col("height"), opacity=F.lit("1.0"))
    return operations(
        u, project=F.col("project"), seq=F.col("seq") * 1000, batch=F.col("seq"), op=F.lit("add_node"), page=F.col("page"), node=F.concat_ws("-", F.lit("layer"), "seq"),
        place=(F.coalesce("_nodes", F.lit(0)) + earlier).cast("int"), kind=F.lit("image"), fields=fields,
    )


def append_once(changes: DataFrame, batch: int, root: str) -> None:
    """Appends a numbered batch to the log under ``root``. A batch that comes again takes the place of what it wrote before."""
    changes.write.mode("overwrite").parquet(f"{root}/batches/batch={batch}")


def log_stream(changes: DataFrame, root: str):
    """A writer that appends each micro-batch of the stream under its number, so that one run again after a failure counts once."""
    return changes.writeStream.foreachBatch(lambda df, batch: append_once(df, batch, root))


def read_batches(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The log, with its batches' numbers. A batch whose writing was cut short has left no file that counts."""
    return spark.read.schema(f"{schema}, batch bigint").parquet(f"{root}/batches")

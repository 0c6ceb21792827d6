"""Registered queries on aggregations, rasters, lookups, the step registry and stores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import text as t
from plumage.operators import aggregate as a
from plumage.operators import masks as m
from plumage.operators import nodes
from plumage.operators import raster as r
from plumage.plans import registry
from plumage.sources import store
from plumage.sources.fixtures import BOXES_SQL, boxes, table

#: Pixels of 32 x 32 pages, from boxes: one row a place, the largest value counts. The boxes of 64 pages share one, so it has many.
PAGE = "cast(floor(page_id / 64) as bigint)"
PIXELS = f"select {PAGE} as page, x1 % 32 as x, y1 % 32 as y, max(score % 256) as v from boxes group by all"
PIXELS_SQL = f"{BOXES_SQL}, px as ({PIXELS})"
#: Coloured, labelled pixels.
COLOURS = [f"{PAGE} as page", "cast(box_id % 4 as int) as label", "box_id % 3 = 0 as masked", "200 + x1 % 12 as r", "190 + y1 % 8 as g", "180 + score % cast(5 + page_id % 5 * 9 as int) as b"]

#: Steps with what they need and produce.
STEPS = [
    ("anime-text", "", "TextBoxes"), ("comic-text-bubble-detector", "", "TextBoxes"), ("comic-text-detector", "", "TextBoxes,SegmentMask"),
    ("comic-text-detector-seg", "TextBoxes", "SegmentMask"), ("pp-doclayout-v3", "", "TextBoxes"), ("speech-bubble-segmentation", "", "BubbleMask"),
    ("yuzumarker-font-detection", "TextBoxes", "FontPredictions"), ("manga-ocr", "TextBoxes", "OcrText"), ("mit48px-ocr", "TextBoxes", "OcrText"),
    ("paddle-ocr-vl-1.6", "TextBoxes", "OcrText"), ("llm", "OcrText", "Translations"), ("aot-inpainting", "SegmentMask,BubbleMask", "Inpainted"),
    ("lama-manga", "SegmentMask,BubbleMask", "Inpainted"), ("flux2-klein", "SegmentMask,BubbleMask", "Inpainted"),
    ("renderer", "Inpainted,Translations,FontPredictions", "FinalRender,RenderedSprites"),
]


def pixels(s, d):
    return boxes(s, d).selectExpr(f"{PAGE} as page", "x1 % 32 as x", "y1 % 32 as y", "score % 256 as v").groupBy("page", "x", "y").agg(F.max("v").alias("v"))


def above(s, d, least):
    """The places of ``pixels`` whose value is above ``least``, as often as a box's value is there."""
    return boxes(s, d).where(f"score % 256 > {least}").selectExpr(f"{PAGE} as page", "x1 % 32 as x", "y1 % 32 as y")


def tiles(s, d):
    return boxes(s, d).selectExpr(f"{PAGE} as page", "x1 % 20 as x1", "y1 % 20 as y1", "x1 % 20 + 6 as x2", "y1 % 20 + 4 as y2")


TILES = f"tl as (select {PAGE} as page, x1 % 20 as x1, y1 % 20 as y1, x1 % 20 + 6 as x2, y1 % 20 + 4 as y2 from boxes)"


def lines(s, d):
    return boxes(s, d).select("page_id", F.col("label").alias("block"), F.col("box_id").alias("ord"), F.concat("label", F.col("x1").cast("string")).alias("text"), F.col("score"), (F.col("x1") % 256).alias("red"), (F.col("y1") % 256).alias("green"))


def _block_aggregate(s, d):
    found = a.block_text(lines(s, d), ["page_id", "block"], "ord", "text", "score", ["red", "green"])
    wanted = boxes(s, d).select("page_id").distinct().withColumn("block", F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))))
    return a.with_all_blocks(wanted, found, ["page_id", "block"], {"text": "", "score": 0.0, "red": 0, "green": 0}).withColumn("score", F.round("score", 6))


def _softmax(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    top = e.select("vec_id", F.posexplode(a.top_indices(a.softmax(F.col("embedding")), 3)).alias("rank", "t"))
    return top.select("vec_id", "rank", F.col("t.index").alias("index"), F.round("t.value", 6).alias("p"))


def _sampling(s, d):
    logits = table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("token", "logit")).withColumn("logit", F.round(F.col("logit").cast("double") * 8, 2))
    out = a.sampling_filter(logits, ["vec_id"], "token", "logit", top_k=20, top_p=0.9, min_p=0.05)
    return out.groupBy("vec_id").agg(F.count("*").alias("kept"), F.max("rank").alias("last_rank"))


def _median(s, d):
    m = a.median_and_deviation(boxes(s, d), ["label"], "score")
    return m.select("label", "median", F.round("deviation", 4).alias("deviation"))


def _three_std(s, d):
    mean = (F.col("x1") + F.col("y1") + F.col("score")) / 3
    return boxes(s, d).select("page_id", "box_id", F.round(F.sqrt((F.pow(F.col("x1") - mean, 2) + F.pow(F.col("y1") - mean, 2) + F.pow(F.col("score") - mean, 2)) / 3), 4).alias("std"))


def _spans(s, d):
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("total"), F.max(F.col("l_quantity").cast("long")).alias("most"))
    both = li.select("l_orderkey", F.lit(None).cast("string").alias("parent"), F.col("total").alias("ms")).unionAll(li.select("l_orderkey", F.lit("root"), "most"))
    return a.span_shares(both, "l_orderkey", "parent", "ms").select("l_orderkey", F.coalesce("parent", F.lit("")).alias("parent"), "percent")


def _zip(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey")
    b = table(s, d, "events").select(F.col("user_id").alias("k"), "event_id")
    return a.zip_by_position(o, b, "k", "o_orderkey", "event_id").select("k", "o_orderkey", "event_id")


def _labels_of_scores(s, d):
    names = F.broadcast(table(s, d, "nation").select(F.col("n_nationkey").alias("idx"), "n_name"))  # 25 rows
    e = table(s, d, "embeddings").select("vec_id", F.explode(a.top_indices(F.col("embedding"), 2)).alias("t"))
    return e.select("vec_id", F.col("t.index").alias("idx")).join(names, "idx")


def _merge_catalogue(s, d):
    n, c = table(s, d, "nation"), table(s, d, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.max("s_acctbal").alias("best"))
    j = n.join(c, n["n_nationkey"] == c["s_nationkey"], "left")
    return j.select("n_name", F.when(F.col("n").isNull(), "missing").when(F.col("best") < 9000, "needs_key").otherwise("ready").alias("status"))


def _roles(s, d):
    c = table(s, d, "conversations").groupBy("conv_id").pivot("role", ["system", "user", "assistant"]).agg(F.min("turn"))
    return c.select("conv_id", *[F.coalesce(x, F.lit(-1)).alias(x) for x in ("system", "user", "assistant")])


def _readiness(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("role").alias("kind"), (F.length("text") > 100).alias("done"))
    return registry.readiness(c.where("kind <> 'system'"))


def _exact(s, d):
    blobs = table(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.coalesce("text", F.lit("")).alias("content"))
    return store.put(None, blobs).select("hash", F.length("content").alias("n"))


def _store_new(s, d):
    blobs = table(s, d, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.col("text").alias("content"), "doc_id")
    return store.put(blobs.where("doc_id % 2 = 0").select("hash", "content"), blobs.where("doc_id % 2 = 1")).select("hash")


def _engine_names(s, d):
    known = s.createDataFrame([(i,) for i, _, _ in STEPS], "id string")
    wanted = table(s, d, "part").select("p_partkey", F.get(F.array(F.lit("llm"), F.lit("nope"), F.lit("manga-ocr")), (F.col("p_partkey") % 3).cast("int")).alias("name"))
    return registry.validated(wanted, F.broadcast(known), "lama-manga")  # fifteen rows


def _colour_rules(s, d):
    b = boxes(s, d)
    style = a.first_set((F.col("box_id") % 4 == 0, F.lit(None).cast("string")), (F.col("box_id") % 4 == 1, F.lit("block")), (F.col("score") > 500, F.lit("global")), (F.lit(True), F.lit("default")))
    return b.select("page_id", "box_id", a.contrast(F.col("x1") % 256, F.col("y1") % 256, F.col("score") % 256).alias("ink"), F.coalesce(style, F.lit("off")).alias("stroke"), a.to_byte(F.col("score") / 1000).alias("byte"))


def _weighted(s, d):
    b = boxes(s, d).select("page_id", (F.col("x1") % 256).alias("fg"), (F.col("y1") % 256).alias("bg"), (F.col("box_id") % 2 == 0).alias("hf"), (F.col("box_id") % 3 == 0).alias("hb"))
    return a.weighted_colour(b, ["page_id"], "fg", "bg", "hf", "hb")


def _thumbs(s, d):
    w, h = store.thumbnail_size(F.col("x2"), F.col("y2") * 2)
    return boxes(s, d).select("page_id", "box_id", w.alias("w"), h.alias("h"))


def _packbits(s, d):
    """A page's rows of pixels, packed and unpacked again."""
    row = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda x: F.lpad(F.hex(F.coalesce(F.element_at("px", x), F.lit(0))), 2, "0")), "")
    rows = pixels(s, d).groupBy("page", "y").agg(F.map_from_entries(F.collect_list(F.struct("x", (F.col("v") % 3).alias("v")))).alias("px")).select("page", "y", F.unhex(row).alias("raw"))  # 32 places at most
    packed = rows.withColumn("packed", r.packed_rows("raw"))
    return packed.select("page", "y", F.hex("raw").alias("raw"), F.length("packed").alias("n"), F.hex(r.unpacked_rows("packed")).alias("back"))


def mask_labels(s, d):
    """The labels of a mask that is to be grown, as rectangles of 8 x 16 places: 0 to 5, 0 being none; right of 24 there are none."""
    pages = boxes(s, d).selectExpr(f"{PAGE} as page").distinct()
    rects = pages.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
    return rects.selectExpr("page", "8 * i as x1", "16 * j as y1", "8 * i + 8 as x2", "16 * j + 16 as y2", "i + 3 * j as v")


def _expanded(s, d):
    blocks = boxes(s, d).selectExpr(f"{PAGE} as page", "page_id * 100 + box_id as area", "x1 % 10 as x1", "y1 % 27 as y1", "x1 % 10 + 5 as x2", "y1 % 27 + 3 as y2", "1 + cast(score % 2 as int) as r")
    return m.expanded(above(s, d, 200), blocks, mask_labels(s, d), 32, 32, 0.4, 1, 3)


def _ring_alpha(s, d):
    mask, alpha = pixels(s, d).where("v > 240"), pixels(s, d).select("page", "x", "y", (F.col("v") % 200).alias("alpha"))
    around = alpha.join(m.ring(mask, 2, 32, 32), ["page", "x", "y"])
    return nodes.alpha_restored(alpha.join(mask.select("page", "x", "y"), ["page", "x", "y"]), around)


def _filled(s, d):
    px = boxes(s, d).selectExpr(*COLOURS, "page_id", "box_id as y")
    out = m.filled(px.withColumn("x", F.col("page_id")), r.bubble_fill(px))
    return out.select("page_id", F.col("y").alias("box_id"), "masked", *[F.col(c).cast("int").alias(c) for c in "rgb"])


QUERIES = {
    "block_aggregate": _block_aggregate,
    "block_weighted_colour": _weighted,
    "label_color_median_deviation": _median,
    "channel_std": _three_std,
    "label_integer_median": lambda s, d: boxes(s, d).groupBy("label").agg(a.integer_median("x1").alias("median")),
    "embedding_softmax_topk": _softmax,
    "logit_sampling_filter": _sampling,
    "shape_groups": lambda s, d: a.shape_groups(boxes(s, d).selectExpr("x2 - x1 as w", "y2 - y1 as h"), "w", "h", 14, 2),
    "span_shares": _spans,
    "zip_by_position": _zip,
    "label_lookup": _labels_of_scores,
    "catalogue_status": _merge_catalogue,
    "role_pivot": _roles,
    "colour_rules": _colour_rules,
    "exact_dedupe_by_hash": _exact,
    "store_new_blobs": _store_new,
    "download_ranges": lambda s, d: store.download_ranges(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("long").alias("total")), 50_000),
    "thumbnail_size": _thumbs,
    "listing_newest": lambda s, d: store.newest(table(s, d, "nation").select("n_name", (F.col("n_regionkey")).alias("mtime")), "n_name", "mtime"),
    "scene_json": lambda s, d: store.as_json(table(s, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")), "k", "name"),
    "engine_name_default": _engine_names,
    "artifact_readiness": _readiness,
    "raster_binarize": lambda s, d: r.binarized(pixels(s, d), 127),
    "raster_dilate": lambda s, d: r.dilated(pixels(s, d), 1, 32, 32),
    "raster_close": lambda s, d: r.closed(pixels(s, d), 1, 32, 32).groupBy("page").agg(F.count("*").alias("n"), F.sum("v").alias("v")),
    "raster_refine_mask": lambda s, d: r.refined(pixels(s, d), tiles(s, d), 60, 32, 32).select("page", "x", "y"),
    "raster_combine_area": lambda s, d: r.combined(pixels(s, d), 100),
    "raster_bubble_fill": lambda s, d: r.bubble_fill(boxes(s, d).selectExpr(*COLOURS)),
    "raster_expand_mask": _expanded,
    "raster_ring_alpha": _ring_alpha,
    "raster_bubble_write": _filled,
    "raster_composite": lambda s, d: r.composite(boxes(s, d).selectExpr(f"{PAGE} as page", "x1 % 8 as x", "y1 % 8 as y", "page_id * 100 + box_id as z", "score as v")),
    "raster_collision": lambda s, d: r.collisions(pixels(s, d), pixels(s, d).where("x < 16")),
    "raster_packbits": _packbits,
    "raster_holes": lambda s, d: r.filled_holes(r.dilated(r.binarized(pixels(s, d), 100), 1, 32, 32, diamond=True), 32, 32),
    "raster_safe_rectangle": lambda s, d: r.safe_rectangle(pixels(s, d), 32, 32),
}

_TOPK = "row_number() over (partition by vec_id order by v desc, i)"
_SPREAD = "unnest(range(-1, 2)) a(dx), unnest(range(-1, 2)) b(dy)"



def _grown(pixels: str, areas: str, name: str) -> str:
    """Pixels around areas, dilated and bounded by their label, as common table expressions that end in ``name``."""
    return f"""{name}1 as (select a.*, p.x, p.y, p.x >= x1 and p.x < x2 and p.y >= y1 and p.y < y2 as own from {areas} a join {pixels} p on p.page = a.page and p.x >= x1 - 2 * r and p.x < x2 + 2 * r and p.y >= y1 - 2 * r and p.y < y2 + 2 * r),
{name}2 as (select page, area, label from (select page, area, label, count(*) as n from {name}1 join lab using (page, x, y) where own and label > 0 group by all) qualify row_number() over (partition by page, area order by n desc, label desc) = 1),
{name}3 as (select distinct page, area from {name}1 where own),
{name}4 as (select distinct k.page, k.area, cast(k.x + dx as int) as x, cast(k.y + dy as int) as y, v.label as bound from {name}1 k join {name}3 using (page, area) left join {name}2 v using (page, area), unnest(range(-3, 4)) i(dx), unnest(range(-3, 4)) j(dy)
  where abs(dx) <= r and abs(dy) <= r and k.x + dx >= greatest(x1 - 2 * r, 0) and k.x + dx < least(x2 + 2 * r, 32) and k.y + dy >= greatest(y1 - 2 * r, 0) and k.y + dy < least(y2 + 2 * r, 32)),
{name} as (select distinct t.page, t.x, t.y from {name}4 t left join lab on lab.page = t.page and lab.x = t.x and lab.y = t.y where bound is null or coalesce(lab.label, 0) = bound)"""


ORACLES = {
    "block_aggregate": f"with {BOXES_SQL}, w as (select distinct page_id, unnest(['A', 'N', 'R']) as block from boxes), f as (select page_id, label as block, string_agg(label || x1, '' order by box_id) as text, avg(score) as score, cast(round(avg(x1 % 256)) as int) as red, cast(round(avg(y1 % 256)) as int) as green from boxes group by 1, 2) select page_id, block, coalesce(text, '') as text, round(coalesce(score, 0), 6) as score, coalesce(red, 0) as red, coalesce(green, 0) as green from w left join f using (page_id, block)",
    "block_weighted_colour": f"with {BOXES_SQL} select page_id, cast(coalesce(round(avg(x1 % 256) filter (box_id % 2 = 0)), 0) as int) as fg, cast(coalesce(round(avg(case when box_id % 3 = 0 then y1 % 256 when box_id % 2 = 0 then x1 % 256 end)), 0) as int) as bg from boxes group by 1",
    "label_color_median_deviation": f"with {BOXES_SQL}, m as (select label, median(score) as median from boxes group by 1) select label, median, round(sqrt(avg(pow(score - median, 2))), 4) as deviation from boxes join m using (label) group by 1, 2",
    "channel_std": f"with {BOXES_SQL} select page_id, box_id, round(list_stddev_pop([x1, y1, score]), 4) as std from boxes",
    "label_integer_median": f"with {BOXES_SQL} select label, cast(floor(median(x1)) as int) as median from boxes group by 1",
    "embedding_softmax_topk": f"with e as (select vec_id, unnest(embedding) as v, unnest(range(len(embedding))) as i from embeddings), p as (select vec_id, i, v, exp(cast(v as double) - max(cast(v as double)) over (partition by vec_id)) as x from e), q as (select vec_id, i, v, x / sum(x) over (partition by vec_id) as p, {_TOPK} as k from p) select vec_id, cast(k - 1 as int) as rank, cast(i as int) as index, round(p, 6) as p from q where k <= 3",
    "logit_sampling_filter": f"""with e as (select vec_id, unnest(embedding) as f, unnest(range(len(embedding))) as i from embeddings), l as (select vec_id, i, round(cast(f as double) * 8, 2) as v from e), k as (select *, {_TOPK} as r from l qualify r <= 20),
p as (select *, exp(v - max(v) over w) / (sum(exp(v - (select max(v) from k k2 where k2.vec_id = k.vec_id))) over w) as p from k window w as (partition by vec_id)),
t as (select *, coalesce(sum(p) over (partition by vec_id order by r rows between unbounded preceding and 1 preceding), 0) as a from p), u as (select * from t where a < 0.9), z as (select * from u qualify p >= 0.05 * max(p) over (partition by vec_id))
select vec_id, count(*) as kept, cast(max(r) as int) as last_rank from z group by 1""",
    "shape_groups": f"with {BOXES_SQL} select x2 - x1 as w, y2 - y1 as h, count(*) as n, cast(((y2 - y1) // 14 // 2) * ((x2 - x1) // 14 // 2) as bigint) as tokens from boxes group by all",
    "span_shares": "with o as (select l_orderkey, cast(sum(cast(l_quantity as bigint)) as bigint) as total, max(cast(l_quantity as bigint)) as most from lineitem group by 1) select l_orderkey, '' as parent, round(total * 100 / total, 4) as percent from o union all select l_orderkey, 'root', round(most * 100 / total, 4) from o",
    "zip_by_position": "select a.k, o_orderkey, event_id from (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as r from orders) a join (select user_id as k, event_id, row_number() over (partition by user_id order by event_id) as r from events) b on a.k = b.k and a.r = b.r",
    "label_lookup": f"with e as (select vec_id, unnest(embedding) as v, unnest(range(len(embedding))) as i from embeddings), k as (select * from e qualify {_TOPK} <= 2) select vec_id, cast(i as int) as idx, n_name from k join nation on i = n_nationkey",
    "catalogue_status": "select n_name, case when n is null then 'missing' when best < 9000 then 'needs_key' else 'ready' end as status from nation left join (select s_nationkey, count(*) as n, max(s_acctbal) as best from supplier group by 1) on n_nationkey = s_nationkey",
    "role_pivot": "select conv_id, coalesce(min(turn) filter (role = 'system'), -1) as system, coalesce(min(turn) filter (role = 'user'), -1) as user, coalesce(min(turn) filter (role = 'assistant'), -1) as assistant from conversations group by 1",
    "colour_rules": f"with {BOXES_SQL} select page_id, box_id, case when 0.299 * (x1 % 256) + 0.587 * (y1 % 256) + 0.114 * (score % 256) > 128 then 'black' else 'white' end as ink, case when box_id % 4 = 0 then 'off' when box_id % 4 = 1 then 'block' when score > 500 then 'global' else 'default' end as stroke, cast(round(score / 1000 * 255) as int) as byte from boxes",
    "exact_dedupe_by_hash": "select distinct sha256(coalesce(text, '')) as hash, cast(length(coalesce(text, '')) as int) as n from documents",
    "store_new_blobs": "select distinct sha256(coalesce(text, '')) as hash from documents where doc_id % 2 = 1 and coalesce(text, '') not in (select coalesce(text, '') from documents where doc_id % 2 = 0)",
    "download_ranges": "select id, f * 50000 as first, least(f * 50000 + 49999, total - 1) as last from (select o_orderkey as id, cast(trunc(o_totalprice) as bigint) as total from orders), unnest(range((total - 1) // 50000 + 1)) r(f) where total > 0",
    "thumbnail_size": f"with {BOXES_SQL}, k as (select page_id, box_id, x2, y2 * 2 as y, least(1.0, 320 / cast(greatest(x2, y2 * 2) as double)) as k from boxes) select page_id, box_id, cast(greatest(round(x2 * k), 1) as int) as w, cast(greatest(round(y * k), 1) as int) as h from k",
    "listing_newest": "select n_name, n_regionkey as mtime, row_number() over (order by n_regionkey desc, n_name) as position from nation",
    "scene_json": """select '{"k":' || r_regionkey || ',"name":"' || r_name || '"}' as json from region""",
    "engine_name_default": "select p_partkey, case p_partkey % 3 when 0 then 'llm' when 1 then 'lama-manga' else 'manga-ocr' end as name from part",
    "artifact_readiness": 'select conv_id as page, bool_or(role is not null) as "any", coalesce(bool_and(length(text) > 100), true) as "all" from conversations where role <> \'system\' group by 1',
    "raster_binarize": f"with {PIXELS_SQL} select page, x, y, 255 as v from px where v > 127",
    "raster_dilate": f"with {PIXELS_SQL} select page, x, y, max(v) as v from (select page, cast(x + dx as int) as x, cast(y + dy as int) as y, v from px, {_SPREAD}) where x between 0 and 31 and y between 0 and 31 group by 1, 2, 3",
    "raster_close": f"with {PIXELS_SQL}, g as (select page, x, y, max(v) as v from (select page, x + dx as x, y + dy as y, v from px, {_SPREAD}) where x between 0 and 31 and y between 0 and 31 group by 1, 2, 3), h as (select page, x, y, count(*) as n, min(v) as v from (select page, x + dx as x, y + dy as y, v from g, {_SPREAD} where v > 0) where x between 0 and 31 and y between 0 and 31 group by 1, 2, 3) select page, count(*) as n, cast(sum(v) as bigint) as v from h where n = (least(x + 1, 31) - greatest(x - 1, 0) + 1) * (least(y + 1, 31) - greatest(y - 1, 0) + 1) group by 1",
    "raster_refine_mask": f"with {PIXELS_SQL}, {TILES}, i as (select page, x, y from px where v > 60 and exists (select 1 from tl where tl.page = px.page and x >= x1 and x < x2 and y >= y1 and y < y2)), g as (select distinct page, cast(x + dx as int) as x, cast(y + dy as int) as y from i, unnest(range(-2, 3)) a(dx), unnest(range(-2, 3)) b(dy) where abs(dx) + abs(dy) <= 2) select page, x, y from g where x between 0 and 31 and y between 0 and 31 and exists (select 1 from tl where tl.page = g.page and x >= x1 and x < x2 and y >= y1 and y < y2)",
    "raster_combine_area": f"with {PIXELS_SQL} select page, count(*) filter (v >= 100) as area, max(v) as top from px group by 1",
    "raster_bubble_fill": f"with {BOXES_SQL}, c as (select {', '.join(COLOURS)} from boxes), k as (select * from c where not masked and label > 0), m as (select page, label, median(r) as mr, median(g) as mg, median(b) as mb from k group by all), v as (select page, label, any_value(mr) as mr, any_value(mg) as mg, any_value(mb) as mb, sqrt(avg(pow(r - mr, 2))) as dr, sqrt(avg(pow(g - mg, 2))) as dg, sqrt(avg(pow(b - mb, 2))) as db from k join m using (page, label) group by all) select page, label, cast(floor(mr) as int) as r, cast(floor(mg) as int) as g, cast(floor(mb) as int) as b from v where greatest(dr, dg, db) < case when list_stddev_pop([dr, dg, db]) > 1 then {{rough}} else {{smooth}} end and exists (select 1 from c where masked and c.page = v.page and c.label = v.label)",
    "raster_expand_mask": f"""with recursive {PIXELS_SQL}, base as (select page, x, y from px where v > 200), lab as (select page, cast(x as int) as x, cast(y as int) as y, cast(floor(x / 8) + 3 * floor(y / 16) as int) as label from (select distinct page from px), unnest(range(24)) a(x), unnest(range(32)) b(y)),
bl as (select {PAGE} as page, page_id * 100 + box_id as area, x1 % 10 as x1, y1 % 27 as y1, x1 % 10 + 5 as x2, y1 % 27 + 3 as y2, 1 + score % 2 as r from boxes),
{_grown('base', 'bl', 'g')},
rest as (select * from base where (page, x, y) not in (select (page, x, y) from g)),
e as (select a.page, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from rest a join rest b on a.page = b.page and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
q as (select page, x as sx, y as sy, x, y from rest union select q.page, sx, sy, bx, by_ from q join e on e.page = q.page and e.ax = q.x and e.ay = q.y),
cc as (select page, sx, sy, min(y * 1048576 + x) as area from q group by all),
cb as (select page, area, min(sx) as x1, min(sy) as y1, max(sx) + 1 as x2, max(sy) + 1 as y2, greatest(1, least(3, cast(round(least(max(sx) - min(sx) + 1, max(sy) - min(sy) + 1) * cast(0.4 as double)) as int))) as r from cc group by page, area),
ar as (select page, area, greatest(x1 - r, 0) as x1, greatest(y1 - r, 0) as y1, least(x2 + r, 32) as x2, least(y2 + r, 32) as y2, r from cb),
{_grown('rest', 'ar', 'h')}
select page, x, y from base union select page, x, y from g union select page, x, y from h""",
    "raster_ring_alpha": f"""with {PIXELS_SQL}, k as (select * from px where v > 240), n as (select distinct page, cast(x + dx as int) as x, cast(y + dy as int) as y from k, unnest(range(-2, 3)) a(dx), unnest(range(-2, 3)) b(dy)),
m as (select page, cast(floor(median(v % 200)) as int) as m from px join n using (page, x, y) where v <= 240 group by 1) select page, x, y, cast(case when m < 128 then m else v % 200 end as int) as alpha from k left join m using (page)""",
    "raster_bubble_write": "{write}",
    "raster_composite": f"with {BOXES_SQL} select page, x, y, v from (select {PAGE} as page, x1 % 8 as x, y1 % 8 as y, page_id * 100 + box_id as z, score as v from boxes) qualify row_number() over (partition by page, x, y order by z desc) = 1",
    "raster_collision": f"with {PIXELS_SQL} select page, count(*) as outside from px where v > 8 and not (x < 16 and v > 0) group by 1",
}
ORACLES["raster_bubble_fill"] = ORACLES["raster_bubble_fill"].format(rough="7", smooth="10")
_head, _tail = ORACLES["raster_bubble_fill"].rsplit(" select page, label, cast", 1)
ORACLES["raster_bubble_write"] = f"{_head}, f as (select page, label, cast{_tail}), p as (select {', '.join(COLOURS)}, page_id, box_id from boxes) select page_id, box_id, p.masked and f.label is null as masked, cast(case when p.masked and f.label is not null then f.r else p.r end as int) as r, cast(case when p.masked and f.label is not null then f.g else p.g end as int) as g, cast(case when p.masked and f.label is not null then f.b else p.b end as int) as b from p left join f on f.page = p.page and f.label = p.label"

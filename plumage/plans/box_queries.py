"""Registered queries on boxes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import geometry as g
from plumage.operators import detect, layout
from plumage.sources.fixtures import BOXES_SQL, boxes, spread_boxes

INTER = "greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0)"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
SMALL = f"least({AREA.format('a')}, {AREA.format('b')})"


def sql(body: str, *more: str) -> str:
    return "with " + ", ".join([BOXES_SQL, *more]) + " " + body


def _overlap_summary(spark, d):
    top = detect.top_then_threshold(boxes(spark, d), 3, 300)
    pairs = detect.overlap_pairs(top, 1)
    return pairs.groupBy("a_label", "b_label").agg(F.count("*").alias("pairs"), F.sum("inter").alias("inter"), F.count("larger").alias("contained"))


def _pages(spark, d):
    return boxes(spark, d).groupBy("page_id").agg(F.max("x2").alias("width"), (F.max("y2") * 4).alias("height"))


PAGES = "pages_ as (select page_id, max(x2) as width, max(y2) * 4 as height from boxes group by page_id)"
PLAN = """p1 as (select *, cast(greatest(round(width * 3.0), 1) as int) as tall from pages_),
p2 as (select *, cast(greatest(round(tall * (1 - 0.2)), 1) as int) as step from p1),
p3 as (select *, cast(ceil(height / step) as int) as n from p2),
p4 as (select * replace (case when height / width > 3.5 then greatest(case when n > 1 and (height - (n - 1) * step) / tall <= 0.7 then n - 1 else n end, 1) else 1 end as n) from p3),
plan as (select page_id, cast(s as int) as slice, cast(s * step as int) as y_from, cast(case when s = n - 1 then height else least(s * step + tall, height) end as int) as y_to from p4, unnest(range(n)) as r(s))"""


def _named(spark, d, boxes=boxes):
    return boxes(spark, d).withColumn("name", F.when(F.col("label") == "R", "Text").when(F.col("label") == "A", "doc_title").otherwise("figure"))


def _seeds(spark, d):
    b = boxes(spark, d)
    return detect.seed_majority(b, b.where("box_id <= 3"))


def _gap_x(spark, d):
    return detect.largest_gap(boxes(spark, d), "x1", "x2", 10)


def _center(spark, d):
    b = boxes(spark, d)
    c = g.centre_to_corners(F.col("x1") / 800, F.col("y1") / 1200, F.col("x2") / 1600, F.col("y2") / 2400, F.lit(640), F.lit(960))
    return b.select("page_id", "box_id", *[F.round(x, 6).alias(s) for s, x in c.items()])


def _letterbox(spark, d):
    b = boxes(spark, d)
    inv = lambda c, pad, size: F.round(g.letterbox_inverse(F.col(c), F.lit(pad), F.lit(0.5), F.lit(size)), 4)
    return b.select("page_id", "box_id", inv("x1", 12, 1500).alias("x"), inv("y1", 40, 2000).alias("y"))


def _enlarge(spark, d):
    b = boxes(spark, d)
    return b.select("page_id", "box_id", *[x.cast("int").alias(s) for s, x in g.enlarged(g.box(), F.lit(1010), F.lit(1370), 1.7).items()])


def _confidence(spark, d):
    return boxes(spark, d).groupBy("label").agg(*[F.count_if(F.col("score") >= t).alias(f"n_{t}") for t in (250, 300, 400)])


def _classes(spark, d):
    return detect.class_argmax(boxes(spark, d).selectExpr("page_id", "box_id", "score % 7 as a", "x1 % 7 as b", "y1 % 7 as c"), ["a", "b", "c"])


def _polygon(spark, d):
    return detect.polygon_area_twice(boxes(spark, d).selectExpr("page_id", "box_id as i", "x1 as x", "y1 as y"))


def _distinct_overlap(spark, d):
    p = detect.overlap_pairs(boxes(spark, d), 0).where("inter > 0")
    labels = p.select("page_id", F.explode(F.array("a_label", "b_label")).alias("label"))
    return labels.groupBy("page_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def _touching(spark, d):
    p = detect.page_pairs(boxes(spark, d), g.touching)
    return p.groupBy("page_id").agg(F.count("*").alias("touching"))


def _slice_detections(spark, d):
    b = boxes(spark, d).selectExpr("page_id", "box_id", "0 as slice", "x1", "y1", "x2", "y2").unionAll(boxes(spark, d).selectExpr("page_id", "box_id", "1 as slice", "x1", "y1", "x2", "y2"))
    return detect.slice_union(b, detect.slice_plan(_pages(spark, d)))


def _reflect(spark, d):
    return boxes(spark, d).select("page_id", "box_id", g.reflected(F.col("y2") * 3 - 900, F.col("x1") % 50 + 1).cast("int").alias("i"))


def _sorted_variants(spark, d):
    b = spread_boxes(spark, d)
    rank = lambda *o: F.row_number().over(detect.by_page(*o, "box_id"))
    return b.select("page_id", "box_id", rank(F.col("y1") + F.col("y2")).alias("by_centre_y"), rank(F.desc("score")).alias("by_score"), rank(F.desc(g.area(g.box()))).alias("by_area"))


def _detector(spark, d):
    """A detector's steps in one plan: confidence, suppression by label, the regions that are text, merging, reading order."""
    b = detect.nms(detect.at_least(_named(spark, d, spread_boxes).withColumn("label", F.col("name")), 250).where("page_id is not null"), 35)
    regions = detect.text_regions(b, keep=("score",)).selectExpr("page_id", "box_id", "score", "x as x1", "y as y1", "x + w as x2", "y + h as y2")
    return layout.merged_in_order(regions)


QUERIES = {
    "detector_pipeline": _detector,
    "box_overlap_summary": _overlap_summary,
    "box_topk_per_page": lambda s, d: detect.top_then_threshold(boxes(s, d), 3, 500).select("page_id", "box_id", "score", "rank"),
    "box_rank_renumber": lambda s, d: detect.renumbered(boxes(s, d), 400).select("page_id", "box_id", "position"),
    "box_overlap_pairs": lambda s, d: detect.overlap_pairs(boxes(s, d), 10).drop("a_label", "b_label"),
    "box_mostly_contained": lambda s, d: detect.mostly_contained_pairs(boxes(s, d), 30),
    "box_touching": _touching,
    "box_clamp_min_size": lambda s, d: detect.clamp_and_drop(boxes(s, d), 600, 900, 5),
    "box_label_area_filter": lambda s, d: detect.text_regions(_named(s, d), "name"),
    "box_positive_extent": lambda s, d: boxes(s, d).where("x2 - x1 > 1 and y2 - y1 > 1").groupBy("label").agg(F.count("*").alias("n")),
    "box_confidence": _confidence,
    "box_center_to_corner": _center,
    "box_letterbox_inverse": _letterbox,
    "box_enlarge_window": _enlarge,
    "box_reflect_index": _reflect,
    "box_class_argmax": _classes,
    "box_order_votes": lambda s, d: detect.order_votes(spread_boxes(s, d), 40.0),
    "box_largest_gap": lambda s, d: detect.largest_gap(boxes(s, d), "y1", "y2", 8),
    "box_largest_gap_x": _gap_x,
    "box_row_band_order": lambda s, d: detect.row_band_order(boxes(s, d), 100),
    "box_upper_median_size": lambda s, d: detect.size_medians(boxes(s, d)),
    "box_label_extent": lambda s, d: detect.label_extents(boxes(s, d)),
    "box_label_majority": lambda s, d: detect.majority_label(boxes(s, d), "page_id"),
    "box_seed_majority": _seeds,
    "box_area_rank_labels": lambda s, d: detect.labels_by_area(boxes(s, d), 4),
    "box_distinct_overlap_labels": _distinct_overlap,
    "box_slice_plan": lambda s, d: detect.slice_plan(_pages(s, d)),
    "box_slice_union": _slice_detections,
    "box_polygon_area": _polygon,
    "box_unshared_label": lambda s, d: detect.unshared(boxes(s, d)),
    "box_sort_variants": _sorted_variants,
    "box_nms": lambda s, d: detect.nms(boxes(s, d), 35),
    "box_dedupe": lambda s, d: detect.keep_first(boxes(s, d)),
    "box_reading_order_rtl": lambda s, d: layout.in_reading_order(spread_boxes(s, d), True),
    "box_reading_order_ltr": lambda s, d: layout.in_reading_order(spread_boxes(s, d), False),
    "box_window_union": lambda s, d: layout.window_union(boxes(s, d)),
    "box_merge_regions": lambda s, d: layout.merge_regions(boxes(s, d)),
    "box_merge_slices": lambda s, d: layout.merge_slices(boxes(s, d), 1400),
}

_TOP = "row_number() over (partition by page_id order by score desc, box_id)"
_PAIRS = f"pairs as (select a.page_id, a.box_id as a_id, b.box_id as b_id, a.label as a_label, b.label as b_label, {INTER} as inter, {AREA.format('a')} + {AREA.format('b')} - {INTER} as uni, case when {INTER} * 100 >= 85 * {SMALL} and {SMALL} > 0 then case when {AREA.format('a')} >= {AREA.format('b')} then 'first' else 'second' end end as larger from {{0}} a join {{0}} b on a.page_id = b.page_id and a.box_id < b.box_id)"


def _gap(low: str, high: str, least: int) -> str:
    return sql(
        f"""select page_id, reach as gap_from, {low} as gap_to from (select page_id, box_id, {low}, max({high}) over (partition by page_id order by {low}, box_id rows between unbounded preceding and 1 preceding) as reach from boxes)
where {low} - reach >= {least} qualify row_number() over (partition by page_id order by {low} - reach desc, reach) = 1"""
    )


ORACLES = {
    "box_overlap_summary": sql("select a_label, b_label, count(*) as pairs, cast(sum(inter) as bigint) as inter, count(larger) as contained from pairs where inter * 100 >= uni * 1 group by all", f"t as (select * from (select *, {_TOP} as r from boxes) where r <= 3 and score >= 300)", _PAIRS.format("t")),
    "box_topk_per_page": sql(f"select page_id, box_id, score, rank from (select *, cast({_TOP} as int) as rank from boxes) where rank <= 3 and score >= 500"),
    "box_rank_renumber": sql("select page_id, box_id, cast(row_number() over (partition by page_id order by box_id) - 1 as int) as position from boxes where score >= 400"),
    "box_overlap_pairs": sql("select page_id, a_id, b_id, cast(inter as bigint) as inter, cast(uni as bigint) as uni, larger from pairs where inter * 100 >= uni * 10", _PAIRS.format("boxes")),
    "box_mostly_contained": sql(f"select a.page_id, a.box_id as outer_id, b.box_id as inner_id from boxes a join boxes b on a.page_id = b.page_id and a.box_id <> b.box_id where {AREA.format('b')} > 0 and {AREA.format('a')} >= {AREA.format('b')} and {INTER} * 100 >= {AREA.format('b')} * 30"),
    "box_touching": sql("select a.page_id, count(*) as touching from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id and a.x1 <= b.x2 and b.x1 <= a.x2 and a.y1 <= b.y2 and b.y1 <= a.y2 group by 1"),
    "box_clamp_min_size": sql("select * from (select page_id, box_id, least(x1, 600) as x1, least(y1, 900) as y1, least(x2, 600) as x2, least(y2, 900) as y2 from boxes) where x2 - x1 > 5 and y2 - y1 > 5"),
    "box_label_area_filter": sql("select page_id, box_id, x1 as x, y1 as y, x2 - x1 as w, y2 - y1 as h, case when y2 - y1 >= (x2 - x1) * cast(1.15 as double) then 'vertical' else 'horizontal' end as direction from boxes where label in ('R', 'A') and x2 - x1 >= 6 and y2 - y1 >= 6 and (x2 - x1) * (y2 - y1) >= 48"),
    "box_positive_extent": sql("select label, count(*) as n from boxes where x2 - x1 > 1 and y2 - y1 > 1 group by 1"),
    "box_confidence": sql("select label, count(*) filter (score >= 250) as n_250, count(*) filter (score >= 300) as n_300, count(*) filter (score >= 400) as n_400 from boxes group by 1"),
    "box_center_to_corner": sql("select page_id, box_id, round(greatest(0.0, least(x1 / 800 * 640 - x2 / 1600 * 640 * 0.5, 640.0)), 6) as x1, round(greatest(0.0, least(y1 / 1200 * 960 - y2 / 2400 * 960 * 0.5, 960.0)), 6) as y1, round(greatest(0.0, least(x1 / 800 * 640 + x2 / 1600 * 640 * 0.5, 640.0)), 6) as x2, round(greatest(0.0, least(y1 / 1200 * 960 + y2 / 2400 * 960 * 0.5, 960.0)), 6) as y2 from boxes"),
    "box_letterbox_inverse": sql("select page_id, box_id, round(greatest(cast(0 as double), least((x1 - 12) / cast(0.5 as double), 1500)), 4) as x, round(greatest(cast(0 as double), least((y1 - 40) / cast(0.5 as double), 2000)), 4) as y from boxes"),
    "box_enlarge_window": sql("""select page_id, box_id, x1 - dw as x1, y1 - dh as y1, least(x2 + dw, 1010) as x2, least(y2 + dh, 1370) as y2 from (
select *, cast(least(d, x1, 1010 - x2) as int) as dw, cast(least(d, y1, 1370 - y2) as int) as dh from (select *, round((-(w + h) + sqrt(greatest(cast((w + h) * (w + h) as double) - 4 * (1 - cast(1.7 as double)) * w * h, 0))) / 4) as d from (select *, x2 - x1 as w, y2 - y1 as h from boxes)))"""),
    "box_reflect_index": sql("select page_id, box_id, cast(case when n <= 1 then 0 else least(k, p - k) end as int) as i from (select *, ((v % p) + p) % p as k from (select page_id, box_id, y2 * 3 - 900 as v, x1 % 50 + 1 as n, greatest(2 * (x1 % 50), 1) as p from boxes))"),
    "box_class_argmax": sql("select page_id, box_id, cast(case when c >= a and c >= b then 2 when b >= a then 1 else 0 end as int) as class_id, greatest(a, b, c) as class_score from (select page_id, box_id, score % 7 as a, x1 % 7 as b, y1 % 7 as c from boxes)"),
    "box_order_votes": sql("select page_id, box_id, v, cast(row_number() over (partition by page_id order by v, box_id) - 1 as int) as position from (select a.page_id, a.box_id, round(coalesce(sum(1 / (1 + exp(-(a.y1 - b.y1) / 40.0))), 0), 6) as v from boxes a left join boxes b on a.page_id = b.page_id and a.box_id <> b.box_id group by 1, 2)"),
    "box_largest_gap": _gap("y1", "y2", 8),
    "box_largest_gap_x": _gap("x1", "x2", 10),
    "box_row_band_order": sql("select page_id, box_id, cast(row_number() over (partition by page_id order by y1 // 100, x1 desc, box_id) as int) as position from boxes"),
    "box_upper_median_size": sql("select page_id, greatest(list_sort(list(x2 - x1))[cast(floor(count(*) / 2) as int) + 1], 1) as median_w, greatest(list_sort(list(y2 - y1))[cast(floor(count(*) / 2) as int) + 1], 1) as median_h from boxes group by 1"),
    "box_label_extent": sql('select page_id, label, min(x1) as "left", min(y1) as top, max(x2) + 1 as "right", max(y2) + 1 as bottom, max(x2) + 1 - min(x1) as width, max(y2) + 1 - min(y1) as height from boxes group by 1, 2'),
    "box_label_majority": sql("select page_id, label, n from (select page_id, label, count(*) as n from boxes group by 1, 2) qualify row_number() over (partition by page_id order by n desc, label desc) = 1"),
    "box_seed_majority": sql("select page_id, seed, label, n from (select s.page_id, s.box_id as seed, c.label, count(*) as n from boxes s join boxes c on s.page_id = c.page_id where s.box_id <= 3 and (c.x1 + c.x2) / 2 >= s.x1 and (c.x1 + c.x2) / 2 < s.x2 and (c.y1 + c.y2) / 2 >= s.y1 and (c.y1 + c.y2) / 2 < s.y2 group by 1, 2, 3) qualify row_number() over (partition by page_id, seed order by n desc, label desc) = 1"),
    "box_area_rank_labels": sql("select * from (select page_id, box_id, cast((x2 - x1) * (y2 - y1) as bigint) as area, cast(row_number() over (partition by page_id order by (x2 - x1) * (y2 - y1) desc, box_id) as int) as paint_id from boxes) where paint_id <= 4"),
    "box_distinct_overlap_labels": sql("select page_id, string_agg(distinct label, ',' order by label) as labels from (select page_id, unnest([a_label, b_label]) as label from pairs where inter > 0) group by 1", _PAIRS.format("boxes")),
    "box_slice_plan": sql("select * from plan", PAGES, PLAN),
    "box_slice_union": sql("select b.page_id, b.box_id, v.k as slice, b.x1, b.y1 + p.y_from as y1, b.x2, b.y2 + p.y_from as y2 from boxes b, (values (0), (1)) v(k) join plan p on p.page_id = b.page_id and p.slice = v.k", PAGES, PLAN),
    "box_polygon_area": sql("select page_id, cast(case when count(*) >= 3 then sum(x1 * ny - nx * y1) else 0 end as bigint) as area2 from (select *, coalesce(lead(x1) over w, first_value(x1) over w) as nx, coalesce(lead(y1) over w, first_value(y1) over w) as ny from boxes window w as (partition by page_id order by box_id)) group by 1"),
    "box_unshared_label": sql("select page_id, box_id, label, count(*) over (partition by page_id, label) = 1 as may_expand from boxes"),
    "box_sort_variants": sql("select page_id, box_id, cast(row_number() over (partition by page_id order by y1 + y2, box_id) as int) as by_centre_y, cast(row_number() over (partition by page_id order by score desc, box_id) as int) as by_score, cast(row_number() over (partition by page_id order by (x2 - x1) * (y2 - y1) desc, box_id) as int) as by_area from boxes"),
    "box_nms": "with recursive " + BOXES_SQL + """,
b as (select *, row_number() over (partition by page_id, label order by score desc, box_id) as i from boxes),
bad as (select a.page_id, a.label, a.i as earlier, b.i as later from b a join b on a.page_id = b.page_id and a.label = b.label and a.i < b.i where """ + INTER + " * 100 > (" + AREA.format("a") + " + " + AREA.format("b") + " - " + INTER + """) * 35),
k as (select page_id, label, 1 as i, [1] as kept from b where i = 1
  union all select k.page_id, k.label, k.i + 1, case when exists (select 1 from bad where bad.page_id = k.page_id and bad.label = k.label and later = k.i + 1 and list_contains(kept, earlier)) then kept else list_append(kept, k.i + 1) end
  from k where k.i < (select max(i) from b where b.page_id = k.page_id and b.label = k.label)),
f as (select page_id, label, kept from k qualify i = max(i) over (partition by page_id, label))
select f.page_id, f.label, cast(list_position(kept, b.i) - 1 as int) as position, b.box_id, score, x1, y1, x2, y2 from f join b on b.page_id = f.page_id and b.label = f.label and list_contains(kept, b.i)""",
    # A box is kept unless a kept box comes before it: a recursion over places, all pages at once.
    "box_dedupe": "with recursive " + BOXES_SQL + """,
b as (select *, (x2 - x1) * (y2 - y1) as area from boxes),
bad as (select a.page_id, a.box_id as earlier, b.box_id as later from b a join b on a.page_id = b.page_id and a.box_id < b.box_id where """ + INTER + """ * 100 >= 90 * greatest(least(a.area, b.area), 1)),
k as (select page_id, 1 as i, [1] as kept from b where box_id = 1
  union all select k.page_id, i + 1, case when exists (select 1 from bad where bad.page_id = k.page_id and later = i + 1 and list_contains(kept, earlier)) then kept else list_append(kept, i + 1) end
  from k where i < (select max(box_id) from b where b.page_id = k.page_id)),
f as (select page_id, kept from k qualify i = max(i) over (partition by page_id))
select f.page_id, cast(list_position(kept, b.box_id) - 1 as int) as position, b.box_id, score, x1, y1, x2, y2 from f join b on b.page_id = f.page_id and list_contains(kept, b.box_id)""",
}

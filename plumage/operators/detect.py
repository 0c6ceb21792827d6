"""Operators on detected boxes that DataFrame expressions cover: filters, theta joins inside a page, ranks, votes.

Joins between boxes have the page as an equi-key, so a page's boxes meet in one partition and no two pages are compared.
Ranks are windows by page with a complete order, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from plumage.functions import geometry as g


def by_page(*order) -> WindowSpec:
    w = Window.partitionBy("page_id")
    return w.orderBy(*order) if order else w


def best() -> WindowSpec:
    return by_page(F.desc("score"), "box_id")


def at_least(boxes: DataFrame, score: int) -> DataFrame:
    """Equality is kept."""
    return boxes.where(F.col("score") >= score)


def top_k(boxes: DataFrame, k: int) -> DataFrame:
    """The k best of each page; of equal scores the smaller number wins."""
    return boxes.withColumn("rank", F.row_number().over(best())).where(F.col("rank") <= k)


def top_then_threshold(boxes: DataFrame, k: int, score: int) -> DataFrame:
    """Top k first, the score after: a box that the threshold drops has still used a place."""
    return at_least(top_k(boxes, k), score)


def renumbered(boxes: DataFrame, score: int) -> DataFrame:
    """Boxes of a page numbered 0, 1, ... by their number, after a filter."""
    return at_least(boxes, score).withColumn("position", F.row_number().over(by_page("box_id")) - 1)


def page_pairs(boxes: DataFrame, condition, *columns: str) -> DataFrame:
    """Pairs (a, b) of a page with a before b for which condition(a, b) holds, as structs a and b."""
    own = boxes.select("page_id", F.struct("box_id", *g.SIDES, *columns).alias("a"))
    other = own.withColumnRenamed("a", "b")
    return own.join(other, "page_id").where((F.col("a.box_id") < F.col("b.box_id")) & condition(F.col("a"), F.col("b")))


def overlap_pairs(boxes: DataFrame, percent: int) -> DataFrame:
    """Pairs with iou of at least percent, with areas and the containment relation at 85 percent."""
    a, b = F.col("a"), F.col("b")
    return page_pairs(boxes, lambda a, b: g.iou_at_least(a, b, percent), "label").select(
        "page_id", F.col("a.box_id").alias("a_id"), F.col("b.box_id").alias("b_id"), g.intersection(a, b).cast("long").alias("inter"),
        g.union_area(a, b).cast("long").alias("uni"), g.contained_relation(a, b, 85).alias("larger"), F.col("a.label").alias("a_label"), F.col("b.label").alias("b_label"),
    )


def mostly_contained_pairs(boxes: DataFrame, percent: int) -> DataFrame:
    """Ordered pairs (outer, inner)."""
    own = boxes.select("page_id", F.struct("box_id", *g.SIDES).alias("a"))
    both = own.join(own.withColumnRenamed("a", "b"), "page_id").where(F.col("a.box_id") != F.col("b.box_id"))
    return both.where(g.mostly_contained(F.col("a"), F.col("b"), percent)).select("page_id", F.col("a.box_id").alias("outer_id"), F.col("b.box_id").alias("inner_id"))


def clamp_and_drop(boxes: DataFrame, width: int, height: int, least: int) -> DataFrame:
    """Clamped to the page; sides of ``least`` pixels or under are dropped."""
    c = boxes.select("page_id", "box_id", *[x.alias(s) for s, x in g.clamped(g.box(), F.lit(width), F.lit(height)).items()])
    return c.where((F.col("x2") - F.col("x1") > least) & (F.col("y2") - F.col("y1") > least))


def text_regions(boxes: DataFrame, label: str = "label", aspect: float = 1.15, keep: tuple[str, ...] = ()) -> DataFrame:
    """Boxes labelled content, text or title, corners in order, at least 6 x 6 and 48 pixels; with the direction and columns to keep."""
    x1, x2 = F.greatest(F.least("x1", "x2"), F.lit(0)), F.greatest("x1", "x2")
    y1, y2 = F.greatest(F.least("y1", "y2"), F.lit(0)), F.greatest("y1", "y2")
    name = F.lower(label)
    b = boxes.where((name == "content") | name.contains("text") | name.contains("title"))
    b = b.select("page_id", "box_id", x1.alias("x"), y1.alias("y"), F.greatest(x2 - x1, F.lit(1)).alias("w"), F.greatest(y2 - y1, F.lit(1)).alias("h"), *keep)
    tall = F.when(F.col("h") >= F.col("w") * aspect, F.lit("vertical")).otherwise("horizontal")
    return b.where((F.col("w") >= 6) & (F.col("h") >= 6) & (F.col("w") * F.col("h") >= 48)).withColumn("direction", tall)


def class_argmax(boxes: DataFrame, scores: list[str]) -> DataFrame:
    """The class with the largest score; of equal ones the last."""
    classes = F.array(*[F.struct(F.col(c).alias("s"), F.lit(i).alias("k")) for i, c in enumerate(scores)])
    top = F.array_max(classes)
    return boxes.select("page_id", "box_id", top["k"].alias("class_id"), top["s"].alias("class_score"))


def order_votes(boxes: DataFrame, scale: float) -> DataFrame:
    """Each box collects the logistic share of every other box of the page above it; fewest votes come first. A page's boxes meet as an array, in one shuffle."""
    pages = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("box_id", "y1"))).alias("bs"))

    def votes(a: Column) -> Column:
        share = lambda b: F.when(a["box_id"] != b["box_id"], 1 / (1 + F.exp(-(a["y1"] - b["y1"]) / scale)))
        total = F.aggregate("bs", F.lit(0.0), lambda v, b: v + F.coalesce(share(b), F.lit(0.0)))
        return F.struct(F.round(F.when(F.col("page_id").isNull(), 0.0).otherwise(total), 6).alias("v"), a["box_id"].alias("box_id"))

    voted = pages.select("page_id", F.posexplode(F.array_sort(F.transform("bs", votes))).alias("position", "b"))
    return voted.select("page_id", "b.box_id", "b.v", "position")


def largest_gap(boxes: DataFrame, low: str, high: str, least: int) -> DataFrame:
    """The widest stretch of the axis that no box of the page covers; of equal ones the first; none under ``least``."""
    w = by_page(low, "box_id")
    reach = F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gaps = boxes.select("page_id", "box_id", F.col(low).alias("to"), reach.alias("from")).where(F.col("to") - F.col("from") >= least)
    pick = F.row_number().over(by_page(F.desc(F.col("to") - F.col("from")), "from"))
    return gaps.withColumn("n", pick).where("n = 1").select("page_id", F.col("from").alias("gap_from"), F.col("to").alias("gap_to"))


def row_band_order(boxes: DataFrame, band: int, rtl: bool = True) -> DataFrame:
    """Rows of ``band`` pixels from the top; inside a row from the right (rtl) or the left."""
    w = by_page(F.floor(F.col("y1") / band), F.desc("x1") if rtl else F.col("x1"), "box_id")
    return boxes.select("page_id", "box_id", F.row_number().over(w).alias("position"))


def upper_median(values: Column) -> Column:
    """Of an array: the middle one, the upper of two; 1 at least."""
    return F.greatest(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(1))


def size_medians(boxes: DataFrame) -> DataFrame:
    """Upper medians of width and height; a page's boxes are few, so their sides fit in an array."""
    return boxes.groupBy("page_id").agg(upper_median(F.collect_list(F.col("x2") - F.col("x1"))).alias("median_w"), upper_median(F.collect_list(F.col("y2") - F.col("y1"))).alias("median_h"))


def label_extents(boxes: DataFrame) -> DataFrame:
    """Bounding box and size of each label of a page; right and bottom are exclusive."""
    e = boxes.groupBy("page_id", "label").agg(F.min("x1").alias("left"), F.min("y1").alias("top"), (F.max("x2") + 1).alias("right"), (F.max("y2") + 1).alias("bottom"))
    return e.withColumns({"width": F.col("right") - F.col("left"), "height": F.col("bottom") - F.col("top")})


def majority_label(rows: DataFrame, *keys: str) -> DataFrame:
    """The most frequent label of a group; of equal ones the highest."""
    counts = rows.groupBy(*keys, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.max_by("label", F.struct("n", "label")).alias("label"), F.max("n").alias("n"))


def labels_by_area(boxes: DataFrame, most: int = 255) -> DataFrame:
    """Numbers 1, 2, ... from the largest area down, at most ``most``: paint order, smaller ones last."""
    size = g.area(g.box())
    w = by_page(F.desc("area"), "box_id")
    return boxes.select("page_id", "box_id", size.cast("long").alias("area")).withColumn("paint_id", F.row_number().over(w)).where(F.col("paint_id") <= most)


def slice_plan(pages: DataFrame, ratio: float = 3.5, target: float = 3.0, overlap: float = 0.2, least: float = 0.7) -> DataFrame:
    """Slices (page_id, slice, y_from, y_to) of pages (page_id, width, height).

    Tall pages (height over ``ratio`` widths) get slices of ``target`` widths that overlap; a last slice of at most ``least``
    of a slice's height is joined to the one before. Others are one slice.
    """
    tall = F.greatest(F.round(F.col("width") * target), F.lit(1.0)).cast("int")
    p = pages.where("width > 0 and height > 0").withColumn("tall", tall)
    p = p.withColumn("step", F.greatest(F.round(F.col("tall") * (1 - overlap)), F.lit(1.0)).cast("int"))
    p = p.withColumn("n", F.ceil(F.col("height") / F.col("step")).cast("int"))
    short = (F.col("n") > 1) & ((F.col("height") - (F.col("n") - 1) * F.col("step")) / F.col("tall") <= least)
    p = p.withColumn("n", F.when(F.col("height") / F.col("width") > ratio, F.greatest(F.when(short, F.col("n") - 1).otherwise(F.col("n")), F.lit(1))).otherwise(F.lit(1)))
    p = p.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    start = F.col("slice") * F.col("step")
    end = F.when(F.col("slice") == F.col("n") - 1, F.col("height")).otherwise(F.least(start + F.col("tall"), F.col("height")))
    return p.select("page_id", "slice", start.alias("y_from"), end.alias("y_to"))


def slice_union(detections: DataFrame, plan: DataFrame) -> DataFrame:
    """Detections of slices (page_id, slice, box) moved to page coordinates."""
    d = detections.join(plan.select("page_id", "slice", "y_from"), ["page_id", "slice"])
    return d.withColumns({"y1": F.col("y1") + F.col("y_from"), "y2": F.col("y2") + F.col("y_from")}).drop("y_from")


def polygon_area_twice(points: DataFrame) -> DataFrame:
    """Signed double area of each page's polygon (page_id, i, x, y), closed; 0 under three points."""
    w = by_page("i")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y"))
    step = points.select("page_id", (F.col("x") * ny - nx * F.col("y")).alias("s"))
    return step.groupBy("page_id").agg(F.when(F.count("*") >= 3, F.sum("s")).otherwise(0).cast("long").alias("area2"))


def unshared(blocks: DataFrame) -> DataFrame:
    """Whether a box is the only one of its page with its label: only those may grow into it."""
    return blocks.select("page_id", "box_id", "label", (F.count("*").over(Window.partitionBy("page_id", "label")) == 1).alias("may_expand"))


def seed_majority(boxes: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each seed rectangle of a page, the majority label among the boxes whose centre lies in it."""
    c = boxes.select("page_id", "label", ((F.col("x1") + F.col("x2")) / 2).alias("cx"), ((F.col("y1") + F.col("y2")) / 2).alias("cy"))
    s = seeds.select("page_id", F.col("box_id").alias("seed"), *g.SIDES)
    hit = c.join(s, "page_id").where((F.col("cx") >= F.col("x1")) & (F.col("cx") < F.col("x2")) & (F.col("cy") >= F.col("y1")) & (F.col("cy") < F.col("y2")))
    return majority_label(hit, "page_id", "seed")


def _struct(b: Column) -> dict[str, Column]:
    return {s: b[s] for s in g.SIDES}


def _greedy(boxes: DataFrame, keys: list[str], order: list[Column], clash, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keeps a box if it clashes with none of those already kept, in the given order: a fold over the group's sorted array."""
    row = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], "box_id", "score", *g.SIDES, *keep)
    groups = boxes.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("bs"))
    empty = F.filter("bs", lambda b: F.lit(False))
    kept = F.aggregate("bs", empty, lambda acc, b: F.when(F.exists(acc, lambda k: clash(_struct(k), _struct(b))), acc).otherwise(F.concat(acc, F.array(b))))
    return groups.select(*keys, F.posexplode(kept).alias("position", "b")).select(*keys, "position", "b.box_id", "b.score", *[F.col(f"b.{s}").alias(s) for s in (*g.SIDES, *keep)])


def nms(boxes: DataFrame, percent: int, keys: tuple[str, ...] = ("page_id", "label")) -> DataFrame:
    """Non-maximum suppression in each group: best score first, equal scores by number; iou above the threshold suppresses."""

    def clash(k, b):
        return g.intersection(k, b) * 100 > g.union_area(k, b) * percent

    return _greedy(boxes, list(keys), [-F.col("score"), F.col("box_id")], clash)


def keep_first(boxes: DataFrame, percent: int = 90, keep: tuple[str, ...] = ()) -> DataFrame:
    """Drops a box of which, or of a kept one, ``percent`` is covered by the other; only kept boxes count."""

    def clash(k, b):
        shared = g.intersection(k, b) * 100
        return (shared >= F.greatest(g.area(b), F.lit(1)) * percent) | (shared >= F.greatest(g.area(k), F.lit(1)) * percent)

    return _greedy(boxes, ["page_id"], [F.col("box_id")], clash, keep)

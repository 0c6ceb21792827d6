"""Aggregations and lookups of recognised blocks, and sampling filters over scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.operators.lineage import cut


def block_text(lines: DataFrame, keys: list[str], ord_col: str, text: str, score: str, colours: list[str]) -> DataFrame:
    """One row for each block: its lines' text in order, mean score, mean colours (rounded, 0 to 255)."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(text).alias("t"))))
    mean = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.round(F.avg(c)).cast("int")))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "").alias("text"), F.avg(score).alias("score"), *[mean(c).alias(c) for c in colours])


def with_all_blocks(blocks: DataFrame, found: DataFrame, keys: list[str], defaults: dict) -> DataFrame:
    """A row for every block; blocks without lines get the defaults."""
    return blocks.join(found, keys, "left").fillna(defaults)


def weighted_colour(rows: DataFrame, keys: list[str], fg: str, bg: str, has_fg: str, has_bg: str) -> DataFrame:
    """Mean foreground of the rows that have one; mean background, of the foreground where a row has no background."""
    back = F.when(F.col(has_bg), F.col(bg)).when(F.col(has_fg), F.col(fg))
    mean = lambda c: F.coalesce(F.round(F.avg(c)), F.lit(0.0)).cast("int")
    return rows.groupBy(*keys).agg(mean(F.when(F.col(has_fg), F.col(fg))).alias("fg"), mean(back).alias("bg"))


def median_and_deviation(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The median (mean of the middle two) and the root mean square deviation about it, not about the mean."""
    medians = rows.groupBy(*keys).agg(F.median(value).alias("median"))
    joined = rows.join(medians, keys)
    return joined.groupBy(*keys).agg(F.first("median").alias("median"), F.sqrt(F.avg(F.pow(F.col(value) - F.col("median"), 2))).alias("deviation"))


def integer_median(value: str) -> Column:
    """For whole, non-negative values: an even count's middle two are averaged and rounded down."""
    return F.floor(F.median(value)).cast("int")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def top_indices(scores: Column, k: int) -> Column:
    """(index, value) of the k largest, the smaller index first of equal ones."""
    ranked = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("neg"), i.alias("index"), x.alias("value"))))
    return F.transform(F.slice(ranked, 1, k), lambda r: F.struct(r["index"].alias("index"), r["value"].alias("value")))


def sampling_filter(logits: DataFrame, keys: list[str], token: str, logit: str, top_k: int | None = None, top_p: float | None = None, min_p: float | None = None, temperature: float = 1.0) -> DataFrame:
    """Tokens that survive top-k, then top-p (the least head that reaches p), then min-p (share of the best); adds p.

    Each filter sees what the one before has left; probabilities are taken anew after it. Equal logits: smaller token first.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc(logit), token)
    group = Window.partitionBy(*keys)
    rows = logits.withColumn("rank", F.row_number().over(best))
    if top_k:
        rows = rows.where(F.col("rank") <= top_k)

    def probable(df: DataFrame) -> DataFrame:
        e = F.exp((F.col(logit) - F.max(logit).over(group)) / temperature)
        df = df.withColumn("_e", e)
        return df.withColumn("p", F.col("_e") / F.sum("_e").over(group)).drop("_e")

    rows = probable(rows)
    if top_p:
        ahead = F.coalesce(F.sum("p").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
        rows = probable(rows.withColumn("_a", ahead).where(F.col("_a") < top_p).drop("_a"))
    if min_p:
        rows = probable(rows.withColumn("_m", F.max("p").over(group)).where(F.col("p") >= min_p * F.col("_m")).drop("_m"))
    return rows


def _shares(logits: DataFrame, keys: list[str], logit: str) -> DataFrame:
    group = Window.partitionBy(*keys)
    df = logits.withColumn("_e", F.exp(F.col(logit) - F.max(logit).over(group)))
    return df.withColumn("p", F.col("_e") / F.sum("_e").over(group)).drop("_e")


def typical_filter(logits: DataFrame, keys: list[str], token: str, logit: str, share: float, least: int = 1) -> DataFrame:
    """The tokens whose surprise is nearest the group's entropy, as many as together exceed ``share`` (and ``least`` at least); adds p.

    Equally near ones: smaller token first; distances are compared to nine places.
    """
    rows = _shares(logits, keys, logit)
    surprise = F.when(F.col("p") > 0, -F.log("p")).otherwise(0.0)
    rows = rows.withColumn("_s", surprise).withColumn("_h", F.sum(F.col("p") * F.col("_s")).over(Window.partitionBy(*keys)))
    order = Window.partitionBy(*keys).orderBy(F.round(F.abs(F.col("_s") - F.col("_h")), 9), token)
    ahead = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumns({"_a": ahead, "_k": F.row_number().over(order)}).where((F.col("_a") <= share) | (F.col("_k") <= least)).drop("_s", "_h", "_a", "_k")


def sigma_filter(logits: DataFrame, keys: list[str], logit: str, n: float) -> DataFrame:
    """The tokens at most ``n`` standard deviations (of all the group's logits) below the best."""
    group = Window.partitionBy(*keys)
    return logits.withColumn("_t", F.max(logit).over(group) - n * F.stddev_pop(logit).over(group)).where(F.col(logit) >= F.col("_t")).drop("_t")


def penalised(logits: DataFrame, history: DataFrame, keys: list[str], token: str, logit: str, place: str, last: int, repeat: float = 1.0, frequency: float = 0.0, presence: float = 0.0) -> DataFrame:
    """Logits lowered for tokens among each group's ``last`` newest of ``history`` (keys, place, token); 0 takes none, -1 all.

    A positive logit is divided by ``repeat``, another one multiplied; then ``frequency`` for each time and ``presence`` once are taken off.
    """
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(place)))
    recent = history if last < 0 else history.withColumn("_k", newest).where(F.col("_k") <= last)
    seen = recent.groupBy(*keys, token).agg(F.count("*").alias("_n"))
    scaled = F.when(F.col(logit) > 0, F.col(logit) / repeat).otherwise(F.col(logit) * repeat)
    lowered = scaled - F.col("_n") * frequency - presence
    return logits.join(seen, [*keys, token], "left").withColumn(logit, F.when(F.col("_n").isNull(), F.col(logit)).otherwise(lowered)).drop("_n")


def shape_groups(rows: DataFrame, w: str, h: str, patch: int, merge: int) -> DataFrame:
    """Rows of one size are one batch: count and tokens, (h / patch / merge) x (w / patch / merge)."""
    side = lambda c: F.floor(F.floor(F.col(c) / patch) / merge)
    return rows.groupBy(w, h).agg(F.count("*").alias("n")).withColumn("tokens", (side(w) * side(h)).cast("long"))


def span_shares(spans: DataFrame, trace: str, parent: str, value: str) -> DataFrame:
    """Each span's percentage of its trace's root (the span without a parent)."""
    root = spans.where(F.col(parent).isNull()).groupBy(trace).agg(F.sum(value).alias("_root"))
    return spans.join(root, trace).withColumn("percent", F.round(F.try_divide(F.col(value) * 100, F.col("_root")), 4)).drop("_root")


def zip_by_position(left: DataFrame, right: DataFrame, key: str, left_ord: str, right_ord: str) -> DataFrame:
    """Rows of either side of a key paired by rank; the shorter side ends it."""
    a = left.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(left_ord)))
    b = right.withColumn("_place", F.row_number().over(Window.partitionBy(key).orderBy(right_ord)))
    return a.join(b, [key, "_place"]).drop("_place")


def global_position(rows: DataFrame, *order) -> DataFrame:
    """Adds ``position`` (from 1) by a complete order over all rows, without a window over all rows.

    Rows are ranked inside range partitions and shifted by the counts of the partitions before, one row for each. The ranged
    rows are written once, with their partition's number, and both sides read that: planned twice, the exchange would
    sample its ranges twice, and the sides could disagree.
    """
    parts = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    own = parts.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    ahead = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = parts.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", ahead.alias("_ahead"))
    return own.join(F.broadcast(shifts), "_part").withColumn("position", F.col("_k") + F.col("_ahead")).drop("_part", "_k", "_ahead")


def overlapping_labels(mask: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, labels): the labels above 0 of places (page, x, y, label) that the mask (page, x, y, v) has set, each once, in order."""
    hit = labels.where("label > 0").join(mask.where("v > 0"), ["page", "x", "y"], "left_semi").select("page", "label").distinct()
    return hit.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list("label")), ",").alias("labels"))  # at most 255 labels a page


def contrast(r: Column, g: Column, b: Column) -> Column:
    """Black on light colours, white on dark ones."""
    return F.when(0.299 * r + 0.587 * g + 0.114 * b > 128, F.lit("black")).otherwise("white")


def first_set(*choices: tuple[Column, Column]) -> Column:
    """The value of the first choice that is set; a set null (disabled) is a result, not a gap."""
    out = F
    for given, value in choices:
        out = out.when(given, value)
    return out


def to_byte(p: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)) * 255).cast("int")

"""Importance resampling towards a target distribution, in DataFrame operations only.

Features are hashed into buckets. Counts of all documents (the source) and of a target table give each bucket a gain, the
logarithm of how much likelier its features are in the target; a document's weight is the sum of its features' gains, and a
weighted draw without replacement is the largest sums of weight and Gumbel noise, which a hash of the id makes.

Scoring explodes nothing: higher-order functions make each document's array of buckets, and an aggregate over it looks the
gains up in a literal array of ``n_buckets`` entries. What is shuffled is one count for each bucket and task, and for the
draw the ids and scores of the rows that may be drawn, never a text. The counts that reach the driver are ``n_buckets`` pairs.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import Scratch, pick, table
from plumage.operators.aggregate import global_position

N_BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: ASCII that is neither a digit nor a small letter separates words.
SEPARATOR_RUN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: Equal rows are spread over so many places of the final order.
COPIES = 4096


def feature_words(text: Column) -> Column:
    """A-Z in small letters, then the maximal runs of characters other than separators; none for a null text."""
    small = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(small, SEPARATOR_RUN), "")


def buckets(words: Column, max_n: int, n_buckets: int) -> Column:
    """The buckets of all runs of 1 to ``max_n`` words, repeats included."""

    def runs(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    features = F.concat(words, *map(runs, range(2, max_n + 1))) if max_n > 1 else words
    return F.transform(features, lambda x: (F.crc32(x.cast("binary")) % n_buckets).cast("int"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", max_n: int = MAX_N, n_buckets: int = N_BUCKETS) -> list[int]:
    """Each bucket's gain in thousandths of a natural logarithm, rounded down; 1 is added to every count."""
    sides = [(docs, text_col, F.lit(0)), (target, target_text, F.lit(1))]
    rows = [df.select(buckets(feature_words(pick(df, c)), max_n, n_buckets).alias("b"), side.alias("side")) for df, c, side in sides]
    found = rows[0].unionAll(rows[1]).select("side", F.explode("b").alias("b")).groupBy("side", "b").count().collect()  # at most two for each bucket
    count = {(r["side"], r["b"]): r["count"] for r in found}
    s, t = ([count.get((side, b), 0) for b in range(n_buckets)] for side in (0, 1))
    all_s, all_t = float(sum(s) + n_buckets), float(sum(t) + n_buckets)
    return [math.floor(1000 * math.log((t[b] + 1.0) * all_s / ((s[b] + 1.0) * all_t))) for b in range(n_buckets)]


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id; a null id counts as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    max_n: int = MAX_N, n_buckets: int = N_BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_features, weight, score, rank (bigint; null where not drawn).

    Of the rows with ``min_words`` words or more, ``percent`` in a hundred (rounded down) are drawn, by descending score; ties
    go to the smaller id, a null id coming last. Null and empty texts have no features and weight 0. Repeated rows are drawn
    one by one, each with a rank of its own. An empty target leaves gains that only the source's counts make; an empty
    table gives no rows; other columns play no part.
    """
    scratch = Scratch(docs.sparkSession)
    gain = F.split(F.lit(",".join(map(str, gains(docs, target, text_col, target_text, max_n, n_buckets)))), ",").cast("array<bigint>")  # folded into one literal
    rows = docs.select(pick(docs, id_col).alias("doc_id"), feature_words(pick(docs, text_col)).alias("w"))
    rows = rows.select("doc_id", F.size("w").alias("n_words"), buckets(F.col("w"), max_n, n_buckets).alias("b"))
    weight = F.aggregate("b", F.lit(0).cast("bigint"), lambda acc, b: acc + F.element_at(gain, b + 1))
    rows = rows.select("doc_id", "n_words", F.size("b").cast("long").alias("n_features"), weight.alias("weight"))
    rows = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = scratch.save(rows.withColumn("copy", F.monotonically_increasing_id() % COPIES), "scored")
    may = rows.where(F.col("n_words") >= min_words)
    drawn = may.count() * percent // 100
    placed = global_position(may, F.desc("score"), F.asc_nulls_last("doc_id"), "weight", "n_features", "copy")
    placed = placed.withColumn("rank", F.when(F.col("position") <= drawn, F.col("position")).cast("long"))
    rest = rows.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return placed.select(*columns).unionAll(rest.select(*columns))


def drawn_rows(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose id is drawn, with all their columns; ids are taken to be unique."""
    ids = resample(docs, target, id_col, text_col, **options).where("rank is not null").select(F.col("doc_id").alias("_drawn"))
    return docs.join(ids, pick(docs, id_col).eqNullSafe(F.col("_drawn")), "left_semi")


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: CRC-32 of a text's UTF-8 bytes (column t.tab: its table of 256 entries, made by CRC_TABLE).
CRC_TABLE = "select list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as tab"


def crc_sql(text: str, tab: str = "tab") -> str:
    bytes_ = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint))"
    return f"xor(list_reduce(list_prepend(4294967295, {bytes_}), lambda c, b: xor(c >> 8, {tab}[(xor(c, b) & 255) + 1])), 4294967295)"


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents), q as (select {_WORDS} as w from benchmark),
dw as (select r, unnest(w) as x from d), qw as (select unnest(w) as x from q), c as ({CRC_TABLE}),
b as (select x, {crc_sql("x")} % {N_BUCKETS} as b from (select x from dw union select x from qw) join c on true),
s as (select b, count(*) as s from dw join b using (x) group by b), t as (select b, count(*) as t from qw join b using (x) group by b),
g as (select b, cast(floor(1000 * ln((coalesce(t, 0) + 1.0::double) * ((select count(*) from dw) + {N_BUCKETS}) / ((coalesce(s, 0) + 1.0::double) * ((select count(*) from qw) + {N_BUCKETS})))) as bigint) as gain
  from (select distinct b from b) left join s using (b) left join t using (b)),
w as (select r, cast(sum(gain) as bigint) as weight from dw join b using (x) join g using (b) group by r),
e as (select doc_id, len(w) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::varchar, '')), 1, 8) as bigint) + 0.5::double) / 4294967296))) as bigint) as score from d left join w using (r)),
o as (select *, n_features >= {MIN_WORDS} as may, row_number() over (partition by n_features >= {MIN_WORDS} order by score desc, doc_id nulls last, weight, n_features) as k, count(*) over (partition by n_features >= {MIN_WORDS}) as n from e)
select doc_id, n_features, weight, score, case when may and k <= {PERCENT} * n // 100 then k end as rank from o
"""

"""Line dedup over repeated runs of lines, or over content-defined chunks of lines, in DataFrame operations only.

Runs: every line that lies in a run of two lines or more that occurred earlier anywhere goes. Such a run is found by its
smallest parts, each two neighbouring lines of which one holds a word, and each two lines with words and the wordless lines
between them, so no run is lost by where a boundary falls. A run's first and last line hold a word or lie beside a line of
the run that does: of several wordless lines in a row at its edge, one counts. Parts are compared by their lines' hashes,
which are trusted once all lines with a hash are known to be byte-equal; parts with another hash are compared by bytes.

Chunks: a rolling hash over the hashes of SPAN neighbouring lines ends a chunk where it is 0 modulo ``every``, so boundaries follow
the content and an inserted line shifts none but its own neighbours. A chunk of two lines or more that holds a word and
occurs more than once anywhere is removed, but for its first occurrence (smallest id, then first place).

Chunks are compared by bytes: they are grouped by (hash, bytes), combined before the shuffle, and a hash is trusted in the
later steps, which carry hashes only, once all chunks with that hash are known to be byte-equal. Where a hash has
different chunks, its occurrences are matched by their bytes instead. Occurrences are joined, not gathered, so a chunk
that a third of all documents hold is as good as any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import SEPARATORS, Scratch, join_split, pick, table

EVERY = 4
SPAN = 2


def _key(chunk: Column, bits: int) -> Column:
    return F.xxhash64(chunk) if bits >= 64 else F.pmod(F.xxhash64(chunk), F.lit(1 << bits))


def with_chunks(docs: DataFrame, id_col: str, text_col: str, every: int) -> DataFrame:
    """(id, h, lines, ends): h a hash of the text, ends the last line of each chunk, counted from 0."""
    text = pick(docs, text_col).cast("string")
    df = docs.select(pick(docs, id_col).alias("id"), F.xxhash64(text).alias("h"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    df = df.select("*", F.transform("lines", lambda x: F.xxhash64(x)).alias("_lh"))
    rolling = lambda i: F.aggregate(F.slice("_lh", F.greatest(i - SPAN + 2, F.lit(1)), F.lit(SPAN)), F.lit(42).cast("long"), lambda a, x: F.xxhash64(a, x))
    last = F.size("lines") - 1
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.pmod(rolling(i), F.lit(every)) == 0))
    return df.select("id", "h", "lines", ends.alias("ends"))


def _pieces() -> Column:
    """The chunks as (pos, first, size, text), with no text where a chunk isn't to be compared."""

    def piece(end: Column, k: Column) -> Column:
        first = F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1)
        size = end - first + 1
        text = F.array_join(F.slice("lines", first + 1, size), "\n")
        return F.struct(k.alias("pos"), F.when((size >= 2) & (F.btrim(text, F.lit(SEPARATORS)) != ""), text).alias("text"))

    return F.transform("ends", piece)


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, key_bits: int = 64) -> DataFrame:
    """(id, h, gone): the chunks of each document, by place, that an earlier occurrence repeats."""
    scratch = Scratch(docs.sparkSession)
    chunks = with_chunks(docs, id_col, text_col, every).select("id", "h", F.explode(_pieces()).alias("c")).where("c.text is not null")
    chunks = chunks.select("id", "h", "c.pos", _key(F.col("c.text"), key_bits).alias("k"), "c.text")
    by_bytes = chunks.groupBy("k", "text").agg(F.count("*").alias("n"))
    keys = by_bytes.groupBy("k").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).where("n > 1")
    keys = scratch.save(keys.select("k", (F.col("texts") > 1).alias("mixed")), "keys")
    spots = chunks.select("id", "h", "pos", "k").join(keys.where("not mixed").select("k"), "k").withColumn("text", F.lit(None).cast("string"))
    if keys.where("mixed").limit(1).count():
        other = chunks.join(keys.where("mixed").select("k"), "k").join(by_bytes.where("n > 1").select("k", "text"), ["k", "text"])
        spots = spots.unionByName(other)
    spots = scratch.save(spots.withColumn("o", F.struct(F.col("id").isNull().alias("none"), "id", "h", "pos")), "spots")
    scratch.drop("keys")
    spots = spots.withColumn("text", F.coalesce("text", F.lit("")))  # no compared chunk is empty
    first = spots.groupBy("k", "text").agg(F.min("o").alias("first"))
    again = join_split(spots, first, ["k", "text"]).where(~F.col("o").eqNullSafe(F.col("first")))
    return again.groupBy("id", "h").agg(F.collect_set("pos").alias("gone"))


def _parts() -> Column:
    """(first, last) of the smallest runs: neighbours, and lines with words on both sides of several without."""
    word = lambda i: F.btrim(F.get("lines", i), F.lit(SEPARATORS)) != ""
    to = F.size("lines") - 1
    none = F.array().cast("array<int>")
    second = F.when(to > 0, F.filter(F.sequence(F.lit(1), F.greatest(to, F.lit(1))), lambda i: word(i - 1) | word(i))).otherwise(none)
    pairs = F.transform(second, lambda i: F.struct((i - 1).alias("first"), i.alias("last")))
    return F.concat(pairs, F.filter(F.transform("worded", lambda x, k: F.struct(x.alias("first"), F.get("worded", k + 1).alias("last"))), lambda s: s["last"] - s["first"] > 2))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_bits: int = 64) -> DataFrame:
    """(id, h, gone): the lines of each document, by place from 0, that lie in a run which occurred earlier."""
    scratch = Scratch(docs.sparkSession)
    text = pick(docs, text_col).cast("string")
    rows = docs.select(pick(docs, id_col).alias("id"), F.xxhash64(text).alias("h"), F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    worded = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.btrim(F.get("lines", i), F.lit(SEPARATORS)) != "")
    rows = rows.select("*", F.transform("lines", lambda x: _key(x, key_bits)).alias("lh"), worded.alias("worded"))
    size = lambda: F.col("s.last") - F.col("s.first") + 1
    parts = rows.select("id", "h", "lines", "lh", F.explode(_parts()).alias("s"))
    parts = parts.select("id", "h", "s", F.slice("lh", F.col("s.first") + 1, size()).alias("k"), F.array_join(F.slice("lines", F.col("s.first") + 1, size()), "\n").alias("text"))
    keys = scratch.save(parts.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "keys")
    lines = rows.select(F.explode(F.arrays_zip("lh", "lines")).alias("x")).select("x.lh", F.col("x.lines").alias("line")).distinct()
    mixed = scratch.save(lines.groupBy("lh").agg(F.count("*").alias("n")).where("n > 1").select("lh"), "mixed")
    if mixed.limit(1).count():
        unsure = scratch.save(keys.select("k", F.explode("k").alias("lh")).join(mixed, "lh", "left_semi").select("k").distinct(), "unsure")
        sure = parts.join(keys.join(unsure, "k", "left_anti"), "k").withColumn("text", F.lit(""))
        spots = sure.unionByName(parts.join(unsure, "k"))
    else:
        spots = parts.drop("text").join(keys, "k").withColumn("text", F.lit(""))
    spots = scratch.save(spots.select("k", "text", "s.last", F.struct(F.col("id").isNull().alias("none"), "id", "h", "s.first").alias("o")), "spots")
    scratch.drop("keys", "mixed", "unsure")
    first = spots.groupBy("k", "text").agg(F.min("o").alias("first"))
    again = join_split(spots, first, ["k", "text"]).where(~F.col("o").eqNullSafe(F.col("first")))
    gone = again.select("o.id", "o.h", F.explode(F.sequence("o.first", "last")).alias("line"))
    return gone.groupBy("id", "h").agg(F.collect_set("line").alias("gone"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = EVERY, key_bits: int = 64, runs: bool = False) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed, text (null for a null text, else the remaining lines).

    Lines are what line feeds separate; a null text has none. Rows equal in id and text are one document and keep the same
    lines; a null id comes after all others. ``runs`` asks for all repeated runs instead of chunks; ``every`` is the mean
    number of lines of a chunk; ``key_bits`` under 64 makes hashes collide, for tests. An empty table gives no rows; other
    columns play no part.
    """
    gone = repeated_runs(docs, id_col, text_col, key_bits) if runs else repeated_chunks(docs, id_col, text_col, every, key_bits)
    # rows that share id and text share their lines' fate; wrapped, null ids meet too, and Spark may split what is common
    df = with_chunks(docs.select(pick(docs, id_col).alias("id"), pick(docs, text_col).alias("t")), "id", "t", every).withColumn("null", F.col("h") == F.xxhash64(F.lit(None).cast("string")))
    key = lambda df: df.withColumn("_id", F.struct("id"))
    df = join_split(key(df), key(gone).drop("id"), ["h", "_id"], "left")

    def left(end: Column, k: Column) -> Column:
        first = F.when(k == 0, 0).otherwise(F.get("ends", k - 1) + 1)
        return F.when(F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), k), F.array().cast("array<string>")).otherwise(F.slice("lines", first + 1, end - first + 1))

    if runs:
        places = F.sequence(F.lit(0), F.size("lines") - 1)
        kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.transform(F.array_except(places, F.col("gone")), lambda i: F.get("lines", i)))
    else:
        kept = F.flatten(F.transform("ends", left))
    df = df.select("id", "lines", "null", kept.alias("kept"))
    empty = F.col("null") & (F.array_join("lines", "\n") == "")
    n = F.when(empty, 0).otherwise(F.size("lines")).cast("long")
    return df.select(
        F.col("id").alias("doc_id"), n.alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_removed"), F.when(~empty, F.array_join("kept", "\n")).alias("text")
    )


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), runs=True)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


ORACLE = """
with d as (select doc_id, text is null as none, string_split(coalesce(text, ''), chr(10)) as l from documents),
k as (select doc_id, i, l[i] as line, regexp_matches(l[i], '[^\\x20\\x09-\\x0D]') as word from d, unnest(range(1, len(l) + 1)) as r(i)),
p as (select doc_id, i as a, i + 1 as z from (select *, lead(word) over (partition by doc_id order by i) as other from k) where word and other is not null or other
  union all select doc_id, i, z from (select doc_id, i, lead(i) over (partition by doc_id order by i) as z from k where word) where z - i > 2),
t as (select p.doc_id, a, z from p join d using (doc_id) qualify row_number() over (partition by array_to_string(l[a:z], chr(10)) order by p.doc_id, a) > 1),
g as (select distinct doc_id, unnest(range(a, z + 1)) as i from t),
n as (select k.doc_id, count(g.i) as gone, coalesce(string_agg(line, chr(10) order by k.i) filter (g.i is null), '') as kept from k left join g on g.doc_id = k.doc_id and g.i = k.i group by 1)
select d.doc_id, cast(case when none then 0 else len(l) end as bigint) as n_lines, gone as n_removed, sha256(kept) as kept_sha256 from d join n using (doc_id)
"""

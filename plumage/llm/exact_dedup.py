"""Exact dedup by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of ``block_bytes`` bytes. All different blocks are sorted, by a 64-bit key first and by their bytes
where keys agree, and a block's name is its place in that order, a whole number. Adjacent names of a text are then paired, the
different pairs sorted, and a pair's name is its place in turn, until each document has a single name. Two texts of one length
have the same name if and only if their bytes are equal: a number stands for one block or one pair, never for two. Names
depend on the data only, not on partitions, so recomputed tasks agree.

Places come from range partitions: each ranks its own rows, shifted by the counts of those before. Which blocks share a key
without being equal is checked over all blocks, grouped by their bytes; where none do, as nearly always, the bytes take no
further part, and what is sorted and joined are keys and names of 8 bytes for each block.

What moves: each different block of a task once (equal blocks, such as a third of all rows being one text, are combined before
the shuffle), then only keys and names. A document leaves the rounds once it has one name. Nothing is collected beyond
counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, join_split, keep_rows, pick, table
from plumage.operators.aggregate import global_position

BLOCK_BYTES = 1024
#: Rank tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RANKS = 20_000


def _blocks(raw: Column, size: int) -> Column:
    last = F.floor(F.greatest(F.octet_length(raw) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(raw, i * size + 1, F.lit(size)))


def _key(item: Column, bits: int) -> Column:
    return F.xxhash64(item) if bits >= 64 else F.pmod(F.xxhash64(item), F.lit(1 << bits))


def _pairs(names: Column) -> Column:
    """(a, b) of adjacent names; the second of an odd last one is -1, which is no name."""
    last = F.floor((F.size(names) - 1) / 2).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.get(names, i * 2).alias("a"), F.coalesce(F.get(names, i * 2 + 1), F.lit(-1)).alias("b")))


def _keyed(rows: DataFrame, raw: Column, size: int, bits: int, scratch: Scratch) -> DataFrame:
    """``rows`` (_row, ...) with ``items`` for their blocks: (a, b), a key and a rank among the different blocks of that key."""
    items = rows.select("*", _blocks(raw, size).alias("_items"))
    distinct = items.select(F.explode("_items").alias("item")).select(_key(F.col("item"), bits).alias("a"), "item").distinct()
    shared = distinct.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    several = shared.count()
    if not several:
        return items.withColumn("items", F.transform("_items", lambda x: F.struct(_key(x, bits).alias("a"), F.lit(0).cast("long").alias("b")))).drop("_items")
    items = scratch.save(items, "blocks")  # _row must not be numbered twice
    ranks = distinct.join(shared, "a", "left_semi").withColumn("b", F.row_number().over(Window.partitionBy("a").orderBy("item")) - 1).where("b > 0")
    if several <= BROADCAST_RANKS and ranks.count() <= BROADCAST_RANKS:
        ranks = F.broadcast(ranks)
    spots = items.select("_row", F.posexplode("_items").alias("pos", "item")).withColumn("a", _key(F.col("item"), bits))
    spots = spots.join(ranks, ["a", "item"], "left").select("_row", F.struct("pos", "a", F.coalesce("b", F.lit(0)).cast("long").alias("b")).alias("s"))
    arrays = spots.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("s"))  # as many as the row has blocks
    arrays = arrays.select("_row", F.transform("s", lambda s: F.struct(s["a"].alias("a"), s["b"].alias("b"))).alias("items"))
    return items.drop("_items").join(arrays, "_row")


def _named(rows: DataFrame) -> DataFrame:
    """(_row, names) of (_row, items): each item's place among all different items, from 0."""
    spots = rows.select("_row", F.posexplode("items").alias("pos", "s")).select("_row", "pos", "s.a", "s.b")
    names = global_position(spots.select("a", "b").distinct(), "a", "b")
    placed = join_split(spots, names, ["a", "b"]).select("_row", F.struct("pos", (F.col("position") - 1).alias("name")).alias("s"))
    arrays = placed.groupBy("_row").agg(F.array_sort(F.collect_list("s")).alias("s"))  # as many as the row has items
    return arrays.select("_row", F.transform("s", lambda s: s["name"]).alias("names"))


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, key_bits: int = 64) -> DataFrame:
    """One row for each row of ``docs``: _row, doc_id, text_sha256, n_bytes, name (bigint). (n_bytes, name) identify the text.

    A null text counts as empty. ``key_bits`` under 64 makes keys collide, for tests.
    """
    scratch = Scratch(docs.sparkSession)
    raw = F.coalesce(pick(docs, text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), pick(docs, id_col).alias("doc_id"), raw.alias("_raw"))
    rows = _keyed(rows, F.col("_raw"), block_bytes, key_bits, scratch)
    rows = scratch.save(rows.select("_row", "doc_id", F.sha2("_raw", 256).alias("text_sha256"), F.octet_length("_raw").alias("n_bytes"), "items"), "rows")
    now, done, level = scratch.save(_named(rows), "names0"), None, 0
    while True:
        one = now.where("size(names) = 1").select("_row", F.col("names")[0].alias("name"))
        done = one if done is None else done.unionAll(one)
        now = now.where("size(names) > 1")
        if not now.limit(1).count():
            return rows.drop("items").join(done, "_row")
        level += 1
        now = scratch.save(_named(now.select("_row", _pairs(F.col("names")).alias("items"))), f"names{level}")  # half as many names each time


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of ``docs``, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows with equal texts the one with the largest id stays; a null id is the smallest. Null texts are empty texts
    and equal each other. Rows that share id and text are copies too: one of them stays. An empty table gives no rows.
    Columns of ``docs`` other than the two named ones play no part.
    """
    rows = identities(docs, id_col, text_col, **options)
    groups = rows.groupBy("n_bytes", "name").agg(F.max(F.struct("doc_id", "_row")).alias("_keep"), F.count("*").alias("group_size"))
    return join_split(rows, groups, ["n_bytes", "name"]).select(
        "doc_id", F.col("_keep.doc_id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_keep._row")).alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that exact_dedup keeps, with all their columns."""
    kept = exact_dedup(docs, id_col, text_col, **options).where("kept")
    return keep_rows(docs, id_col, text_col, kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE = """
with t as (select doc_id, coalesce(text, '') as text from documents),
g as (select text, max(doc_id) as keep_id, count(*) as group_size from t group by text)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id as kept, sha256(t.text) as text_sha256
from t join g on t.text = g.text
"""

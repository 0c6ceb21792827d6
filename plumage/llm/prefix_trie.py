"""Prefix trie of conversations, merged family first.

Conversations whose ids share a base (the id less its remainder by ``family``) are co-grouped by it: one shuffle brings the base's
turns and those of its family together, as a digest and a number of words for each turn, never as texts. A task reads a
family in order, base first, rebuilds its conversations (the first few turns come from the base) and builds the family's small
trie, a table of nodes by the digest of their path. It hands on combined nodes, one for all of a family's conversations
that meet in it, and does so early where a family grows beyond ``NODES`` nodes, so no group is ever held whole; a global sum
makes the nodes of all families one trie.

Subtrees are summed without a round for each level. The nodes whose smallest member is one conversation form a chain, down
to that conversation's last turn, so a trie is a tree of chains. Chains sum up over their ancestors by doubling: log2 of
how deep chains hang from each other (a few, where most share the root or a first turn) rounds over one row for each chain.
Inside a chain a running sum goes from its last node up. The many children of a common node are counted before they are shuffled.

The list of all conversations that end in a node is put together in blocks of ids, and its digest reads them in order.
Digests of turns and paths have 128 bits, and equal ones count as equal turns and paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, join_split, pick, table, words
from plumage.llm.resampling import CRC_TABLE, crc_sql

FAMILY = 20
#: A conversation takes fewer turns than this from its base.
HEADS = 4
#: Nodes of a family's trie that a task holds at most.
NODES = 50_000
#: Ids of a block have all but this many bits in common.
BLOCK_BITS = 12
ROOT = bytes(16)
NODE = "p binary, parent binary, depth int, n bigint, conv bigint, words int, ends array<bigint>"


def _digest(role: Column, text: Column) -> Column:
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)


def family_nodes(most: int = NODES):
    """An Arrow map from turns (base, conv, h, label, words), sorted by family, base first, to the families' combined nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("p", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("n", pa.int64()), ("conv", pa.int64()), ("words", pa.int32()), ("ends", pa.list_(pa.int64()))])
        trie: dict[bytes, list] = {}
        heads: list[tuple[bytes, int]] = []
        family = conv = at = None  # at: the open conversation's node, as (path, parent, depth, words)
        own = take = 0

        def touch(node: tuple, member: int | None, count: int) -> list:
            found = trie.get(node[0])
            if found is None:
                found = trie[node[0]] = [*node, 0, member, []]
            elif member is not None and (found[5] is None or member < found[5]):
                found[5] = member
            found[4] += count
            return found

        def step(label: bytes, n_words: int) -> None:
            nonlocal at
            at = (blake2b(at[0] + label, digest_size=16).digest(), at[0], at[2] + 1, n_words)
            touch(at, conv, 1)

        def out() -> pa.RecordBatch:
            p, parent, depth, n_words, n, first, ends = zip(*trie.values(), strict=True)
            trie.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((p, parent, depth, n, first, n_words, ends), schema, strict=True)], schema=schema)

        for b in batches:
            for base, c, h, label, n_words in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if at is None or c != conv:
                    if at is not None:
                        touch(at, conv, 0)[6].append(conv)
                    if at is None or base != family:
                        if len(trie) >= 1000:
                            yield out()
                        family, heads = base, []
                    conv, at, own, take = c, (ROOT, None, 0, 0), 0, h if c != base else 0
                    touch(at, conv, 1)
                    for turn in heads[:take]:
                        step(*turn)
                if conv == family and own < HEADS - 1:
                    heads.append((label, n_words))
                if own >= take:
                    step(label, n_words)
                own += 1
                if len(trie) >= most:
                    yield out()
        if at is not None:
            touch(at, conv, 0)[6].append(conv)
            yield out()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(p, sha) of (p, s), sorted by p: the SHA-256 of each p's strings, joined by commas."""
    now, state, done = None, None, []
    for b in batches:
        for p, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if p != now:
                if now is not None:
                    done.append((now, state.digest()))
                now, state = p, sha256(s.encode())
            else:
                state.update(b"," + s.encode())
        if done:
            yield _pairs(done)
            done = []
    if now is not None:
        yield _pairs([(now, state.digest())])


def _pairs(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.binary()) for i in range(2)], ["p", "sha"])


def _chain_sums(chains: DataFrame, root: int | None, scratch: Scratch) -> DataFrame:
    """``chains`` (m, up, at, leaves, saved) with leaves and saved summed over all chains that hang below, by doubling.

    After k rounds a chain has the sums of all less than 2^k below it, and ``far`` is the one 2^k above.
    """
    now, k = chains.withColumn("far", F.col("up")), 0
    while now.where("far is not null").limit(1).count():
        add = now.where("far is not null").groupBy(F.col("far").alias("m")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        added = now.join(add, "m", "left").select("m", "up", "at", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), "far")
        last = F.col("far").isNull() | (F.col("far") == F.lit(root))  # nothing is above the root's chain; its many rows need no join
        jump = now.where("far is not null").select(F.col("m").alias("far"), F.col("far").alias("farther"))
        beyond = join_split(added.where(~last), jump, ["far"], "left").withColumn("far", F.col("farther")).drop("farther")
        ended = added.where(last).withColumn("far", F.lit(None).cast("bigint"))
        k += 1
        now = scratch.save(beyond.select(*ended.columns).unionAll(ended), f"sums{k}")
    return now.drop("far")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", family: int = FAMILY, most: int = NODES) -> DataFrame:
    """One row for each node of the trie of all rebuilt conversations.

    Conversation c starts with the first h turns of its base c - c % family (the remainder has c's sign), all if it has fewer, none
    if it has no rows, h being the CRC-32 of c as text, modulo 4; then its own turns follow, from turn h (counted from 0) on.
    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by ``turn``, a null one first, equal ones by their digest; null roles and texts are empty. Repeated rows are
    turns of their own. Rows with a null conv_id form one conversation without a base; it counts as a member, but its id is
    null only where no other member has one, and an empty text in the list of ends, first in order. An empty table gives no
    rows; other columns play no part. ``most`` bounds the nodes that a task holds and changes no result.
    """
    scratch = Scratch(turns.sparkSession)
    said, by = F.coalesce(pick(turns, text).cast("string"), F.lit("")), F.coalesce(pick(turns, role).cast("string"), F.lit(""))
    t = turns.select(pick(turns, conv).cast("long").alias("conv"), pick(turns, turn).alias("turn"), _digest(by, said).alias("label"), F.size(words(said)).alias("words"))
    t = t.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", (F.crc32(F.coalesce(F.col("conv").cast("string"), F.lit("")).cast("binary")) % HEADS).cast("int"))
    t = t.repartition("base").sortWithinPartitions("base", F.coalesce(F.col("conv") != F.col("base"), F.lit(False)), "conv", F.asc_nulls_first("turn"), "label")
    nodes = scratch.save(t.select("base", "conv", "h", "label", "words").mapInArrow(family_nodes(most), NODE), "families")

    ends = nodes.where("size(ends) > 0").select("p", F.explode("ends").alias("conv")).groupBy("p", F.shiftright("conv", BLOCK_BITS).alias("block"))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("conv"))), lambda x: F.coalesce(x["conv"].cast("string"), F.lit("")))  # a block's ids at most, but for a null id
    ends = ends.agg(F.array_join(ids, ",").alias("s")).repartition("p").sortWithinPartitions("p", F.asc_nulls_first("block"))
    digests = ends.select("p", "s").mapInArrow(_digests, "p binary, sha binary")

    merged = nodes.groupBy("p", "parent", "depth", "words").agg(F.sum("n").alias("n"), F.min("conv").alias("m"))
    merged = scratch.save(merged.join(digests, "p", "left").withColumn("own", (F.col("n") - 1) * F.col("words")), "merged")
    scratch.drop("families")
    root = merged.where("depth = 0").select("m").first()
    if root is None:
        root = (None,)

    # A chain hangs from a node that another conversation has too; where that is the root there is nothing to look up.
    chains = merged.groupBy("m").agg(F.min("depth").alias("from"), F.max("depth").alias("to"), F.sum("own").alias("saved"), F.min_by("parent", "depth").alias("parent"))
    chains = scratch.save(chains, "chains")
    shared = merged.where("n > 1").select(F.col("p").alias("parent"), F.col("m").alias("up"))
    hung = chains.where("`from` < 2").withColumn("up", F.when(F.col("from") == 1, F.lit(root[0]).cast("bigint")))
    hung = hung.unionByName(join_split(chains.where("`from` > 1"), shared, ["parent"]))
    hung = scratch.save(hung.select("m", "up", (F.col("from") - 1).alias("at"), "to", "saved"), "hung")
    below = hung.where("up is not null").groupBy(F.col("up").alias("m"), F.col("at").alias("to")).agg(F.count("*").alias("kids"))
    own = hung.join(below, ["m", "to"], "left").select("m", "up", "at", F.when(F.col("kids").isNull(), 1).otherwise(0).cast("bigint").alias("leaves"), "saved")
    sums = _chain_sums(scratch.save(own, "sums0"), root[0], scratch)

    hang = sums.where("up is not null").select(F.col("up").alias("m"), F.col("at").alias("depth"), F.lit(1).cast("bigint").alias("kids"), "leaves", "saved", F.lit(None).cast("bigint").alias("up"), F.lit(False).alias("top"))
    tops = sums.select("m", (F.col("at") + 1).alias("depth"), *[F.lit(0).cast("bigint").alias(c) for c in ("kids", "leaves", "saved")], "up", F.lit(True).alias("top"))
    side = hang.unionAll(tops).groupBy("m", "depth").agg(*[F.sum(c).alias(c) for c in ("kids", "leaves", "saved")], F.max("up").alias("up"), F.max("top").alias("top"))
    side = side.withColumnsRenamed({"m": "_m", "depth": "_depth"})
    full = merged.join(side, F.col("m").eqNullSafe(F.col("_m")) & (F.col("depth") == F.col("_depth")), "left")
    upwards = Window.partitionBy("m").orderBy(F.desc("depth"))
    running = upwards.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    full = full.fillna(0, ["kids", "leaves", "saved"]).withColumn("k", F.row_number().over(upwards))
    end = F.when((F.col("k") == 1) & (F.col("kids") == 0), 1).otherwise(0)
    return full.select(
        F.col("m").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        F.when(F.col("top"), F.col("up")).when(F.col("depth") > 0, F.col("m")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        (F.col("kids") + F.when(F.col("k") > 1, 1).otherwise(0)).alias("n_children"),
        F.sum(F.col("leaves") + end).over(running).alias("n_leaves"),
        F.sum(F.col("saved") + F.col("own")).over(running).alias("saved_tokens"),
        F.coalesce(F.lower(F.hex("sha")), F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


ORACLE = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations),
u as (select *, row_number() over (partition by conv_id order by turn nulls first, sha256(length(role) || ':' || role || text)) - 1 as i from t),
c as (select conv_id, conv_id - conv_id % {FAMILY} as base, {crc_sql("conv_id::varchar")} % {HEADS} as h from (select distinct conv_id from t) join ({CRC_TABLE}) on true),
b as (select c.conv_id, i, role, text from c join u on u.conv_id = c.base and i < h union all select c.conv_id, i, role, text from c join u on u.conv_id = c.conv_id and i >= h),
r as (select conv_id, row_number() over (partition by conv_id order by i) as d, role, text from b),
p as (select conv_id, d, text, list({{'r': role, 't': text}}) over (partition by conv_id order by d) as path from r union all select conv_id, 0, '', [] from c),
l as (select *, max(d) over (partition by conv_id) as ends from p),
n as (select path, d, min(conv_id) as m, count(*) as n, len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) as words,
  sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (d = ends), '')) as sha from l group by path, d),
o as (select p.conv_id, p.d, m, n, words from p join n on p.path = n.path),
e as (select distinct a.m, a.d, b.m as up from o a join o b on a.conv_id = b.conv_id and b.d = a.d - 1),
k as (select up as m, d - 1 as d, count(*) as kids from e group by all),
s as (select distinct a.m, a.d, b.m as bm, b.d as bd, (b.n - 1) * b.words as own from o a join o b on a.conv_id = b.conv_id and b.d >= a.d),
f as (select s.m, s.d, sum(own)::bigint as saved_tokens, count(*) filter (k.m is null) as n_leaves from s left join k on k.m = bm and k.d = bd group by all)
select n.m as conv_id, n.d as depth, e.up as parent_conv_id, n.n as n_convs, coalesce(kids, 0) as n_children, n_leaves, saved_tokens, sha as ends_sha256
from n left join e on e.m = n.m and e.d = n.d left join k on k.m = n.m and k.d = n.d join f on f.m = n.m and f.d = n.d
"""

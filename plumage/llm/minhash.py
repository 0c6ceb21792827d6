"""Near-duplicate groups by b-bit MinHash.

1. Each text's distinct word shingles give ``bands`` x ROWS minima; a band's minima, hashed together, are its bucket, and
   BITS low bits of every minimum are packed into a signature of a few 64-bit words. Texts with equal shingle sets (equal
   128-bit fingerprints and sizes) become one node, so thousands of copies weigh as one from here on.
2. In each bucket every node is paired with the bucket's node of the smallest number only. The pair's similarity is estimated
   from bit counts of the signatures, corrected for chance agreement of BITS bits; only what lies SIGMAS deviations below
   the threshold goes. What remains is confirmed on the full shingle sets of both texts.
3. Buckets whose nodes aren't all in one component by then go on. First, nodes that can't have a link go: those with too
   many shingles that no other node of such buckets has. Then each bucket's other nodes are paired with its most central
   one, that with the least share of such shingles (in a group of edited copies, the original). The buckets that are still
   mixed are compared in full, but only across components: in cells of at most about 2 x CELL nodes, inside a join whose
   condition is the size bound, the estimate, and a second estimate from FINE one-bit minima, so that no pair is made that
   fails them. No partner, bucket or pair is dropped or capped. Survivors are confirmed in the same way.
4. Components are found by passing minima along the links and jumping pointers, with all tables in Spark.

The number of bands is the least for which a pair at the threshold shares no bucket with a probability under MISS.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, join_split, keep_rows, pick, slices, table, text_digest
from plumage.llm.shingles import mix, shingle_set

SHINGLE = 5
ROWS = 5
BITS = 2
MISS = 1e-8
#: Minima of the finer signature, of one bit each, that the last comparison uses.
FINE = 2048
SIGMAS = 6.0
CELL = 512
_PAIRED = 0x5555555555555555


def bands_for(percent: int) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log1p(-min(0.999, (percent / 100) ** ROWS))))


def _least_matches(n: int, percent: int, bits: int = BITS) -> int:
    """Agreeing minima that a pair at the threshold has, less SIGMAS standard deviations."""
    p = percent / 100 + (1 - percent / 100) / 2**bits
    return math.floor(n * p - SIGMAS * math.sqrt(n * p * (1 - p)))


class Minima:
    """Least values of n hash functions over a set of 64-bit numbers."""

    def __init__(self, n: int):
        seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.flip, self.times = seeds[:n].astype(np.uint32)[:, None], (seeds[n:].astype(np.uint32) | np.uint32(1))[:, None]
        self.n, self.step = n, max(32, 160_000 // n)

    def minima(self, s: np.ndarray) -> np.ndarray:
        x, low = (s >> np.uint64(32)).astype(np.uint32), np.full(self.n, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), self.step):
            h = x[i : i + self.step] ^ self.flip
            h *= self.times
            np.minimum(low, h.min(1), out=low)
        return low


class Hasher(Minima):
    def __init__(self, bands: int, shingle: int):
        super().__init__(bands * ROWS)
        self.bands, self.shingle = bands, shingle

    def rows(self, ids: pa.Array, hashes: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        n, minima, prints = np.zeros(len(texts), np.int64), np.zeros((len(texts), self.n), np.uint32), np.zeros((2, len(texts)), np.uint64)
        for i, t in enumerate(texts):
            s = shingle_set((t.as_py() or "").encode(), self.shingle)
            if len(s):
                n[i], minima[i], prints[0, i], prints[1, i] = len(s), self.minima(s), s.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(s))
        wide = mix(minima.astype(np.uint64) + np.arange(self.n, dtype=np.uint64) * np.uint64(1 << 32))
        keys = mix(wide.reshape(len(texts), self.bands, ROWS).sum(2, dtype=np.uint64)) if len(texts) else wide.reshape(0, self.bands)
        per = 64 // BITS
        low = np.zeros((len(texts), -(-self.n // per) * per), np.uint64)
        low[:, : self.n] = wide & np.uint64(2**BITS - 1)
        words = (low.reshape(len(texts), -1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
        lists = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, m.shape[1]), pa.int32()), pa.array(m.reshape(-1).view(np.int64)))
        return pa.RecordBatch.from_arrays([ids, hashes, pa.array(n), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists(words), lists(keys)], ["doc_id", "h", "n_shingles", "f1", "f2", "sig", "keys"])


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, shingle: int, digest: bool = False) -> DataFrame:
    """One row for each document; ``digest`` adds the text's SHA-256 as ``sha``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = Hasher(bands, shingle)
        for b in slices(batches, 2):
            for i in range(0, b.num_rows, 512):
                part = [c.slice(i, 512) for c in b.columns]
                found = h.rows(*part[:3])
                yield pa.RecordBatch.from_arrays([*found.columns, part[3]], [*found.schema.names, "sha"]) if digest else found

    id_type = docs.schema[id_col].dataType.simpleString()
    text = pick(docs, text_col).cast("string")
    source = docs.select(pick(docs, id_col).alias("doc_id"), F.xxhash64(text), text.alias("text"), *([text_digest(text).alias("sha")] if digest else []))
    return source.mapInArrow(run, f"doc_id {id_type}, h bigint, n_shingles bigint, f1 bigint, f2 bigint, sig array<bigint>, keys array<bigint>{', sha string' if digest else ''}")


def matches(a: Column, b: Column, n: int) -> Column:
    """Agreeing minima of two signatures, by bit counts."""

    def differing(x: Column) -> Column:
        return F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(F.lit(_PAIRED)))

    words = -(-n * BITS // 64)
    return F.lit(n) - sum((differing(a[i].bitwiseXOR(b[i])) for i in range(1, words)), start=differing(a[0].bitwiseXOR(b[0])))


def estimate(a: Column, b: Column, n: int) -> Column:
    """Similarity from two signatures, corrected for agreement by chance."""
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (matches(a, b, n) / F.lit(n) - chance) / (1 - chance))


def linkable(texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """(node, common, rate) of the nodes among (node, f1, n_shingles, t) whose shingles that others have suffice for a link.

    A link needs percent of a set's own shingles in the other set, so a set with more shingles of its own has no link.
    Shingles are counted in one aggregation and one join by shingle: the work grows with the texts, not with pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            sets = [shingle_set(t.as_py().encode(), shingle) for t in b.column(2)]
            sets = [s if s.sum(dtype=np.uint64).view(np.int64) == f.as_py() else s[:0] for s, f in zip(sets, b.column(1))]
            nodes = np.repeat(b.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], ["node", "s"])

    each = texts.select("node", "f1", "t").mapInArrow(run, "node bigint, s bigint")
    shared = each.groupBy("s").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x < y").select("s")
    counts = join_split(each, shared, ["s"]).groupBy("node").agg(F.countDistinct("s").alias("n"))
    sizes = texts.select("node", "n_shingles").distinct()
    return counts.join(sizes, "node").where(F.col("n") * 100 >= F.col("n_shingles") * percent).select("node", F.col("n").alias("common"), (F.col("n") / F.col("n_shingles")).alias("rate"))


def fine_signatures(texts: DataFrame, n: int, shingle: int) -> DataFrame:
    """(node, fine) of (node, f1, n_shingles, t): one low bit of each of n minima, packed into 64-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Minima(n)
        for b in slices(batches, 1):
            found = []
            for t in b.column(1):
                wide = mix(m.minima(shingle_set(t.as_py().encode(), shingle)).astype(np.uint64) + np.arange(n, dtype=np.uint64) * np.uint64(1 << 32))
                bits = (wide & np.uint64(1)).reshape(-1, 64) << np.arange(64, dtype=np.uint64)
                found.append(bits.sum(1, dtype=np.uint64).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["node", "fine"])

    return texts.select("node", "t").mapInArrow(run, "node bigint, fine array<bigint>")


def texts_of(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, f1, n_shingles, t) of the nodes (node, id, h, f1, n_shingles): the text t of one row with the node's id and hash.

    Rows that are equal in id and text count once, so repeated rows don't multiply what follows.
    """
    rows = docs.withColumnsRenamed({"id": "_id", "h": "_h"})
    found = nodes.join(rows, F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("node", "f1", "n_shingles", "t")
    one = F.row_number().over(Window.partitionBy("node").orderBy("f1"))  # with the filter, Spark keeps one row of each task before it shuffles
    return found.withColumn("_n", one).where("_n = 1").drop("_n")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs (a, b: structs of nodes) whose full shingle sets are similar enough, as (a, b) of node numbers.

    texts has each node's text once; one with another fingerprint would be passed over.
    """
    texts = texts.select(F.col("node").alias("_node"), "t")
    with_b = pairs.join(texts, F.col("b.node") == F.col("_node")).select("a", "b", F.col("t").alias("tb"))
    both = with_b.join(texts, F.col("a.node") == F.col("_node")).select(
        F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.f1").alias("fa"), F.col("b.f1").alias("fb"), F.col("t").alias("ta"), "tb"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # rows come sorted by the first node
        for batch in slices(batches, 5):
            a, b, fa, fb, ta, tb = batch.columns
            ok = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                key = a[i].as_py()
                if key != last:
                    last, kept = key, shingle_set(ta[i].as_py().encode(), shingle)
                y = shingle_set(tb[i].as_py().encode(), shingle)
                if kept.sum(dtype=np.uint64).view(np.int64) == fa[i].as_py() and y.sum(dtype=np.uint64).view(np.int64) == fb[i].as_py():
                    common = len(np.intersect1d(kept, y, assume_unique=True))
                    ok[i] = 100 * common >= percent * (len(kept) + len(y) - common)
            found = pa.array(ok)
            yield pa.RecordBatch.from_arrays([a.filter(found), b.filter(found)], ["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node that it can reach."""
    both = scratch.save(links.select("a", "b").unionAll(links.select("b", "a")).toDF("a", "b").distinct(), f"{name}-links")
    now = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("comp")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        lower = now.join(near, "node").select("node", F.col("comp").alias("was"), F.least("comp", "m").alias("comp"))
        heads = now.select(F.col("node").alias("comp"), F.col("comp").alias("head"))
        jumped = lower.join(heads, "comp").select("node", "was", F.least("comp", "head").alias("comp"))
        saved = scratch.save(jumped, f"{name}-{step}")
        moved = saved.where("was <> comp").limit(1).count()
        scratch.drop(f"{name}-{step - 1}")
        now = saved.select("node", "comp")
        if not moved:
            return now


def linked(nodes: DataFrame, whole: DataFrame, scratch: Scratch, n: int, percent: int, shingle: int) -> DataFrame:
    """(node, comp) of the nodes that have links, in the phases 2 to 4; a phase that finds nothing left to compare is the last."""
    least = _least_matches(n, percent)
    slim = nodes.select("node", "id", "h", "f1", "n_shingles", "sig")
    spots = nodes.select("node", F.explode("keys").alias("key"))
    buckets = spots.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("first")).where("n > 1")
    shared = scratch.save(join_split(spots, buckets, ["key"]).select("key", "node", "first"), "shared")

    side = lambda p: F.struct(*[F.col(f"{p}.{c}").alias(c) for c in ("node", "f1")]).alias(p)
    ends = lambda pairs: pairs.select("a.node").unionAll(pairs.select("b.node")).distinct()

    def similar(a: str, b: str) -> Column:
        sizes = (F.col(f"{a}.n_shingles") * 100 >= F.col(f"{b}.n_shingles") * percent) & (F.col(f"{b}.n_shingles") * 100 >= F.col(f"{a}.n_shingles") * percent)
        return sizes & (matches(F.col(f"{a}.sig"), F.col(f"{b}.sig"), n) >= least)

    pairs = shared.where("first <> node").select(F.col("first").alias("p"), F.col("node").alias("q")).distinct()
    firsts = pairs.join(slim.alias("b"), F.col("q") == F.col("b.node")).join(slim.alias("a"), F.col("p") == F.col("a.node")).where(similar("a", "b"))
    firsts = scratch.save(firsts.select(side("a"), side("b")), "firsts")
    first_texts = scratch.save(texts_of(slim.join(ends(firsts), "node"), whole), "first-texts")
    links = scratch.save(confirmed(firsts, first_texts, percent, shingle), "links")
    scratch.drop("first-texts")
    comps = components(links, scratch, "first")

    def mixed(rows: DataFrame) -> DataFrame:
        """The rows of buckets (key, node, ...) whose nodes aren't all in one component, with comp and size."""
        spread = rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        keys = spread.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
        return join_split(spread, keys, ["key"])

    open_ = scratch.save(mixed(shared.select("key", "node")).select("key", "node"), "open")
    if not open_.limit(1).count():
        return comps
    texts = scratch.save(texts_of(slim.join(open_.select("node").distinct(), "node"), whole), "texts")
    able = scratch.save(linkable(texts, percent, shingle), "able")
    open_ = open_.join(able, "node")
    if not able.limit(1).count():
        return comps

    def possible() -> Column:
        """Of a and b: whether what others share of them suffices, and similar() holds."""
        most = F.least("a.common", "b.common")
        return (most * 100 >= (F.col("a.n_shingles") + F.col("b.n_shingles") - most) * percent) & similar("a", "b")

    central = mixed(open_).groupBy("key").agg(F.max(F.struct("rate", "common", "node")).alias("best"))
    pairs = join_split(mixed(open_), central, ["key"]).where("node <> best.node").select(F.col("best.node").alias("p"), F.col("node").alias("q")).distinct()
    known = slim.join(able, "node")
    stars = pairs.join(known.alias("b"), F.col("q") == F.col("b.node")).join(known.alias("a"), F.col("p") == F.col("a.node")).where(possible())
    stars = scratch.save(stars.select(side("a"), side("b")), "stars")
    if stars.limit(1).count():
        links = links.unionAll(scratch.save(confirmed(stars, texts, percent, shingle), "star-links"))
        comps = components(links, scratch, "second")

    open_ = scratch.save(mixed(open_).select("key", "node", "comp", "common", "size"), "last")
    if not open_.limit(1).count():
        return comps
    of_node = open_.groupBy("node").agg(F.collect_set("key").alias("ks"))  # as many as there are bands, at most
    cells = F.ceil(F.col("size") / CELL).cast("int")
    open_ = open_.withColumn("own", F.pmod(F.xxhash64("node"), cells).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), cells - 1)))
    # a row of block x takes part in the cells (x, y) and (y, x) of all y, written with the smaller first
    open_ = open_.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "comp", "node", "common").join(slim, "node")
    fine = fine_signatures(texts.join(open_.select("node").distinct(), "node", "left_semi"), FINE, shingle)
    open_ = open_.join(scratch.save(fine, "fine"), "node").join(of_node, "node")
    a, b = open_.alias("a"), open_.alias("b")
    cell = (F.col("a.key") == F.col("b.key")) & (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    apart = (F.col("a.i") == F.col("a.j")) | (F.col("a.own") != F.col("b.own"))
    differ = F.aggregate(F.zip_with("a.fine", "b.fine", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
    close = F.lit(FINE) - differ >= _least_matches(FINE, percent, 1)
    once = F.array_min(F.array_intersect("a.ks", "b.ks")) == F.col("a.key")  # a pair counts in its first common bucket
    rest = a.join(b, cell & apart & (F.col("a.node") < F.col("b.node")) & (F.col("a.comp") != F.col("b.comp")) & possible() & close & once)
    rest = scratch.save(rest.select(side("a"), side("b")).distinct(), "rest")
    if rest.limit(1).count():
        more = scratch.save(confirmed(rest, texts, percent, shingle), "more")
        if more.limit(1).count():
            comps = components(links.unionAll(more), scratch, "third")
    return comps


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their shingle sets have 100 * intersection >= percent * union; component_id is the smallest
    id that links reach, kept says whether that is the row's own. A text without words (null, empty) has no shingle and is
    alone. Rows that share an id share its fate only through their texts; null ids come last, so such a row is kept only
    where its component has no other id. An empty table gives no rows; other columns play no part.
    """
    component = F.col("component_id")
    return _grouped(docs, id_col, text_col, percent, shingle).select("doc_id", "n_shingles", component, component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, percent: int, shingle: int, digest: bool = False) -> DataFrame:
    """Of each row doc_id, n_shingles, component_id, comp (the component's number, null without words) and, if asked for, sha."""
    scratch = Scratch(docs.sparkSession)
    bands = bands_for(percent)
    signed = scratch.save(signatures(docs, id_col, text_col, bands, shingle, digest), "signed")
    print_ = ["n_shingles", "f1", "f2"]
    nodes = signed.where("n_shingles > 0").groupBy(*print_).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h")).alias("m"), F.any_value("sig").alias("sig"), F.any_value("keys").alias("keys"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), F.col("m.doc_id").alias("id"), "m.h", *print_, "sig", "keys"), "nodes")
    # ids may repeat or be null, so a node's text is the one of its first id and of that row's hash
    text = pick(docs, text_col).cast("string")
    whole = docs.select(pick(docs, id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("t")).where("t is not null")
    comps = linked(nodes, whole, scratch, bands * ROWS, percent, shingle)

    # the result reads no more than signed, nodes and the last components
    scratch.drop("shared", "firsts", "first-texts", "links", "open", "texts", "able", "stars", "star-links", "last", "fine", "rest", "more", "first-links", "second-links", "third-links")
    named = nodes.select("node", "id", *print_).join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    heads = named.groupBy("comp").agg(F.min("id").alias("component_id"))
    named = join_split(named, heads, ["comp"]).select(*print_, "comp", "component_id")
    sha = ["sha"] if digest else []
    out = signed.select("doc_id", *sha, *print_).join(named, print_, "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), "comp", *sha)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = SHINGLE) -> DataFrame:
    """One row of ``docs`` for each component, with all its columns: that of the smallest id, null ids last.

    Of rows of a component that share this id, that with the smallest SHA-256 stays. A text without words is alone; of
    rows equal in id and text, one stays.
    """
    rows = _grouped(docs, id_col, text_col, percent, shingle, digest=True)
    worded = rows.where("n_shingles > 0").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("m"))
    kept = worded.select(F.col("m.doc_id").alias("_id"), F.col("m.sha").alias("_sha"))
    alone = rows.where("n_shingles = 0").select("doc_id", "sha").distinct()
    return keep_rows(docs, id_col, text_col, kept.unionAll(alone))


def op3_minhash(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"), percent=85)


ORACLE = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct([array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)])
                                 when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
l as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from d union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(max(n.n), 0) as n_shingles, min(r.b) as component_id, d.doc_id = min(r.b) as kept
from d join r on r.a = d.doc_id left join n on n.doc_id = d.doc_id group by d.doc_id
"""

"""Substring dedup over suffix trees that are split by common words, of variable length.

A suffix matters only if it begins a repeated window (``window`` consecutive words), so the suffixes of all texts are thinned
out first. The anchor of a window is the smallest GRAM-word hash in it; equal windows have equal anchors at equal places.
Windows with one anchor follow each other: a run. A run's suffixes are those that start at its windows.

1. Runs with equal words are told by a 128-bit digest. One that a smaller id has goes as a whole, so copies and passages that
   thousands of documents share come down to one run each, by an aggregation that combines before the shuffle.
2. What remains is grouped by words that all of a run's windows have in common, at a place that the words themselves give: at
   first the GRAM words of the anchor. (A split by the words that suffixes start with would need a row for each suffix.) A
   group with one document can't repeat anything. One of at most GROUP_BYTES of different runs is a subtree that fits in memory.
3. A larger group's common words are lengthened: runs are cut into two halves by where their suffixes start, which share 29 words of
   50, then into four (40 words), and so on, and each piece goes through steps 1 and 2 again. The last pieces are single windows,
   which have all their words in common; equal ones are then one run, so nothing is left to compare, however common a passage is.
   What one text repeats, alike or in other surroundings that were cut off since, is one row with all its places.
4. In a subtree all words have ranks over 1, 2, 4, ... words; they give the order of the suffixes and the words that neighbours
   have in common. Neighbours that share a window are leaves below one deep internal node, and its smallest id is the only one
   that keeps the window. Adjoining windows make up the maximal repeats, which are the stretches that go.

No group is cut off, dropped or handled by another rule at any size; GROUP_BYTES changes how often step 3 runs, not what
comes out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, join_split, pick, slices, table, whole_row
from plumage.llm.shingles import rolled, word_hashes_many

WINDOW = 50
GRAM = 8
#: Bytes of words of a group that is ranked in memory, which takes about 30 times as much. A group is one task's.
GROUP_BYTES = 1 << 18
#: Words ranked together, where groups allow.
BATCH_WORDS = 500_000
#: Bytes of text hashed together.
CHUNK = 1 << 18
_LAST = (1 << 63) - 1


def runs(h: np.ndarray, which: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor, first window, last window) of each run of windows with one anchor; no window spans two texts.

    h, which: hash and text of each word, the texts in a row. Windows and anchors are given by the place of their first word.
    """
    g = rolled(h, GRAM)
    n = len(h) - window + 1
    e = np.empty(0, np.int64)
    if n <= 0:
        return g[:0], e, e, e
    span = window - GRAM + 1  # grams in a window
    best, size = np.arange(len(g)), 1
    while size * 2 <= span:  # leftmost smallest of the next `size` grams, by doubling
        a, b = best[: len(best) - size], best[size:]
        best, size = np.where(g[b] < g[a], b, a), size * 2
    a, b = best[:n], best[span - size : span - size + n]
    best = np.where(g[b] < g[a], b, a)
    whole = np.flatnonzero(which[:n] == which[window - 1 :])
    if not len(whole):
        return g[:0], e, e, e
    new = np.flatnonzero((np.diff(best[whole], prepend=-1) != 0) | (np.diff(whole, prepend=-2) != 1))
    return g[best[whole[new]]], best[whole[new]], whole[new], whole[np.append(new[1:], len(whole)) - 1]


def digest(words: bytes) -> bytes:
    return hashlib.blake2b(words, digest_size=16).digest()


def _plain(text: pa.Scalar) -> bytes:
    """A text's words joined by single spaces."""
    return b" ".join((text.as_py() or "").encode().split())  # at the six ASCII separators


def _chunks(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of stretches of about CHUNK bytes."""
    part, size, at = [], 0, 0
    for i, t in enumerate(texts):
        part.append(_plain(t))
        size += len(part[-1])
        if size >= CHUNK:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def _runs(window: int):
    """Of (o, h, text): o, h, p and last (first and last window), j (the anchor from p on), k (anchor hash), d (digest), size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            for at, raws in _chunks(b.column(2)):
                h, starts, ends, which = word_hashes_many(raws, False)
                begin = np.searchsorted(which, np.arange(len(raws)))  # each text's first word
                g, anchor, first, last = runs(h, which, window)
                text = which[first]
                words = [raws[t][s:e] for t, s, e in zip(text.tolist(), starts[first].tolist(), ends[last + window - 1].tolist())]
                take, local = pa.array(at + text), begin[text]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), *(pa.array(x, pa.int32()) for x in (first - local, last - local, anchor - first)),
                     pa.array(g.view(np.int64)), pa.array(map(digest, words), pa.binary()), pa.array(map(len, words), pa.int32())],
                    ["o", "h", "p", "last", "j", "k", "d", "size"],
                )

    return run


def marked(rows: DataFrame, group_bytes: int) -> DataFrame:
    """``rows`` (o, k, d, size, ...) with ``kind``: 0 where a smaller o has the same k and d, 1 where k's group fits in memory, else 2.

    Rows that are neither repeated nor in a group of several documents are left out, as are d and size. Both joins are by keys of
    which one may be very common; join_split lets Spark split those.
    """
    spans = rows.groupBy("k", "d").agg(F.min("o").alias("m"), F.max("o").alias("top"), F.max("size").alias("size"))
    groups = spans.groupBy("k").agg(F.min("m").alias("lo"), F.max("m").alias("hi"), F.sum("size").alias("bytes")).where("lo < hi")
    info = join_split(spans, groups.select("k", F.when(F.col("bytes") > group_bytes, 2).otherwise(1).alias("kind")), ["k"], "left")
    info = info.where("kind is not null or m < top").select("k", "d", "m", F.coalesce("kind", F.lit(0)).alias("kind"))
    found = join_split(rows, info, ["k", "d"]).withColumn("kind", F.when(F.col("o") > F.col("m"), 0).when(F.col("kind") > 0, F.col("kind")))
    return found.where("kind is not null").drop("d", "m", "size")


def _words(window: int):
    """Of (o, h, text, asked): each different asked run (j, k, kind) with its words and the windows (ps) that it starts at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            rows = []
            for o, h, t, asked in zip(*b.columns):
                words, own = _plain(t).split(), {}
                for r in asked.as_py():
                    own.setdefault((r["j"], r["k"], r["kind"], b" ".join(words[r["p"] : r["last"] + window])), []).append(r["p"])
                rows += [(o.as_py(), h.as_py(), ps, *key) for key, ps in own.items()]
            if rows:
                types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["o", "h", "ps", "j", "k", "kind", "words"])

    return run


def pieces(words: list[bytes], j: int, parts: int, window: int) -> Iterator[tuple[int, int, int, list[bytes]]]:
    """A run cut into parts by the anchor's place in its windows: (first window, last window, part, common words) of each piece.

    With each come the words that all windows of the part have in common, those that this run doesn't have included.
    """
    span = window - GRAM + 1
    n = len(words) - window + 1
    low = [-(-part * span // parts) for part in range(parts + 1)]  # the least place of the anchor in each part's windows
    for part in range(parts):
        first, last = max(0, j - (low[part + 1] - 1)), min(n - 1, j - low[part])
        if first <= last:
            yield first, last, part, words[j - low[part] : j - (low[part + 1] - 1) + window]


def _pieces(window: int, parts: int):
    """Of runs (o, h, ps, j, words): their pieces o, h, ps, n (windows after the first), j, k (digest of part and common words), d, size, words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            rows = []
            for o, h, ps, j, w in zip(*(c.to_pylist() for c in b.columns)):
                words = w.split(b" ")
                for first, last, part, common in pieces(words, j, parts, window):
                    own = b" ".join(words[first : last + window])
                    rows.append((o, h, [p + first for p in ps], last - first, j - first, digest(b"%d/%d " % (part, parts) + b" ".join(common)), digest(own), len(own), own))
            if rows:
                types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["o", "h", "ps", "n", "j", "k", "d", "size", "words"])

    return run


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (o, h, ps, n, j, k, words, kind) of one text that are the same piece, as one row with all its windows, batch by batch.

    A text that repeats a passage in many surroundings has the same piece many times once the surroundings are cut off.
    """
    for b in batches:
        own: dict[tuple, list[int]] = {}
        for o, h, ps, *key in zip(*(c.to_pylist() for c in b.columns)):
            own.setdefault((o, h, *key), []).extend(ps)
        rows = [(o, h, ps, *key) for (o, h, *key), ps in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), b.schema)], schema=b.schema)


def suffix_order(parts: list[list[bytes]], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, place, common) of every suffix that is a window long, in their order; common: words shared with the one before.

    Words past a part's end aren't compared, so ``common`` ends there, and it isn't counted beyond twice a power of two
    under ``window``.
    """
    sizes = np.array([len(p) for p in parts])
    total = int(sizes.sum())
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for p in parts for w in p), np.int64, total)
    part = np.repeat(np.arange(len(parts)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)  # each word's part's end
    at = np.flatnonzero(end - np.arange(total) >= window)
    levels = [flat]  # levels[k]: rank of the 2**k words from each place; those past a part's end aren't used
    while 2 ** len(levels) <= window:
        last, depth = levels[-1], 2 ** (len(levels) - 1)
        pair = last[: len(last) - depth] * (int(last.max(initial=0)) + 1) + last[depth:]
        levels.append(np.unique(pair, return_inverse=True)[1])
    depth = 2 ** (len(levels) - 1)
    at = at[np.lexsort((levels[-1][at + window - depth], levels[-1][at]))]
    common = np.zeros(len(at), np.int64)
    a, b = at[:-1], at[1:]
    for k in range(len(levels) - 1, -1, -1):
        n, more = 2**k, common[1:]
        inside = np.maximum(a, b) + more + n <= total
        x, y = np.where(inside, a + more, 0), np.where(inside, b + more, 0)
        common[1:] += n * (inside & (x + n <= end[a]) & (y + n <= end[b]) & (levels[k][x] == levels[k][y]))
    return part[at], at - (end - sizes[part])[at], common


def _ranked(window: int):
    """Rows come with all of a group in a row. Gives the stretches (o, h, ps, first, last) of windows that an earlier document has.

    first and last count from each of ps. Equal windows have equal anchors and common words, so no node spans two groups.
    """

    def done(rows: list[tuple]) -> pa.RecordBatch:
        o, h, ps, _, words = zip(*rows)
        order = np.array(o, np.int64)
        part, place, common = suffix_order([w.split(b" ") for w in words], window)
        node = np.cumsum(common < window) - 1  # neighbours that share a window lie below one deep internal node
        least = np.full(int(node.max(initial=-1)) + 1, _LAST)
        np.minimum.at(least, node, order[part])
        again = least[node] < order[part]
        part, start = part[again], place[again]
        sort = np.lexsort((start, part))
        part, start = part[sort], start[sort]
        new = np.flatnonzero((np.diff(part, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
        last = start[np.append(new[1:], len(start)) - 1] if len(new) else start
        own = part[new]
        columns = [pa.array(order[own]), pa.array([h[i] for i in own], pa.int64()), pa.array([ps[i] for i in own], pa.list_(pa.int32())), pa.array(start[new], pa.int32()), pa.array(last, pa.int32())]
        return pa.RecordBatch.from_arrays(columns, ["o", "h", "ps", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BATCH_WORDS and row[3] != rows[-1][3]:
                    yield done(rows)
                    rows, size = [], 0
                rows.append(row)
                size += row[4].count(b" ") + 1
        if rows:
            yield done(rows)

    return run


def _kept(window: int, digested: bool):
    """Of (id, text, gone, ...): takes out what the windows cover; any column after the first three is passed on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            n, removed, out = [], [], []
            for t, s in zip(b.column(1), b.column(2)):
                words = (t.as_py() or "").encode().split()
                n.append(len(words))
                if s.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, s.values.field("first").to_numpy(), 1)
                    np.add.at(cover, s.values.field("last").to_numpy() + window, -1)
                    words = list(compress(words, np.cumsum(cover[:-1]) == 0))
                text = b" ".join(words)
                removed.append(n[-1] - len(words))
                out.append(hashlib.sha256(text).hexdigest() if digested else (text.decode() if removed[-1] else t.as_py()))
            columns = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), *b.columns[3:]]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_removed", "kept", *b.schema.names[3:]])

    return run


def numbered(docs: DataFrame, id_col: str, scratch: Scratch) -> tuple[DataFrame, Column | None]:
    """(_o, row) of ``docs``: its rows as structs, with a bigint that orders them as their ids do, null ids last; and the ids in terms of ``o``, if they can be told.

    Whole numbers order themselves. Ids of any other type are numbered by range partitions of their distinct values.
    """
    own = pick(docs, id_col)
    kind = docs.schema[id_col].dataType.simpleString()
    if kind in ("tinyint", "smallint", "int", "bigint"):
        top, nulls = docs.agg(F.max(own), F.count_if(own.isNull())).first()
        if top != _LAST or not nulls:  # else nulls need a number beyond the largest
            back = (F.when(F.col("o") != _LAST, F.col("o")) if nulls else F.col("o")).cast(kind)
            return docs.select(F.coalesce(own.cast("bigint"), F.lit(_LAST)).alias("_o"), whole_row(docs).alias("row")), back
    ids = docs.select(own.alias("_id")).where("_id is not null").distinct()
    ids = scratch.save(ids.repartitionByRange("_id").withColumn("_part", F.spark_partition_id()), "ids")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    ahead = ids.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_id"))
    ids = ids.withColumn("_k", place).join(F.broadcast(ahead), "_part").select("_id", (F.col("_k") + F.col("_ahead")).alias("_o"))
    rows = docs.select(own.alias("_id"), whole_row(docs).alias("row"))
    return join_split(rows, ids, ["_id"], "left").select(F.coalesce("_o", F.lit(_LAST)).alias("_o"), "row"), None


def repeats(source: DataFrame, window: int, group_bytes: int, scratch: Scratch) -> DataFrame:
    """(o, h, gone): of each text (o, h, text) the stretches (first, last) of windows that a smaller o has."""
    all_runs = scratch.save(source.mapInArrow(_runs(window), "o bigint, h bigint, p int, last int, j int, k bigint, d binary, size int"), "runs")
    found = scratch.save(marked(all_runs, group_bytes), "marked")
    scratch.drop("runs")
    gone = found.where("kind = 0").select("o", "h", F.col("p").alias("first"), "last")
    moved = lambda df, first, last: df.withColumn("p", F.explode("ps")).select("o", "h", (F.col("p") + first).alias("first"), (F.col("p") + last).alias("last"))
    asked = found.where("kind > 0").groupBy("o", "h").agg(F.collect_set(F.struct("p", "last", "j", "k", "kind")).alias("asked"))  # as many as the text has
    one = F.row_number().over(Window.partitionBy("o", "h").orderBy("o"))  # rows equal in id and text are asked once
    texts = join_split(source, asked, ["o", "h"]).withColumn("n", one).where("n = 1").select("o", "h", "text", "asked")
    open_ = scratch.save(texts.mapInArrow(_words(window), "o bigint, h bigint, ps array<int>, j int, k bigint, kind int, words binary"), "open")
    tree = lambda df, label: df.where("kind = 1").select("o", "h", "ps", label.alias("k"), "words")
    trees, open_ = tree(open_, F.col("k").cast("string")), open_.where("kind = 2")
    parts, span = 1, window - GRAM + 1
    while parts < span and open_.limit(1).count():
        parts = min(2 * parts, span)
        cut = open_.select("o", "h", "ps", "j", "words").mapInArrow(_pieces(window, parts), "o bigint, h bigint, ps array<int>, n int, j int, k binary, d binary, size int, words binary")
        now = marked(cut, group_bytes).select("o", "h", "ps", "n", "j", "k", "words", "kind")
        now = scratch.save(now.mapInArrow(_folded, now.schema), f"pieces{parts}")
        gone, trees, open_ = gone.unionAll(moved(now.where("kind = 0"), F.lit(0), F.col("n"))), trees.unionAll(tree(now, F.hex("k"))), now.where("kind = 2")
    ranked = trees.repartition("k").sortWithinPartitions("k").mapInArrow(_ranked(window), "o bigint, h bigint, ps array<int>, first int, last int")
    return gone.unionAll(moved(ranked, F.col("first"), F.col("last"))).groupBy("o", "h").agg(F.collect_set(F.struct("first", "last")).alias("gone"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES, digest: bool = False, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, kept.

    A word goes if a window of ``window`` words that covers it also starts in a row with a smaller id; windows are judged on
    the input. kept is the text: unchanged if nothing went, else its remaining words joined by spaces; with ``digest``, the
    SHA-256 of the remaining words joined by spaces. Null texts have no words (their text stays null). Ids may have any type
    that sorts; a null id is larger than all others. Rows that share an id don't count as earlier than each other. Texts
    under ``window`` words lose nothing. An empty table gives no rows; other columns play no part and are lost, unless
    ``carry`` adds all columns but the text as the struct ``row``.
    """
    scratch = Scratch(docs.sparkSession)
    other = [c for c in docs.columns if c != text_col]
    kind = docs.schema[id_col].dataType
    rows, back = numbered(docs, id_col, scratch)
    column = lambda c: F.col("row").getField(c)
    text = column(text_col).cast("string")
    source = rows.select(F.col("_o").alias("o"), F.xxhash64(text).alias("h"), text.alias("text"))
    gone = repeats(source, window, group_bytes, scratch)
    more = []
    if carry or back is None:  # else both fetches of the texts use one shuffle of them (Spark reuses it)
        row = F.struct(*[column(c).alias(c) for c in other]) if carry else F.struct(column(id_col).alias("_id"))
        source = rows.select(F.col("_o").alias("o"), F.xxhash64(text).alias("h"), text.alias("text"), row.alias("row"))
        back, more = column(id_col if carry else "_id"), ["row"] if carry else []
    out = join_split(source, gone, ["o", "h"], "left").select(back.alias("id"), "text", "gone", *more)
    schema = StructType([StructField("id", kind), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept", StringType())])
    schema = StructType([*schema, *([out.schema["row"]] if carry else [])])
    return out.mapInArrow(_kept(window, digest), schema)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``docs`` with the repeated words taken out of the texts; all rows and columns stay, null ids too."""
    found = substring_dedup(docs, id_col, text_col, window, group_bytes, carry=True)
    return found.select(*[(F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns])


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = substring_dedup(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnsRenamed({"id": "doc_id", "kept": "kept_sha256"})


ORACLE = """
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
p as (select doc_id, i, array_to_string(w[i : i + 49], ' ') as s from d, unnest(range(1, len(w) - 48)) as r(i)),
q as (select doc_id, i from p qualify doc_id > min(doc_id) over (partition by s)),
k as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
c as (select k.doc_id, k.i, k.word, exists (select 1 from q where q.doc_id = k.doc_id and k.i between q.i and q.i + 49) as gone from k),
g as (select doc_id, cast(count(*) filter (gone) as bigint) as n_removed, coalesce(string_agg(word, ' ' order by i) filter (not gone), '') as kept from c group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join g using (doc_id)
"""

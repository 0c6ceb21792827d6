"""Best-fit packing of tokenised documents into sequences of several permitted lengths.

A document's tokens are those of a byte-level BPE vocabulary, whose ids give every byte of the text back, and one end mark.
Documents above the largest length are cut into parts of that length and a rest.

The rule is best fit over the whole corpus, longest part first: a part goes into the open bin with the least room that
takes it (of equal rooms the longer bin, then the older one). If none takes it, a bin is opened whose length costs least
for each token that the parts still to come could fill it with, over all permitted lengths. At last each bin shrinks to
the least permitted length that holds its contents.

The rule sees nothing of a part but its size, so the driver applies it to the table of sizes (as many rows as the largest
length, whatever the corpus) and moves parts of one size and bins in one state together. What comes out is a list of runs:
the parts of a size from one rank on go to consecutive bins, so many each, at one place. Its size depends on the lengths,
not on the corpus, so it can be broadcast. Spark ranks the parts of each size by a hash of id and tokens, inside buckets of
that hash and shifted by the counts of the buckets before, looks the runs up, and puts each bin's parts together. No result
depends on how rows lie in files or partitions, and no size, however common, meets in one task.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, pick, slices, table

LENGTHS = (512, 1024, 2048, 4096)
#: Cost of a bin besides its length, in tokens.
OVERHEAD = 64
#: The vocabulary of pack() and its end mark, an id that no text gives.
VOCABULARY = "byte_bpe_50k.tiktoken"
END = 50256
#: Parts of one size that a bucket of hashes holds at most, about: 8 MB of the largest ones.
BUCKET_ROWS = 1000
_RANKS = 46


def bin_cost(size: int, length: int, rest: int, overhead: int) -> float:
    """Cost for each token of a new bin for a part, if parts of ``rest`` tokens in all still fit beside it."""
    return (overhead + length) / (size + min(length - size, rest))


def plan_bins(counts: dict[int, int], lengths: tuple[int, ...], overhead: int) -> list[tuple[int, int, int, int, int, int]]:
    """Runs (size, first rank, bins, parts for each bin, first bin, place in the bin) of the rule above, from counts by size."""
    runs, rooms, groups, n_bins = [], [], {}, 0  # groups: by room, a heap of (-length, first bin, bins)
    below = list(accumulate([0, *(s * counts.get(s, 0) for s in range(1, lengths[-1] + 1))]))  # tokens of the parts up to a size

    def keep(room: int, length: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            heappush(groups[room], (-length, first, n))

    for size in sorted(counts, reverse=True):
        n, done = counts[size], 0
        smaller = below[size - 1]
        wide = [c for c in lengths if c >= 2 * size]
        even = 1 + max(0, -(-(wide[-1] - size - smaller) // size)) if wide else 1  # with so many parts left, the choice is the same
        while done < n:
            left = n - done
            k = bisect_left(rooms, size)
            if k < len(rooms):
                room = rooms[k]
                length, first, m = heappop(groups[room])
                length = -length
                if not groups[room]:
                    del groups[room], rooms[k]
            else:
                rest = lambda c: (left - 1) * size + smaller if c >= 2 * size else below[c - size]  # noqa: B023, E731
                length = room = min((c for c in lengths if c >= size), key=lambda c: (bin_cost(size, c, rest(c), overhead), c))
                each = room // size
                m = min(-(-left // each), 1 + max(0, left - even) // each)
                first, n_bins = n_bins, n_bins + m
            each = room // size
            full = min(m, left // each)
            if full:
                runs.append((size, done, full, each, first, length - room))
                done += full * each
                keep(room - each * size, length, first, full)
            rest_ = min(n - done, each) if full < m else 0
            if rest_:
                runs.append((size, done, 1, rest_, first + full, length - room))
                done += rest_
                keep(room - rest_ * size, length, first + full, 1)
            keep(room, length, first + full + (rest_ > 0), m - full - (rest_ > 0))
    return runs


def _placer(runs: list[tuple[int, ...]]):
    """A column function (size, rank from 0) that gives bin and place."""
    size, rank, _, each, first, at = np.array(sorted(runs) or [(0,) * 6], np.int64).T
    keys = (size << _RANKS) + rank

    @F.pandas_udf("bin bigint, at int")
    def place(s: pd.Series, r: pd.Series) -> pd.DataFrame:
        k = np.searchsorted(keys, (s.to_numpy(np.int64) << _RANKS) + r.to_numpy(np.int64), "right") - 1
        over = r.to_numpy(np.int64) - rank[k]
        return pd.DataFrame({"bin": first[k] + over // each[k], "at": (at[k] + over % each[k] * size[k]).astype(np.int32)})

    return place


def token_bytes(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Arrays of ids as pack_tokens takes them, four bytes each: (doc_id, ids). A null array has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.array(x.as_py() or [], "<u4").tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = tokens.select(pick(tokens, id_col).alias("doc_id"), pick(tokens, ids_col).cast("array<int>"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def pack_tokens(tokens: DataFrame, width: int = 4, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row for each sequence of tokenised rows (doc_id, ids): bin_id, capacity, n_tokens, parts (array of doc_id, start, length, at), ids.

    ids are unsigned little-endian numbers of ``width`` bytes each, without gaps, as training code reads them. A part is
    ``length`` tokens of a row from its token ``start`` on, put at ``at`` in the sequence. Every token of every row is in one
    part. Null or empty ids add nothing. Repeated rows and ids are packed as they come, null ids too; rows equal in id and
    tokens may change places with each other, all else is settled by ids and tokens. An empty table gives no rows; other
    columns play no part.
    """
    lengths = tuple(sorted(set(lengths)))
    top = lengths[-1]
    scratch = Scratch(tokens.sparkSession)
    n = F.floor(F.octet_length("ids") / width).cast("int")
    # Hashed once, before the parts; a part is cut out in the loop over its starts, where a text's ids are at hand without a copy.
    whole = tokens.where(n > 0).withColumn("h", F.xxhash64("doc_id", "ids"))
    starts = whole.select("doc_id", "h", "ids", F.explode(F.sequence(F.lit(0), n - 1, F.lit(top))).alias("start"))
    parts = starts.select("doc_id", "h", F.struct("start", F.substr("ids", F.col("start") * width + 1, F.lit(top * width)).alias("ids")).alias("p"))
    length = F.floor(F.octet_length("p.ids") / width).cast("int")
    parts = scratch.save(parts.select("doc_id", F.xxhash64("h", "p.start").alias("h"), "p.start", length.alias("length"), "p.ids"), "parts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each size, ``top`` at most
    place = _placer(plan_bins(counts, lengths, overhead))

    # A size's buckets are ranges of the hash, so ranks don't depend on how many there are.
    bits = [(s, max(0, math.ceil(math.log2(n / bucket_rows)))) for s, n in counts.items()]
    shifts = F.broadcast(tokens.sparkSession.createDataFrame(bits, "length int, bits int"))  # a row for each size
    parts = parts.join(shifts, "length").withColumn("bucket", F.when(F.col("bits") > 0, F.expr("shiftright(h, 64 - bits)")).otherwise(F.lit(0))).drop("bits")
    sums = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = parts.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("ahead"))
    ahead = scratch.save(ahead, "ahead")  # read anew, it doesn't bring the other side to its own distribution by size alone
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("h", "doc_id", "start"))
    ranked = parts.withColumn("own", own).join(ahead, ["length", "bucket"])
    placed = ranked.withColumn("to", place("length", F.col("ahead") + F.col("own") - 1)).select("to.bin", F.struct("to.at", "doc_id", "start", "length", "ids").alias("p"))

    bins = placed.groupBy("bin").agg(F.array_sort(F.collect_list("p")).alias("p"), F.sum("p.length").alias("n_tokens"))  # ``top`` tokens at most
    capacity = F.lit(top)
    for c in reversed(lengths[:-1]):
        capacity = F.when(F.col("n_tokens") <= c, c).otherwise(capacity)
    parts_ = F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["at"].alias("at")))
    ids = F.aggregate("p", F.lit(b""), lambda done, x: F.concat(done, x["ids"]))
    return bins.select(F.col("bin").alias("bin_id"), capacity.alias("capacity"), "n_tokens", parts_.alias("parts"), ids.alias("ids"))


_loaded: dict[str, object] = {}


def _encoding(raw: bytes):
    """The vocabulary, built once in a Python worker."""
    import public_tokenizers
    import tiktoken

    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        _loaded.clear()
        _loaded[key] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[key]


def tokenised(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """doc_id and ids (two bytes each) of each row: its whole text's tokens and the end mark, which a null or empty text has alone.

    ``vocab_path`` names a file of at most 65,536 ranks (base64 of a token and its rank in each line). Rows are independent. A
    task holds a batch of Spark's, which the session bounds in rows and bytes, and the tokens of about SLICE_BYTES of
    text or of one longer text.
    """
    with open(vocab_path, "rb") as f:
        raw = f.read()
    if raw.count(b"\n") > 65_536 or not 0 <= end < 65_536:
        raise ValueError("ids of this vocabulary don't fit into two bytes")
    vocab = docs.sparkSession.sparkContext.broadcast(raw)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, mark = _encoding(vocab.value), np.array(end, "<u2").tobytes()
        for b in slices(batches, 1):
            ids = [encoding.encode_to_numpy(t, disallowed_special=()).astype("<u2").tobytes() + mark if t else mark for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    source = docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str | None = None, **options) -> DataFrame:
    """pack_tokens over the tokens of ``docs``; null and empty texts are their end mark alone. ``vocab_path``: VOCABULARY if not given."""
    if vocab_path is None:
        import public_tokenizers

        vocab_path = public_tokenizers.path(VOCABULARY)
    return pack_tokens(tokenised(docs, vocab_path, id_col, text_col), 2, **options)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))

import hashlib
import random
import re

import pyarrow as pa
import pytest

from plumage.llm.substring_dedup import _folded, drop_repeats, pieces, substring_dedup, suffix_order

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    first = {}
    for d, t in rows:
        w = WORD.findall(t or "")
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, (1, 0)), (d is None, d or 0))
    out = []
    for d, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d is None, d or 0):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed=2):
    rng = random.Random(seed)
    words = lambda n, v=500: [f"w{rng.randrange(v)}" for _ in range(n)]
    passage, other = words(130), words(60)
    rows = [None, "", "short", " ".join(passage), "\t".join(passage), " ".join(words(49)), "la " * 200, "la " * 120]
    for _ in range(30):
        cut = rng.randrange(80)
        rows.append(" ".join(words(rng.randrange(60)) + passage[cut : cut + rng.choice([45, 50, 51, 70, 130])] + words(rng.randrange(40)) + (other if rng.random() < 0.4 else [])))
    base = words(300)
    for _ in range(6):
        w = list(base)
        w[rng.randrange(300)] = "changed"
        rows.append(" \n".join(w))
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows)) + [(ids[3], " ".join(words(70))), (None, " ".join(base)), (ids[8], rows[8])]


@pytest.mark.parametrize("group", [1 << 20, 1500, 0])
def test_against_brute_force(spark, group):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, g int").repartition(3)
    got = sorted(map(tuple, substring_dedup(df, group_bytes=group, digest=True).collect()), key=str)
    assert got == brute(rows, 50)


def test_stage_and_empty(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, row string, kept int")
    got = drop_repeats(df)
    assert got.columns == df.columns
    rows_out = got.collect()
    assert len(rows_out) == len(rows) and sum(r.text is None for r in rows_out) == 1
    assert sorted(str((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest())) for r in rows_out) == sorted(str((a, d)) for a, _, _, d in brute(rows, 50))
    assert substring_dedup(df.limit(0)).count() == 0


def test_ids_of_any_type_and_names_with_dots(spark):
    rows = corpus()
    names = {d: f"d{k:03}" for k, d in enumerate(sorted({d for d, _ in rows if d is not None}))}
    df = spark.createDataFrame([(names.get(d), t, 1) for d, t in rows], "`my.id` string, text string, `a.b` int")
    want = [(names.get(d), *more) for d, *more in brute(rows, 50)]
    assert sorted(map(tuple, substring_dedup(df, "my.id", digest=True).collect()), key=str) == sorted(want, key=str)
    got = drop_repeats(df, "my.id")
    assert got.columns == df.columns and got.count() == len(rows)
    # the largest id is another id than none
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, text), ((1 << 63) - 1, text)], "doc_id long, text string")
    assert {(r.id, r.n_removed) for r in substring_dedup(df).collect()} == {(None, 60), ((1 << 63) - 1, 0)}


def test_one_passage_everywhere_and_a_long_text(spark):
    rng = random.Random(5)
    words = lambda n: [f"v{rng.randrange(10_000)}" for _ in range(n)]
    passage = words(75)
    rows = [(k, " ".join(words(40) + passage[: 75 - k % 3] + words(40))) for k in range(120)]
    rows += [(500, " ".join(words(40_000) + passage + ["x" * 100_000] + words(10))), (501, "y" * 300_000), (502, "z " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for group in (1 << 20, 4000):
        got = sorted(map(tuple, substring_dedup(df, group_bytes=group, digest=True).collect()), key=str)
        assert got == brute(rows, 50)


@pytest.mark.parametrize("group", [1 << 18, 3000, 0])
def test_a_passage_repeated_inside_one_text(spark, group):
    rng = random.Random(6)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    passage = words(60)
    alike = passage * 40
    apart = [w for _ in range(60) for w in passage + words(9)]
    rows = [(1, " ".join(alike)), (2, " ".join(apart)), (3, " ".join(passage)), (4, " ".join(words(20) + passage * 3)), (0, " ".join(words(30) + passage[:55]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring_dedup(df, group_bytes=group, digest=True).collect()), key=str) == sorted(brute(rows, 50), key=str)


def test_the_same_piece_of_a_text_is_one_row():
    names = ["o", "h", "ps", "n", "j", "k", "words", "kind"]
    rows = [(1, 2, [i, i + 5], 3, 1, b"k", b"a b", 1) for i in range(0, 1000, 10)] + [(1, 2, [7], 3, 2, b"k", b"a b", 1), (2, 2, [7], 3, 1, b"k", b"a b", 1)]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32()]
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    got = next(_folded(iter([batch]))).to_pylist()
    assert len(got) == 3 and sorted(got[0]["ps"]) == sorted([*range(0, 1000, 10), *range(5, 1000, 10)])


def test_suffix_order():
    rng = random.Random(3)
    parts = [[rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 60))] for _ in range(30)] + [[b"a"] * 40]
    part, place, common = suffix_order(parts, 12)
    suffixes = [tuple(parts[k][i:]) for k, i in zip(part.tolist(), place.tolist())]
    assert sorted(zip(part.tolist(), place.tolist())) == [(k, i) for k, p in enumerate(parts) for i in range(len(p) - 11)]
    ranks = {w: k for k, w in enumerate(dict.fromkeys(w for p in parts for w in p))}
    heads = [tuple(ranks[w] for w in s[:12]) for s in suffixes]
    assert heads == sorted(heads)
    for n, x, y in zip(common.tolist()[1:], suffixes, suffixes[1:]):
        full = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
        assert n == min(full, 15)


def test_pieces_share_their_prefix():
    words = [b"%d" % i for i in range(80)]
    for parts in (1, 2, 4, 43):
        windows = []
        for first, last, part, prefix in pieces(words, 31, parts, 50):
            windows += range(first, last + 1)
            assert all(" ".join(map(str, map(int, prefix))) in " ".join(str(k) for k in range(i, i + 50)) for i in range(first, last + 1))
            assert len(prefix) >= 50 - -(-43 // parts) + 1
        assert windows and sorted(windows) == list(range(31))

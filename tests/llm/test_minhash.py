import random
import re

import pytest

from plumage.llm import minhash
from plumage.llm.minhash import Hasher, bands_for, drop_near_copies, estimate, near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, percent):
    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    head = {c: min(r[0] for r, x in zip(rows, comp) if x == c) for c in comp}
    return sorted((rows[i][0], len(sets[i]), head[comp[i]], rows[i][0] == head[comp[i]]) for i in range(len(rows)))


def corpus(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(4))
    rows = [None, "", "  \n", "one two", "ONE\ttwo", "one two three four five", "Ä b c d e f", "ä b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.choice([20, 60, 200]))]
        for edits in (0, 0, 1, 1, 2, 3, 4, 6, 9):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    shared = " ".join(word() for _ in range(40))
    rows += [shared + " " + " ".join(word() for _ in range(n)) for n in (0, 1, 2, 3, 5, 7, 9, 20)]
    ids = rng.sample(range(1000), len(rows))
    return list(zip(ids, rows))


@pytest.mark.parametrize("percent,cell", [(85, 512), (80, 2)])
def test_against_brute_force(spark, monkeypatch, percent, cell):
    monkeypatch.setattr(minhash, "CELL", cell)
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, node string, keys int")
    got = sorted(map(tuple, near_groups(df, percent=percent).collect()))
    assert got == brute(rows, percent)


def test_stage_repeats_nulls_and_empty(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(3, long, 1), (3, long, 1), (5, long + " more", 1), (None, long, 1), (None, "other text", 1), (9, None, 1), (9, "same id other text", 1), (8, "q " * 60_000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, sig int")
    got = drop_near_copies(df)
    assert got.columns == df.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:6]) for r in got.collect() if r.doc_id is not None) == [(3, "w0 w1 "), (8, "q q q "), (9, ""), (9, "same i")]
    assert near_groups(df.limit(0)).count() == 0


def test_stage_keeps_one_row_of_a_component(spark):
    text = lambda p: " ".join(f"{p}{i}" for i in range(200))
    rows = [(3, text("w")), (None, text("w")), (None, text("w") + " more"), (None, text("v")), (None, text("v") + " more"), (None, "other text"), (None, None), (4, text("u")), (4, text("u") + " more"), (4, text("t"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, (r.text or "")[:2]) for r in drop_near_copies(df).collect())
    assert got == [(0, ""), (0, "ot"), (0, "v0"), (3, "w0"), (4, "t0"), (4, "u0")]
    # the null-id rows of test_stage_repeats_nulls_and_empty
    rows = [(3, text("w")), (5, text("w") + " more"), (None, text("w")), (None, "other text"), (9, None)]
    got = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.text for r in got if r.doc_id is None] == ["other text"]


def test_estimate_is_close(spark):
    h = Hasher(bands_for(85), 5)
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" for i in range(40, 440))
    import pyarrow as pa

    out = h.rows(pa.array([1, 2]), pa.array([0, 0]), pa.array([a, b])).to_pandas()
    df = spark.createDataFrame([(out.sig[0].tolist(), out.sig[1].tolist())], "a array<bigint>, b array<bigint>")
    x, y = shingles(a), shingles(b)
    assert abs(df.select(estimate(df.a, df.b, h.n)).first()[0] - len(x & y) / len(x | y)) < 0.15


def test_repeated_rows_do_not_multiply(spark):
    """Rows equal in id and text are fetched once: the pairs that are confirmed don't grow with them."""
    text = " ".join(f"w{i}" for i in range(150))
    rows = [(1, text), (2, text + " more")] * 300
    df = spark.createDataFrame(rows, "`my.id` long, text string").repartition(4)
    got = near_groups(df, "my.id").collect()
    assert len(got) == 600 and {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(1, 146, 1, True), (2, 147, 1, False)}
    docs = df.selectExpr("`my.id` as id", "xxhash64(text) as h", "text as t")
    nodes = docs.distinct().selectExpr("id as node", "id", "h", "0L as f1", "1L as n_shingles")
    assert minhash.texts_of(nodes, docs).count() == 2
    kept = drop_near_copies(df, "my.id")
    assert kept.columns == ["my.id", "text"] and [r["my.id"] for r in kept.collect()] == [1]


def test_long_texts(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    other = [w if k % 200 else "changed" for k, w in enumerate(words)]
    rows = [(5, " ".join(words)), (3, " ".join(other)), (9, " ".join(words[:30_000])), (4, "x" * 400_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: c for i, (_, c) in got.items()} == {3: 3, 5: 3, 9: 9, 4: 4} and got[4][0] == 1

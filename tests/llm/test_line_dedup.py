import hashlib
import random
from collections import defaultdict

import pytest

from plumage.llm.line_dedup import _pieces, line_dedup, op8_line_dedup, with_chunks
from pyspark.sql import functions as F


def corpus():
    rng = random.Random(4)
    line = lambda: "".join(rng.choice("abcdef ") for _ in range(12))
    block = [line() for _ in range(30)]
    rows = [None, "", "\n\n\n", "one line", "\n".join(block), "\n".join(block), "x\n" + "\n".join(block)]
    for _ in range(25):
        a = rng.randrange(25)
        rows.append("\n".join([line() for _ in range(rng.randrange(8))] + block[a : a + rng.randrange(12)] + [line() for _ in range(rng.randrange(8))]))
    return [(i * 3 % 101, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("bits", [64, 2])
def test_against_brute_force(spark, bits):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, lines string, n_lines int")
    chunks = {r.id: r for r in with_chunks(df, "doc_id", "text", 4).withColumn("p", _pieces()).collect()}
    seen = defaultdict(list)
    for i, r in chunks.items():
        for p in r.p:
            if p.text is not None:
                seen[p.text].append((i, p.pos))
    gone = {o for v in seen.values() for o in v if o != min(v)}
    assert len(gone) > 10
    got = {r.doc_id: r for r in line_dedup(df, key_bits=bits).collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        ends = chunks[i].ends
        keep = [x for k, e in enumerate(ends) if (i, k) not in gone for x in lines[(ends[k - 1] + 1 if k else 0) : e + 1]]
        assert got[i].text == (None if t is None else "\n".join(keep))
        assert (got[i].n_lines, got[i].n_removed) == ((0, 0) if t is None else (len(lines), len(lines) - len(keep)))


def test_boundaries_resist_shifts(spark):
    body = [f"line {i * i}" for i in range(60)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new"] + body))], "doc_id long, text string")
    a, b = (set(x.text for x in r.p if x.text) for r in with_chunks(df, "doc_id", "text", 4).withColumn("p", _pieces()).collect())
    assert len(a & b) >= len(a) - 1


def test_repeats_nulls_and_empty(spark):
    t = "\n".join(f"line {i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t)], "doc_id long, text string")
    got = {(r.doc_id, r.n_removed > 30) for r in line_dedup(df).collect()}
    assert got == {(1, False), (None, True), (2, True)}
    assert line_dedup(df.limit(0)).count() == 0


def test_query_removes_every_repeated_run(spark, tmp_path):
    rows = corpus() + [(500, "a\n\n\n\nb"), (501, "z\na\n\n\n\nb\ny"), (502, "q\nr"), (503, "r\nq\nr"), (None, "q\nr\nnew"), (504, "s\ns\ns")]
    assert run_brute(rows)[503, "r\nq\nr"] == ["r"]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.n_removed, r.kept_sha256) for r in op8_line_dedup(spark, str(tmp_path)).collect()}
    want = run_brute(rows)
    assert got == {(i, len(t.split("\n")) - len(want[i, t]) if t is not None else 0, hashlib.sha256("\n".join(want[i, t]).encode()).hexdigest()) for i, t in rows}
    collide = {(r.doc_id, r.text) for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), key_bits=2, runs=True).collect()}
    assert collide == {(i, None if t is None else "\n".join(want[i, t])) for i, t in rows}


def run_brute(rows):
    """By id and text, the lines in no run of two lines or more, with a word, that occurred earlier."""
    seen, kept = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        lines, gone = (t or "").split("\n"), set()
        for a in range(len(lines)):
            for z in range(a + 2, len(lines) + 1):
                run = tuple(lines[a:z])
                if any(x.strip() for x in run):
                    gone |= set(range(a, z)) if run in seen else set()
                    seen.add(run)
        kept[i, t] = [x for k, x in enumerate(lines) if k not in gone]
    return kept


def test_a_long_text(spark):
    lines = [f"line {k * k % 9973} {k % 13}" for k in range(20_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["new"] + lines[5000:9000] + ["x" * 200_000])), (3, "y" * 300_000)]
    got = {r.doc_id: r for r in line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), runs=True).collect()}
    assert got[2].n_removed == 4000 and got[2].text == "new\n" + "x" * 200_000 and got[3].text == rows[2][1]

"""The pipeline's stages one after another against brute force, on a small corpus with every kind of copy."""

import hashlib
import random
import re

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from plumage.llm.quality_rules import ORACLE
from tests.llm.test_minhash import brute as near_brute
from tests.llm.test_packing import END, ENCODING, numbers
from tests.llm.test_substring_dedup import WORD
from tests.llm.test_substring_dedup import brute as substring_brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "of", "and", "der", "und", "la", "de"]) if rng.random() < 0.3 else "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(90)
    texts = [None, "", "short one", "$$$ ### " * 80, "la la la " * 60]
    for _ in range(25):
        base = prose(rng.randint(60, 300))
        texts += [base, base] if rng.random() < 0.4 else [base]
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = base.split()
            for _ in range(rng.choice([1, 2, 5])):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        if rng.random() < 0.4:
            texts.append(prose(50) + " " + passage + " " + prose(rng.randint(10, 60)))
    ids = rng.sample(range(10_000), len(texts))
    path = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, t, None if i % 5 == 0 else "en", "src", None if t is None else len(t)) for i, t in zip(ids, texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet/*.parquet'")
    good = {r[0] for r in con.sql(f"select doc_id from ({ORACLE}) where kept").fetchall()}
    want = {r.doc_id: r.text for r in docs.collect() if r.doc_id in good}
    assert 40 < len(want) < docs.count()

    by_text: dict[str, int] = {}
    for i, t in want.items():
        by_text[t] = max(i, by_text.get(t, i))
    after_exact = {i: t for i, t in want.items() if by_text[t] == i}
    after_near = {i: after_exact[i] for i, _, _, kept in near_brute(list(after_exact.items()), 80) if kept}
    digests = {i: (removed, h) for i, _, removed, h in substring_brute(list(after_near.items()), 50)}
    assert len(after_near) < len(after_exact) < len(want) and any(removed for removed, _ in digests.values())

    now = docs
    for (name, stage), expected in zip(corpus_pipeline.STAGES, [want, after_exact, after_near, None, None]):
        last = now
        now = stage(spark, now, sf_dir).checkpoint()
        if expected is not None:
            assert now.columns == docs.columns
            assert {r.doc_id: r.text for r in now.collect()} == expected, name
        elif name == "substring dedup":
            assert now.columns == docs.columns
            got = {r.doc_id: (r.n_chars, r.text) for r in now.collect()}
            assert {i: hashlib.sha256(" ".join(WORD.findall(t)).encode()).hexdigest() for i, (_, t) in got.items()} == {i: h for i, (_, h) in digests.items()}
            assert all(n == len(t) for n, t in got.values())
        else:
            texts, parts = {r.doc_id: r.text for r in last.collect()}, {}
            for b in now.collect():
                for p in b.parts:
                    parts.setdefault(p.doc_id, []).append((p.start, numbers(b.ids)[p["at"] : p["at"] + p.length]))
            ids = {i: [t for _, x in sorted(own) for t in x] for i, own in parts.items()}
            assert all(x.count(END) == 1 and x[-1] == END for x in ids.values())
            assert {i: ENCODING.decode(x[:-1]) for i, x in ids.items()} == texts


def test_run_and_registration(spark, sf_dir):
    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    bins = corpus_pipeline.run(spark, sf_dir).collect()
    assert bins and all(b.n_tokens <= b.capacity for b in bins)
    assert [f"op{n}_" for n in range(1, 14)] == sorted({re.match(r"op\d+_", q)[0] for q in __spark_entry__.queries() if q.startswith("op")}, key=lambda x: int(x[2:-1]))
    entry = __spark_entry__.entry(spark)
    assert entry.count() > 0


def test_hard_tables(spark, tmp_path):
    """Empty tables, null and repeated ids, a very long text, and columns with names that operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _o int, kept boolean, `a.b` string, ids int"
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) if k % 3 == 0 else "".join(rng.choice("abcdeilmnorst") for _ in range(rng.randint(3, 9))) for k in range(n))
    a, long = prose(120), prose(60_000)
    rows = [(None, a), (1, a), (1, a), (None, prose(100)), (2, prose(110)), (2, prose(90)), (7, None), (8, ""), (9, long), (10, long)]
    full = spark.createDataFrame([(i, t, None, "s", None if t is None else len(t), 1, False, "x", 3) for i, t in rows], schema)
    for name, df in (("none", full.limit(0)), ("rows", full)):
        df.repartition(2).write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
    bins = corpus_pipeline.run(spark, f"{tmp_path}/rows").collect()
    texts = {}
    for b in bins:
        for p in b.parts:
            texts.setdefault(p.doc_id, []).append((p.start, p.length))
    assert set(texts) == {1, 2, None, 10} and sum(b.n_tokens for b in bins) == sum(n for v in texts.values() for _, n in v)
    now = full
    for (name, stage), left in zip(corpus_pipeline.STAGES[:-1], (8, 5, 5, 5)):
        now = spark.createDataFrame(stage(spark, now, str(tmp_path)).collect(), schema)
        assert now.columns == full.columns and now.count() == left, name

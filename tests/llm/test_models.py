"""The trained operators, by held-out accuracy on the driver's small table and on edge cases."""

import zlib

import pytest
from pyspark.sql import functions as F

from plumage.llm import language_id, quality_classifier

DIR = "/root/testdata/sf0.01"


def test_language(spark):
    got = language_id.op1_language_id(spark, DIR)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", F.length("text").alias("n"))
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.lang and r.n > 100]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97


def test_language_edges(spark):
    model = language_id.fit([("the of and this with", "en"), ("der die und nicht mit", "de"), ("le la les des et", "fr"), ("что это", "xx")] * 5)
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 !?", "x"), (4, "the and of", "x"), (4, "the and of", "x"), (None, "les des la " * 200_000, "x")], "doc_id long, text string, score string")
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in language_id.identify(df, model).collect()))
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert language_id.identify(df.limit(0), model).count() == 0
    assert language_id.identify(df, language_id.fit([])).where("lang_pred <> 'und'").count() == 0


def test_quality(spark):
    got = quality_classifier.op9_quality_classifier(spark, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    area = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert area > 0.93
    assert got.count() == 1000


@pytest.mark.parametrize("labelled", [[], [(1, 1)], [(1, 1), (2, 0)]])
def test_quality_edges(spark, labelled):
    docs = spark.createDataFrame([(1, "good words here", 1), (2, "$$$ ###", 1), (3, None, 1), (3, "", 1), (None, "x" * 300_000, 1)], "doc_id long, text string, score int")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    model = quality_classifier.quality_model(docs, labels)
    got = quality_classifier.score_quality(docs, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score_quality(docs.limit(0), model).count() == 0


def test_language_scores_against_a_plain_reading_of_the_model(spark):
    """Margins gram by gram and votes pair by pair, from the definition, for a fitted model."""
    import numpy as np

    model = language_id.fit(language_id.sample(spark.read.parquet(f"{DIR}/documents.parquet").where("lang is not null"), "doc_id", "text", "lang", 60, 5000))

    def index(gram):
        x, top = int.from_bytes(gram, "little"), 1 << 17
        if len(gram) == 2:
            return x
        return 65_536 + (len(gram) - 3) * top + ((x * 0x9E3779B1) % (1 << 32) >> 15)

    def plain(text):
        raw = bytes(c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in b" " + text.encode() + b"  ")
        raw = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c for c in raw)
        found = [index(raw[i : i + n]) for n in (2, 3, 4) for i in range(len(raw) - n + 1)]
        margins = [float(np.mean([model["weights"][i, k] for i in found], dtype=np.float64)) + model["bias"][k] for k in range(len(model["pairs"]))]

        def best(kind, names):
            score = {}
            for x in names:
                own = [(m if a == x else -m) for (k, a, b), m in zip(model["pairs"], margins) if k == kind and x in (a, b)]
                won = [(m >= 0 if a == x else m < 0) for (k, a, b), m in zip(model["pairs"], margins) if k == kind and x in (a, b)]
                score[x] = (sum(won), sum(1 / (1 + np.exp(-3 * m)) for m in own))
            top = max(names, key=lambda x: score[x])
            return top, score[top][1] / (len(names) - 1) if len(names) > 1 else 1.0

        family, p = best("family", sorted(model["families"]))
        lang, q = best(family, model["families"][family])
        return lang, p * q

    rows = spark.read.parquet(f"{DIR}/documents.parquet").where("length(text) between 1 and 1500").orderBy("doc_id").limit(40)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(rows, model).collect()}
    for r in rows.collect():
        if any(c.isalpha() for c in r.text):
            lang, score = plain(r.text)
            assert got[r.doc_id][0] == lang and got[r.doc_id][1] == pytest.approx(score, abs=1e-5)


def test_quality_scores_against_a_plain_reading_of_the_model(spark):
    import math

    import zstandard

    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    model = quality_classifier.quality_model(docs, labels, rows=60)
    rows = docs.where("length(text) < 6000").orderBy("doc_id").limit(60)
    got = {r.doc_id: r.score for r in quality_classifier.score_quality(rows.withColumnRenamed("lang", "a.b"), model).collect()}
    for r in rows.collect():
        raw, sizes = r.text.encode(), []
        for d in model["dicts"]:
            parts = [raw[i : i + 1000] for i in range(0, len(raw), 1000)]
            sizes.append(sum(len(zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(p)) for p in parts))
        z = model["slope"] * ((sizes[0] - sizes[1]) / len(raw) if raw else 0.0) + model["start"]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)

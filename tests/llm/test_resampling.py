import hashlib
import math
import re
import zlib
from collections import Counter

from plumage.llm.resampling import drawn_rows, gains, op13_importance_resampling, resample


def words(text):
    small = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", small)


def brute(docs, target, max_n, n_buckets, min_words, percent, seed):
    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for r in rows for b in features(r[1])) for rows in (docs, target))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + n_buckets) / ((s[b] + 1) * (sum(t.values()) + n_buckets)))) for b in range(n_buckets)]
    out = []
    for i, text in docs:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features(text))
        out.append([i, len(features(text)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text)) >= min_words])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(may[: len(may) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


DOCS = [(None, None), (1, ""), (2, "A b C"), (2, "A b C"), (3, "ÄB äb É 日本 x1 x_1"), (4, "the cat sat on the mat " * 9), (5, "The\tdog\x1fsat"), (6, "z " * 5000), (None, "a b c d"), (-7, "cat CAT cat\n\nsat")]
DOCS += [(100 + i, f"word{i % 7} sat on number {i} of {i * i} mats") for i in range(60)]
TARGET = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, "number mats word3")]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*d, "w", 1, 2) for d in DOCS], "doc_id long, text string, w string, b int, score int").repartition(3)
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    for max_n, n_buckets, min_words, percent in ((1, 10_000, 3, 30), (3, 50, 0, 100), (2, 1, 5, 10)):
        got = resample(docs, target, max_n=max_n, n_buckets=n_buckets, min_words=min_words, percent=percent)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(DOCS, TARGET, max_n, n_buckets, min_words, percent, 2024)


def test_draw_prefers_the_target(spark):
    docs = spark.createDataFrame([(i, ("apple pear plum " if i % 4 == 0 else "nail screw bolt ") * 10) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(1, "apple plum pear")], "item_id long, text string")
    kept = drawn_rows(docs, target)
    assert kept.columns == docs.columns
    assert {r.doc_id % 4 for r in kept.collect()} == {0} and kept.count() == 40


def test_empty_tables_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)] * 50 + [(None, "a b c " * 10)] * 50, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs.limit(0), none).count() == 0
    ranks = sorted(r["rank"] for r in resample(docs, none).where("rank is not null").collect())
    assert ranks == list(range(1, 11))
    assert len(gains(docs, none)) == 10_000


def test_plan_shuffles_no_text(spark):
    plan = op13_importance_resampling(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text" not in plan

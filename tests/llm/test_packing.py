import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from plumage.llm.bpe import bpe_encode
from plumage.llm.packing import END, LENGTHS, bin_cost, pack, pack_tokens, plan_bins, token_bytes

RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
ENCODING = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def brute(sizes, lengths, overhead):
    """The rule part by part: (bin, place) of each part in descending order, and each bin's opened length."""
    todo, opened, used, out = sorted(sizes, reverse=True), [], [], []
    for i, s in enumerate(todo):
        fits = [(c - u, -c, b) for b, (c, u) in enumerate(zip(opened, used)) if c - u >= s]
        if fits:
            b = min(fits)[2]
        else:
            rest = lambda c: sum(x for x in todo[i + 1 :] if x <= c - s)  # noqa: B023, E731
            b = len(opened)
            opened.append(min((c for c in lengths if c >= s), key=lambda c: (bin_cost(s, c, rest(c), overhead), c)))  # noqa: B023
            used.append(0)
        out.append((s, b, used[b]))
        used[b] += s
    return out


def numbers(ids, width=2):
    return np.frombuffer(bytes(ids), f"<u{width}").tolist()


def expanded(runs):
    return sorted((s, first + k, at + j * s) for s, _, m, each, first, at in runs for k in range(m) for j in range(each))


@pytest.mark.parametrize("lengths", [(64,), (16, 32, 64), (10, 37, 50, 64)])
@pytest.mark.parametrize("seed", range(8))
def test_plan_equals_the_rule_bin_by_bin(lengths, seed):
    rng = random.Random(seed)
    most = rng.choice([5, 20, 64])
    sizes = [min(64, 1 + int(rng.expovariate(1 / most))) for _ in range(rng.choice([1, 7, 60, 300]))]
    counts = {s: sizes.count(s) for s in set(sizes)}
    runs = plan_bins(counts, lengths, 5)
    assert expanded(runs) == sorted(brute(sizes, lengths, 5))
    for s, n in counts.items():  # ranks are taken once, without gaps
        own = sorted((r, m * each) for x, r, m, each, _, _ in runs if x == s)
        assert [r for r, _ in own] == [sum(z for _, z in own[:k]) for k in range(len(own))] and sum(z for _, z in own) == n


def test_plan_does_not_grow_with_the_corpus():
    rng = random.Random(1)
    shape = {s: rng.randint(1, 20) for s in range(1, 4097)}
    small, large = (plan_bins({s: n * times for s, n in shape.items()}, LENGTHS, 64) for times in (10, 10_000_000))
    assert len(large) < 2 * len(small) < 200_000
    assert sum(m * each * s for s, _, m, each, _, _ in large) == sum(s * n for s, n in shape.items()) * 10_000_000


def corpus():
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["word ", "Ünï ", "\n", "日本 ", "<|endoftext|>"]) for _ in range(rng.choice([0, 3, 40, 300, 2500]))), 1) for i in range(150)]
    return rows + [(None, None, 1), (None, "a b", 1), (1000, "x", 1), (1000, "x", 1), (300, "y\t" * 20_000, 1), (301, "q" * 300_000, 1)]


def test_every_token_once_and_ids_give_the_text_back(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, `p.ids` int")
    bins = pack(df, bucket_rows=8).collect()
    assert len({b.bin_id for b in bins}) == len(bins)
    spans, texts, sizes = [], {}, []
    for b in bins:
        at = 0
        for p in b.parts:
            assert p["at"] == at
            spans.append((str(p.doc_id), p.start, numbers(b.ids)[at : at + p.length]))
            at += p.length
        assert 2 * at == 2 * b.n_tokens == len(b.ids) <= 2 * b.capacity and b.capacity == min(c for c in LENGTHS if c >= at)
    for i, t, _ in rows:
        ids = [*ENCODING.encode_ordinary(t or ""), END]
        texts.setdefault(str(i), []).append(t or "")
        sizes += [len(ids[s : s + 4096]) for s in range(0, len(ids), 4096)]
    assert sorted(len(x) for _, _, x in spans) == sorted(sizes)
    for i, own in texts.items():
        parts = sorted((s, x) for d, s, x in spans if d == i)
        if len(own) == 1:
            ids = [t for _, x in parts for t in x]
            assert ids[-1] == END and END not in ids[:-1] and ENCODING.decode(ids[:-1]) == own[0]
        else:
            assert sorted(ENCODING.decode(x[:-1]) for _, x in parts) == sorted(own)
    used = {}
    for s, b, _ in brute(sizes, LENGTHS, 64):
        used[b] = used.get(b, 0) + s
    assert sorted(used.values()) == sorted(b.n_tokens for b in bins)  # the whole corpus' best fit, not a shard's
    assert pack(df.limit(0)).count() == 0


def test_layout_and_buckets_do_not_matter(spark):
    df = spark.createDataFrame([(i, "w " * (i * 37 % 400), 1) for i in range(300)], "doc_id long, text string, p int")
    want = sorted(map(str, pack(df.coalesce(1)).collect()))
    assert sorted(map(str, pack(df.repartition(7, "doc_id"), bucket_rows=1).collect())) == want


def test_tokens_of_any_vocabulary(spark):
    df = spark.createDataFrame([(f"d{i}", "some words here " * i) for i in range(40)] + [("none", None)], "doc_id string, text string")
    tokens = bpe_encode(df, public_tokenizers.path("word_bpe_49k.json")).withColumn("ids", F.when(F.col("ids") != "", F.split("ids", " ").cast("array<int>")))
    bins = pack_tokens(token_bytes(tokens), lengths=(32, 128)).collect()
    want = {r.doc_id: r.ids or [] for r in tokens.collect()}
    back = sorted((p.doc_id, p.start, numbers(b.ids, 4)[p["at"] : p["at"] + p.length]) for b in bins for p in b.parts)
    assert all([t for d, _, x in back if d == i for t in x] == ids for i, ids in want.items())
    assert sum(b.n_tokens for b in bins) == 3 * sum(range(40)) and all(b.n_tokens <= b.capacity for b in bins)
    assert {p.doc_id for b in bins for p in b.parts} == {f"d{i}" for i in range(1, 40)}


def test_time_grows_with_a_texts_length_only_in_proportion(spark, tmp_path):
    """A text's ids are hashed once, not for each of its parts: 32 MB would take minutes otherwise."""
    import time

    for mb, most in ((1, None), (32, 60)):
        ids = spark.range(1).select(F.lit(1).alias("doc_id"), F.repeat(F.lit("0123456789abcdef"), (F.col("id") + mb * 65536).cast("int")).cast("binary").alias("ids"))
        ids.write.parquet(f"{tmp_path}/{mb}")
        began = time.time()
        out = pack_tokens(spark.read.parquet(f"{tmp_path}/{mb}"), 2)
        assert out.agg(F.sum("n_tokens")).first()[0] == mb * 524_288 and out.where("n_tokens < 4096").count() == 0
        assert most is None or time.time() - began < most

import hashlib
import random
import re
import zlib

import pytest

from plumage.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, p string, base long"


def label(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def brute(rows):
    turns = {}
    for c, turn, role, text in rows:
        turns.setdefault(c, []).append((turn, role or "", text or ""))
    for v in turns.values():
        v.sort(key=lambda t: (t[0] is not None, t[0] or 0, label(*t[1:])))
    said = {c: [t[1:] for t in v] for c, v in turns.items()}
    built = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own if c is None else said.get(c - int(c - 20 * int(c / 20)), [])[:h] + own[h:]
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    first = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    kids = {p: sum(q[:-1] == p and len(q) == len(p) + 1 for q in members) for p in members}
    own = {p: (len(m) - 1) * len(re.findall("[^\\x20\\x09-\\x0D]+", p[-1][1])) if p else 0 for p, m in members.items()}
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted((c for c in m if built[c] == list(p)), key=lambda c: (c is not None, c or 0))
        text = ",".join("" if c is None else str(c) for c in ends)
        out.add((first[p], len(p), first[p[:-1]] if p else None, len(m), kids[p], sum(not kids[q] for q in below), sum(own[q] for q in below), hashlib.sha256(text.encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(3)
    say = ["hi there", "", None, "one two  three", "x" * 500, "日本 語"]
    out = [(c, t, rng.choice(["user", "assistant", None]), say[rng.randrange(2 + c % 5)]) for c in [*range(-45, 70), 1000, 5000, 9000, 13000] if c % 9 for t in range(rng.randrange(1, 7))]
    out += [(c, t, "user", f"long {t}") for c in (200, 7000, 7001, 20000) for t in range(60 + c % 3)]  # the same long talk, and one that goes on
    out += [(None, 1, "user", "hi there"), (None, None, "user", "hi"), (60, 1, "user", "same"), (60, 1, "user", "same"), (60, 1, "user", "other"), (60, None, "z", "y")]
    return out


@pytest.mark.parametrize("most", [3, 50_000])
def test_against_brute_force(spark, most):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA).repartition(5)
    got = prefix_trie(df, most=most).collect()
    want = brute(rows())
    assert set(map(tuple, got)) == want and len(got) == len(want)
    assert all(type(v) is int for r in got for v in (r.depth, r.n_children, r.saved_tokens))


def test_deep_chains(spark):
    """Each conversation leaves the one before a turn later, so chains hang from each other as deep as they can."""
    talk = [(20 * c, t, "user", f"turn {t}" if t <= c else f"own {c}") for c in range(1, 34) for t in range(c + 3)]
    assert set(map(tuple, prefix_trie(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect())) == brute(talk)


def test_common_node_over_blocks(spark):
    talk = [(c, 0, "user", "hello") for c in range(0, 30_000, 3)]
    got = {r.depth: r for r in prefix_trie(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    ends = [c for c, *_ in talk if zlib.crc32(str(c).encode()) % 4 == 0 or c - c % 20 in range(0, 30_000, 60)]
    assert got[1].n_convs == len(ends) and got[1].ends_sha256 == hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
    assert got[0].n_convs == 10_000 and (got[0].n_leaves, got[0].saved_tokens) == (1, len(ends) - 1)


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie(df).count() == 0
    alone = prefix_trie(spark.createDataFrame([(None, 0, None, None)], df.schema)).collect()
    assert sorted((r.depth, r.conv_id, r.n_convs) for r in alone) == [(0, None, 1), (1, None, 1)]

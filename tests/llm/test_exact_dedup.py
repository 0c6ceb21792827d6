import hashlib
from collections import defaultdict

import pytest

from plumage.llm.exact_dedup import _keyed, _named, drop_copies, exact_dedup
from plumage.llm.common import Scratch
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, keep_id string, names int"


def rows():
    long = "äbc déf " * 900
    return [(1, "a"), (2, "a"), (3, None), (4, ""), (5, long), (6, long), (7, long + "x"), (8, "b" * 1024), (9, "b" * 1025), (10, "b" * 1024), (11, "a "), (11, "a "), (12, "c")]


def brute(data):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for i, t in data:
        g = groups[t or ""]
        out.append((i, max(g), len(g), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("bits,block", [(64, 1024), (64, 100), (2, 512), (0, 1024)])
def test_against_brute_force(spark, bits, block):
    data = rows()
    df = spark.createDataFrame([(*r, "clash", 5) for r in data], SCHEMA).repartition(3)
    got = exact_dedup(df, key_bits=bits, block_bytes=block).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == brute(data)
    assert sum(r.kept for r in got) == len({t or "" for _, t in data})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_stage_keeps_columns_and_one_row_a_text(spark):
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows()], SCHEMA)
    got = drop_copies(df)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 6, 7, 9, 10, 11, 12]


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a", "", 1), (None, "b", "", 1), (1, "a", "", 1)], SCHEMA)
    got = {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(df).collect()}
    assert got == {(None, 1, False), (None, None, True), (1, 1, True)}
    assert exact_dedup(df.limit(0)).count() == 0
    assert drop_copies(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [64, 2])
def test_names_are_places_in_the_sorted_order(spark, bits):
    texts = ["".join(chr(97 + (i * k) % 7) for k in range(i % 40)) for i in range(200)]
    df = spark.createDataFrame([(i, bytearray(t.encode())) for i, t in enumerate(texts)], "_row long, raw binary").repartition(5)
    rows = _keyed(df, F.col("raw"), 8, bits, Scratch(spark))
    blocks = {r._row: [tuple(x) for x in r["items"]] for r in rows.collect()}
    order = {x: k for k, x in enumerate(sorted({x for own in blocks.values() for x in own}))}
    assert {r._row: r.names for r in _named(rows).collect()} == {i: [order[x] for x in own] for i, own in blocks.items()}
    cut = {i: [t.encode()[k : k + 8] for k in range(0, max(1, len(t)), 8)] for i, t in enumerate(texts)}
    assert len(order) == len({x for own in cut.values() for x in own})


def test_long_texts_and_names_with_dots(spark):
    long = "long text " * 300_000
    df = spark.createDataFrame([("a", long, 1), ("b", long, 2), ("c", long + ".", 3), ("d", long[:-1] + ".", 4)], "`my.id` string, text string, `x.y` int")
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup(df, "my.id").collect()}
    assert got == {("a", "b", 2), ("b", "b", 2), ("c", "c", 1), ("d", "d", 1)}
    kept = drop_copies(df, "my.id")
    assert kept.columns == df.columns and sorted(r["x.y"] for r in kept.collect()) == [2, 3, 4]

"""Every registered query on the reference's operators against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from plumage.plans.catalog import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return repr(v) if isinstance(v, list) else v if not isinstance(v, float) else round(v, 9)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = sorted((tuple(plain(v) for v in r) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)
    assert got == want

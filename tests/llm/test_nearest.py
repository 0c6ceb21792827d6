import numpy as np
import pytest

from plumage.llm import nearest as nn

SCHEMA = "vec_id long, embedding array<double>, dim int, shard string"


def brute(rows, every, k):
    """(query, rank) to (id, score), over rows of distinct ids with usable vectors."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        score = nn.cosines(np.repeat(x[i : i + 1], len(x), 0), x)
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out |= {(int(ids[i]), n + 1): (int(ids[j]), score[j]) for n, j in enumerate(order)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], 1, "x") for i, v in rows], SCHEMA).repartition(3)


def clustered(n, dim, seed, clusters=40):
    rng = np.random.RandomState(seed)
    return rng.standard_normal((clusters, dim))[rng.randint(clusters, size=n)] + 0.3 * rng.standard_normal((n, dim))


@pytest.mark.parametrize("kind", ["uniform", "clustered", "apart"])
def test_recall_over_shards(spark, kind):
    x = {"uniform": np.random.RandomState(1).standard_normal((4000, 32)), "clustered": clustered(4000, 32, 2), "apart": clustered(4000, 64, 3, 300) * 7}[kind]
    rows = list(enumerate(x))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in nn.nearest(frame(spark, rows), shard_rows=400 if kind == "clustered" else 2000, query_rows=30).collect()}
    want = brute(rows, 50, 5)
    assert got.keys() == want.keys()
    found = sum(len({got[q, n][0] for n in range(1, 6)} & {want[q, n][0] for n in range(1, 6)}) for q in range(0, 4000, 50))
    assert found >= 0.98 * len(want)
    for (q, _), (i, score) in got.items():
        assert score == nn.cosines(x[q : q + 1], x[i : i + 1])[0] and q != i


def test_every_point_can_be_reached():
    for x in (clustered(3000, 16, 5, 200), np.repeat(np.eye(8), 20, 0) + 1e-4 * np.random.RandomState(0).standard_normal((160, 8))):
        graph = nn.build_graph(nn._unit(x))
        assert graph.reached().all()
        ids, near = graph.beam(graph.x, 64)
        assert (near.max(1) > 0.9999).mean() > 0.99  # each finds itself


def test_copies_ties_and_what_takes_no_part(spark):
    same = [(i, [1.0, 2.0, 2.0]) for i in range(0, 600, 3)]
    odd = [(1000, None), (1050, []), (1100, [0.0, 0.0, 0.0]), (1150, [float("nan"), 1.0, 1.0]), (1200, [float("inf"), 0.0, 1.0]), (1250, [1e200, 2e200, 2e200]), (1300, [1.0]), (1350, [-2.0]), (None, [1.0, 2.0, 2.0])]
    got = {}
    for r in nn.nearest(frame(spark, same + odd)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    got = {q: sorted(v) for q, v in got.items()}
    assert got[0] == [(n + 1, i, 1.0) for n, i in enumerate([3, 6, 9, 12, 15])]
    assert got[150] == [(n + 1, i, 1.0) for n, i in enumerate([0, 3, 6, 9, 12])]
    assert got[1250] == [(n + 1, i, 1.0) for n, i in enumerate([0, 3, 6, 9, 12])]
    assert got[1300] == [(1, 1350, -1.0)] and got[1350] == [(1, 1300, -1.0)]
    assert set(got) == {*range(0, 600, 150), 1250, 1300, 1350}


def test_few_rows_repeats_and_empty(spark):
    assert nn.nearest(frame(spark, [])).count() == 0
    assert nn.nearest(frame(spark, [(0, [1.0, 0.0])])).count() == 0
    two = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (7, [1.0, 1.0]), (None, [1.0, 0.5])]
    assert [(r.query_id, r["rank"], r.vec_id) for r in nn.nearest(frame(spark, two)).orderBy("rank").collect()] == [(0, 1, None), (0, 2, 7)]


def test_index_is_general(spark):
    x = clustered(500, 8, 9)
    index = nn.build_index(frame(spark, list(enumerate(x))), k=3, shard_rows=10).cache()
    assert index.count() == 500 and index.agg({"shard": "max"}).first()[0] > 3
    got = nn.search(index, frame(spark, [(900, x[7]), (901, x[8])]), k=3).where("rank = 1").collect()
    assert sorted((r.query_id, r.vec_id) for r in got) == [(900, 7), (901, 8)]

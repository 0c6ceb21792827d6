"""Approximate nearest neighbours by cosine, over robust-pruned directed graphs, one for each shard.

Equal vectors are one point of a graph, with the smallest of their ids: of equal vectors no more than k + 1 can be among anyone's
k nearest. Points are dealt to shards of about ``shard_rows`` by a hash of the vector, so a task holds one shard, whatever the
table's size, and no shard is hot. A shard's graph grows in batches that double up to ``BATCH``: greedy searches from its central
point over the graph so far propose neighbours (with those of the same batch), robust pruning keeps the nearest and drops
what is nearer, by the factor ``ALPHA``, to a neighbour already kept, and edges are added back under the same rule.
Points that the centre can't reach in the end get an edge from the nearest point that it can, so every row can be found.

The index is a written table, a row for each point, so searching after a lost executor rereads it. Each query is searched in
every shard: a task reads one shard's points, then the queries in Arrow batches, and hands on k rows for each query, scored in
double precision over the whole beam. Many queries are split over several tasks for each shard, each with a copy of the points.
What moves grows as queries times shards; larger shards, as far as executors' memory goes, make fewer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.llm.common import Scratch, pick, table

#: Points of a shard, about, if they have SHARD_DIM components each, else as many as have as many components: 4 MB of floats, 8 MB
#: of doubles and 2 MB of edges, and some 100 MB for a batch while it is built.
SHARD_ROWS, SHARD_DIM = 16_384, 64
#: Edges that pruning leaves a point; points of a batch; candidates that building and searching keep; points expanded at a time.
DEGREE, BATCH, BUILD_BEAM, SEARCH_BEAM, WIDTH = 32, 512, 64, 128, 4
ALPHA = 1.2
#: Queries that one task searches in its shard, about.
QUERY_ROWS = 65_536
K, EVERY = 5, 50


def usable(vec: Column) -> Column:
    """Whether a vector takes part: not null, not empty, not zero, and all components finite."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Graph:
    """A directed graph over unit vectors that greedy searches from ``entry`` walk."""

    def __init__(self, unit: np.ndarray, edges: np.ndarray | None = None, entry: int = 0):
        self.x, self.entry = unit, entry
        self.batch = max(16, min(BATCH, BATCH * SHARD_DIM // unit.shape[1]))  # memory of a batch grows with the components
        self.edges = np.full((len(unit), DEGREE), -1, np.int32) if edges is None else edges

    def beam(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``size`` nearest points found for each query, and their cosines (-inf, and point -1, where there are fewer)."""
        n, rows = len(queries), np.arange(len(queries))[:, None]
        seen = np.zeros((n, len(self.x)), bool)
        seen[:, self.entry] = True
        ids, near = np.full((n, size), -1, np.int32), np.full((n, size), -np.inf, np.float32)
        ids[:, 0], near[:, 0] = self.entry, queries @ self.x[self.entry]
        open_ = np.zeros((n, size), bool)
        open_[:, 0] = True
        width = min(WIDTH, size)
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                return ids, near
            at = np.argpartition(np.where(open_[live], -near[live], np.inf), width - 1, axis=1)[:, :width]
            chosen = np.where(open_[live[:, None], at], ids[live[:, None], at], -1)
            open_[live[:, None], at] = False
            new = np.where((chosen >= 0)[:, :, None], self.edges[chosen], -1).reshape(len(live), -1)
            new.sort(axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[(new >= 0) & seen[live[:, None], new]] = -1
            r, c = np.nonzero(new >= 0)
            found = new[r, c]
            seen[live[r], found] = True
            cos = np.full(new.shape, -np.inf, np.float32)
            cos[r, c] = np.einsum("nd,nd->n", queries[live[r]], self.x[found])
            all_near, all_ids, all_open = np.hstack([near[live], cos]), np.hstack([ids[live], new]), np.hstack([open_[live], new >= 0])
            best = np.argpartition(-all_near, size - 1, axis=1)[:, :size]
            i = rows[: len(live)]
            near[live], ids[live], open_[live] = all_near[i, best], all_ids[i, best], all_open[i, best]

    def prune(self, points: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """DEGREE neighbours at most for each point out of its candidates (-1 for none): near and in different directions."""
        ids = np.where(ids == points[:, None], -1, ids)
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        there = self.x[ids]
        dist = np.where(ids >= 0, 2 - 2 * np.einsum("bcd,bd->bc", there, self.x[points]), np.inf)
        order, i = np.argsort(dist, axis=1, kind="stable"), np.arange(len(points))
        ids, dist, there = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1), np.take_along_axis(there, order[:, :, None], 1)
        apart = 2 - 2 * np.matmul(there, there.transpose(0, 2, 1))
        live, out = ids >= 0, np.full((len(points), DEGREE), -1, np.int32)
        for k in range(DEGREE):
            if not live.any():
                break
            first = live.argmax(1)
            any_ = live[i, first]
            out[any_, k] = ids[i, first][any_]
            live &= ALPHA * ALPHA * apart[i, first] > dist
            live[i, first] = False
        return out

    def link(self, points: np.ndarray, neighbours: np.ndarray) -> None:
        """Edges from the points, and back to them; a list that would grow beyond DEGREE is pruned."""
        self.edges[points] = neighbours
        r, c = np.nonzero(neighbours >= 0)
        source, target = points[r], neighbours[r, c]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        to, start, count = np.unique(target, return_index=True, return_counts=True)
        for lo in range(0, len(to), self.batch):
            t, s, n = (x[lo : lo + self.batch] for x in (to, start, count))
            more = np.full((len(t), min(int(n.max()), 2 * BUILD_BEAM)), -1, np.int32)
            for k in range(more.shape[1]):
                more[n > k, k] = source[s[n > k] + k]
            both = np.hstack([self.edges[t], more])
            both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
            full = (both >= 0).sum(1) > DEGREE
            self.edges[t[~full]] = both[~full, :DEGREE]
            if full.any():
                self.edges[t[full]] = self.prune(t[full], both[full])

    def reached(self) -> np.ndarray:
        seen, front = np.zeros(len(self.x), bool), np.array([self.entry])
        seen[front] = True
        while len(front):
            front = np.unique(self.edges[front])
            front = front[front >= 0]
            front = front[~seen[front]]
            seen[front] = True
        return seen

    def connect(self) -> None:
        """An edge to every point that the entry doesn't reach, from the nearest point found that it does."""
        while not (seen := self.reached()).all():
            lost = np.flatnonzero(~seen)[: self.batch]
            ids, near = self.beam(self.x[lost], BUILD_BEAM)
            to = ids[np.arange(len(lost)), near.argmax(1)]
            for a, b in zip(to, lost, strict=True):
                free = np.flatnonzero(self.edges[a] < 0)
                if not len(free):  # a wider table rather than an edge less
                    self.edges = np.hstack([self.edges, np.full((len(self.edges), 8), -1, np.int32)])
                    free = np.flatnonzero(self.edges[a] < 0)
                self.edges[a, free[0]] = b


def build_graph(unit: np.ndarray, seed: int = 0) -> Graph:
    entry = int((unit @ unit.mean(0)).argmax())
    graph, order = Graph(unit, entry=entry), np.random.RandomState(seed).permutation(len(unit))
    order = np.concatenate([[entry], order[order != entry]]).astype(np.int32)
    done = 1
    while done < len(order):
        points = order[done : done + min(done, graph.batch)]
        ids, _ = graph.beam(unit[points], BUILD_BEAM)
        beside = unit[points] @ unit[points].T
        few = min(len(points), DEGREE // 2)
        mates = points[np.argpartition(-beside, few - 1, axis=1)[:, :few]]
        graph.link(points, graph.prune(points, np.hstack([ids, mates])))
        done += len(points)
    graph.connect()
    return graph


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors in doubles, each scaled by a power of two to components of at most 1: cosines stay the same to the bit."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of the rows of two matrices in doubles, summed from the first component to the last."""
    ab, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        ab += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return np.clip(ab / np.sqrt(aa * bb), -1.0, 1.0)


def _pieces(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Slices of the batches whose first ``keys`` columns agree, with their values."""
    for b in batches:
        cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if b.num_rows else []
        ends = [0, *cuts, b.num_rows]
        for lo, hi in zip(ends, ends[1:], strict=False):
            if hi > lo:
                yield tuple(int(c[lo]) for c in cols), b.slice(lo, hi - lo)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(dim, shard, ids, vec), sorted by shard, to (dim, shard, pos, ids, vec, edges), the entry first."""
    for (dim, shard), parts in groupby(_pieces(batches, 2), lambda x: x[0]):
        rows = pa.Table.from_batches([p for _, p in parts])
        graph = build_graph(_unit(_matrix(pa.concat_arrays(rows["vec"].chunks), dim)), shard)
        order = np.concatenate([[graph.entry], np.delete(np.arange(rows.num_rows), graph.entry)])
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        edges = [place[e[e >= 0]] for e in graph.edges[order]]
        rows = rows.take(pa.array(order))
        rows = pa.table({"dim": rows["dim"], "shard": rows["shard"], "pos": pa.array(np.arange(len(order), dtype=np.int32)), "ids": rows["ids"], "vec": rows["vec"], "edges": pa.array(edges, pa.list_(pa.int32()))})
        yield from rows.to_batches(4096)


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, shard_rows: int = SHARD_ROWS, scratch: Scratch | None = None) -> DataFrame:
    """The written index: dim, shard, pos, ids (the k + 1 smallest of equal vectors), vec, edges. Vectors of one length meet only."""
    scratch = scratch or Scratch(rows.sparkSession)
    points = rows.select(pick(rows, id_col).cast("long").alias("id"), pick(rows, vec_col).alias("vec")).where(usable(F.col("vec")))
    first = Window.partitionBy("vec").orderBy(F.asc_nulls_last("id"))  # cut down in each task before the shuffle
    points = points.withColumn("k", F.row_number().over(first)).where(F.col("k") <= k + 1)
    points = points.groupBy("vec").agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("ids"))  # k + 1 at most
    points = scratch.save(points.select(F.size("vec").alias("dim"), "vec", F.transform("ids", lambda x: x["id"]).alias("ids")), "points")
    floats = points.agg(F.sum("dim")).first()[0] or 0
    shards = -(-floats // (SHARD_DIM * shard_rows)) or 1
    dealt = points.select("dim", F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "ids", "vec")
    dealt = dealt.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "vec")
    kind = dict(points.dtypes)["vec"]
    return scratch.save(dealt.mapInArrow(_build, f"dim int, shard int, pos int, ids array<bigint>, vec {kind}, edges array<int>"), "index")


def _search(k: int, size: int):
    """An Arrow map over (dim, shard, part, query, pos, id, ids, vec, edges), sorted: a shard's points, then its queries."""

    def shard_of(dim: int, parts: list[pa.RecordBatch]) -> tuple[Graph, np.ndarray, list]:
        vecs = np.concatenate([_matrix(p.column(7), dim) for p in parts])
        edges = [e for p in parts for e in p.column(8).to_pylist()]
        wide = np.full((len(edges), max(map(len, edges), default=0) or 1), -1, np.int32)
        for i, e in enumerate(edges):
            wide[i, : len(e)] = e
        return Graph(_unit(vecs), wide), vecs, [ids for p in parts for ids in p.column(6).to_pylist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, *_), pieces in groupby(_pieces(batches, 4), lambda x: x[0][:3]):
            points, graph = [], None
            for key, piece in pieces:
                if not key[3]:
                    points.append(piece)
                    continue
                if graph is None:
                    if not points:
                        break  # no point of that length is in this shard
                    graph, vecs, ids = shard_of(dim, points)
                    points = []
                for lo in range(0, piece.num_rows, graph.batch):
                    yield answer(graph, vecs, ids, piece.slice(lo, graph.batch), dim)

    def answer(graph: Graph, vecs: np.ndarray, ids: list, asked: pa.RecordBatch, dim: int) -> pa.RecordBatch:
        queries, own = _matrix(asked.column(7), dim), asked.column(5).to_pylist()
        near, _ = graph.beam(_unit(queries), min(size, len(vecs)))
        r, c = np.nonzero(near >= 0)
        score = cosines(queries[r], vecs[near[r, c]])
        order = np.lexsort((-score, r))
        r, point, score = r[order], near[r, c][order], score[order]
        out: list[tuple] = []
        for q, found in groupby(range(len(r)), lambda i: r[i]):
            best: list[tuple] = []
            for i in found:
                if len(best) > k and score[i] < best[k - 1][0]:
                    break
                best += [(float(score[i]), x) for x in ids[point[i]] if x is None or x != own[q]]
                best.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
                del best[k + 1 :]
            out += [(own[q], x, s) for s, x in best[:k]]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.float64())], ["query_id", "vec_id", "score"])

    return run


def search(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k nearest found for each query row: query_id, rank (from 1), vec_id, score."""
    kind = dict(index.dtypes)["vec"]
    shards = index.agg(F.max("shard")).first()[0]
    asked = queries.select(pick(queries, id_col).cast("long").alias("id"), pick(queries, vec_col).cast(kind).alias("vec")).where(usable(F.col("vec"))).distinct()
    parts = -(-asked.count() // query_rows) or 1
    shards = 1 if shards is None else shards + 1
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<bigint>"), ("edges", "array<int>"))]
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(parts)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.select(F.size("vec").alias("dim"), "shard", "part", F.lit(1).alias("query"), F.lit(0).alias("pos"), "id", nothing[0], "vec", nothing[1])
    held = index.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(0).alias("query"), "pos", F.lit(None).cast("bigint").alias("id"), "ids", "vec", "edges")
    both = held.unionAll(asked).repartitionById(shards * parts, F.col("shard") * parts + F.col("part")).sortWithinPartitions("dim", "shard", "part", "query", "pos", "id")
    found = both.mapInArrow(_search(k, beam), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return found.select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, shard_rows: int = SHARD_ROWS, **options) -> DataFrame:
    """The k nearest found for each row whose id is divisible by ``every``, among all rows but its own.

    Columns: query_id, rank (from 1; ties to the smaller id, a null id last), vec_id, score (the cosine in doubles). Vectors that
    are null, empty or zero or hold a null, NaN or infinite component take no part; vectors meet only those of their length.
    Where ids repeat, rows equal in id and vector count once, a row with the query's id is never its neighbour, and queries that
    share an id share their k results. A null id asks nothing. An empty table gives no rows; other columns play no part.
    """
    index = build_index(rows, id_col, vec_col, k, shard_rows)
    return search(index, rows.where(pick(rows, id_col) % every == 0), id_col, vec_col, k, **options)


def op12_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: Exact search. The graphs find all of it on the small tables; recall on larger ones is tested against brute force.
ORACLE = f"""
with v as (select vec_id, embedding::double[] as e from embeddings where len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as query_id, b.vec_id, list_cosine_similarity(a.e, b.e) as score from v a join v b on a.vec_id % {EVERY} = 0 and a.vec_id <> b.vec_id and len(a.e) = len(b.e))
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from p qualify rank <= {K}
"""

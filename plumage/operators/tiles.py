"""Rasters as tiles of 256 x 256 places, so that a page's places travel as bytes rather than as a row each.

A tile is a row (keys, tx, ty, h, w, cells): the first h rows and w columns of it, as bytes or 32-bit numbers, 0 where nothing is set.
Whatever reaches over a tile's edge is met by copies of the tiles beside it, which are sent only where they touch that edge; x and
y are 0 or more. A task holds a bounded stack of tiles, however many rows a page or a tile has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.operators.batches import starts

SIDE = 256
#: Places that a task paints or compares at once.
MOST = 1 << 23


def schema_of(df: DataFrame, keys: list[str], columns: str) -> str:
    return ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + ", " + columns


def gathered(rows: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    """The rows of a tile in one partition, in order, next to each other."""
    return rows.repartition(*keys, "tx", "ty").sortWithinPartitions(*keys, "tx", "ty", *order)


def _starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where another tile begins, in rows that lie tile by tile."""
    return starts(t, [*keys, "tx", "ty"])


def _cells_of(x1, y1, x2, y2, at: np.ndarray, h: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place of rectangles, in their order: the rectangle's number and the place in a stack of h x w tiles."""
    wide, area = x2 - x1, (x2 - x1) * (y2 - y1)
    rect = np.repeat(np.arange(len(x1)), area)
    k = np.arange(len(rect)) - np.repeat(np.cumsum(area) - area, area)
    return rect, (at[rect] * h + y1[rect] + k // wide[rect]) * w + x1[rect] + k % wide[rect]


def _pieces(area: np.ndarray, most: int = MOST) -> Iterator[tuple[int, int]]:
    """Stretches of rows with about ``most`` places each, a row at least."""
    ends, i = np.cumsum(area), 0
    while i < len(area):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, "right")))
        yield i, j
        i = j


def painted_stacks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(a row with keys, tx, ty for each tile, their places as tiles x h x w), of gathered rectangles (keys, tx, ty, x1, y1, x2, y2, v) by v."""
    held: tuple[pa.Table, np.ndarray] | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        sides = {c: t[c].to_numpy().astype(np.int64) for c in ("x1", "y1", "x2", "y2", "v")}
        starts = _starts(t, keys)
        tile = np.zeros(t.num_rows, np.int64)
        tile[starts[1:]] = 1
        tile = np.cumsum(tile)
        tops = [np.maximum.reduceat(sides[c], starts) for c in ("y2", "x2")] if len(starts) else [np.zeros(0, np.int64)] * 2
        i, n = 0, len(starts)
        while i < n:  # tiles i to j are one stack
            j, h, w = i, 0, 0
            while j < n and (j == i or (j + 1 - i) * max(h, tops[0][j]) * max(w, tops[1][j]) <= MOST):
                h, w, j = max(h, int(tops[0][j])), max(w, int(tops[1][j])), j + 1
            first, last = int(starts[i]), int(starts[j]) if j < n else t.num_rows
            names = t.select([*keys, "tx", "ty"]).take(pa.array(starts[i:j]))
            same = held is not None and held[0].equals(names.slice(0, 1))
            if held is not None and same:
                h, w = max(h, held[1].shape[0]), max(w, held[1].shape[1])
            stack = np.zeros((j - i, h, w), np.int32)
            own = {c: a[first:last] for c, a in sides.items()}
            for a, z in _pieces((own["x2"] - own["x1"]) * (own["y2"] - own["y1"])):
                rect, place = _cells_of(*[own[c][a:z] for c in ("x1", "y1", "x2", "y2")], tile[first:last][a:z] - i, h, w)
                stack.reshape(-1)[place] = own["v"][a:z][rect]  # the last one counts, which is the largest
            if held is not None:
                if same:
                    y, x = held[1].shape
                    stack[0, :y, :x] = np.maximum(stack[0, :y, :x], held[1])
                else:
                    yield held[0], held[1][None]
            if j - i > 1:
                yield names.slice(0, j - i - 1), stack[:-1]
            held = names.slice(j - i - 1, 1), stack[-1].copy()
            i = j
    if held is not None:
        yield held[0], held[1][None]


def tiled(rects: DataFrame, keys: list[str], halo: int = 0) -> DataFrame:
    """The parts of rectangles (keys, x1, y1, x2, y2, v; right and bottom exclusive) in each tile and ``halo`` places around it, where x and y begin; v is above 0."""
    cut_to = lambda c, t: F.least(F.greatest(F.col(c) - F.col(t) * SIDE + halo, F.lit(0)), F.lit(SIDE + 2 * halo)).cast("int").alias(c)
    over = lambda a, z: F.explode(F.sequence(F.greatest(F.floor((F.col(a) - halo) / SIDE), F.lit(0)).cast("int"), F.floor((F.col(z) - 1 + halo) / SIDE).cast("int")))
    r = rects.where("x2 > x1 and y2 > y1 and v > 0").withColumn("tx", over("x1", "x2")).withColumn("ty", over("y1", "y2"))
    return r.select(*keys, "tx", "ty", cut_to("x1", "tx"), cut_to("y1", "ty"), cut_to("x2", "tx"), cut_to("y2", "ty"), F.col("v").cast("int").alias("v"))


def points(pixels: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Places (keys, x, y) as rectangles."""
    return pixels.select(*keys, F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("x") + 1).alias("x2"), (F.col("y") + 1).alias("y2"), value.alias("v"))


def table(names: pa.Table, at: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """A batch: the keys of tiles ``at``, and columns."""
    found = names.take(pa.array(at))
    for c, a in columns.items():
        found = found.append_column(c, a if isinstance(a, pa.Array) else pa.array(a))
    return found.combine_chunks().to_batches()


def by_stack(rects: DataFrame, keys: list[str], columns: str, fn: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, dict]]], halo: int = 0) -> DataFrame:
    """fn(stack, tx, ty) gives (number of its tile for each row, columns); the rows get the keys of their tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, stack in painted_stacks(batches, keys):
            tx, ty = (names[c].to_numpy().astype(np.int64) for c in ("tx", "ty"))
            for at, found in fn(stack, tx, ty):
                yield from table(names.select(keys), at, **found)

    return gathered(tiled(rects, keys, halo), keys, "v").mapInArrow(run, schema_of(rects, keys, columns))


def packed(stack: np.ndarray) -> pa.Array:
    kind = np.uint8 if not stack.size or stack.max() < 256 else np.int32
    return pa.array([g.astype(kind).tobytes() for g in stack], pa.binary())


def unpacked(cells: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(cells, np.uint8 if len(cells) == h * w else np.int32).reshape(h, w)


def places(rects: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, x, y, value): a row for each place that rectangles cover."""

    def rows(stack, tx, ty):
        for k in range(0, len(stack), step := max(1, (1 << 21) // max(1, stack[0].size))):
            n, y, x = np.nonzero(stack[k : k + step])
            yield n + k, {"x": (x + tx[n + k] * SIDE).astype(np.int32), "y": (y + ty[n + k] * SIDE).astype(np.int32), value: stack[k : k + step][n, y, x]}

    return by_stack(rects, keys, f"x int, y int, {value} int", rows)


def with_neighbours(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tx, ty, dx, dy, h, w, cells): each tile, and to each tile beside it a copy if it touches their common edge; dx, dy is where it lies.

    A tile whose edge is free hides nothing from the one beside it: each place of it is further off than a free one.
    """

    def rows(stack, tx, ty):
        n, h, w = stack.shape
        touch = {}
        for d, line in (((-1, 0), stack[:, :, :1]), ((1, 0), stack[:, :, SIDE - 1 :]), ((0, -1), stack[:, :1]), ((0, 1), stack[:, SIDE - 1 :])):
            touch[d] = line.reshape(n, -1).any(1) if line.size else np.zeros(n, bool)
        cells = packed(stack)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                hit = np.ones(n, bool) if not dx and not dy else (touch[dx, 0] if dx else False) | (touch[0, dy] if dy else False)
                at = np.flatnonzero(hit & (tx + dx >= 0) & (ty + dy >= 0))
                if len(at):
                    same = lambda v: np.full(len(at), v, np.int32)
                    yield at, {"tx": (tx[at] + dx).astype(np.int32), "ty": (ty[at] + dy).astype(np.int32), "dx": same(-dx), "dy": same(-dy), "h": same(h), "w": same(w), "cells": cells.take(pa.array(at))}

    return gathered(by_stack(rects, keys, "tx int, ty int, dx int, dy int, h int, w int, cells binary", rows), keys)


def _canvases(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int, bytes, int, int]]]]:
    """(a row with keys, tx, ty, its tile's and neighbours' cells), tile by tile; tiles that only others touch are left out."""
    held, cells = None, []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        starts = set(_starts(t, keys).tolist())
        names = t.select([*keys, "tx", "ty"])
        rest = list(zip(*[t[c].to_pylist() for c in ("dx", "dy", "cells", "h", "w")]))
        for i, row in enumerate(rest):
            if i in starts and not (i == 0 and held is not None and held.equals(names.slice(0, 1))):
                if held is not None and any(c[:2] == (0, 0) for c in cells):
                    yield held, cells
                held, cells = names.slice(i, 1), []
            cells.append(row)
    if held is not None and any(c[:2] == (0, 0) for c in cells):
        yield held, cells


def around_stacks(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray, int]]:
    """(a row for each tile, a stack, its margin): tiles alone with a margin of 0, a tile that others touch with one of SIDE on each side."""
    alone: list[tuple[pa.Table, np.ndarray]] = []

    def stacked():
        h, w = (max(g.shape[i] for _, g in alone) for i in (0, 1))
        stack = np.zeros((len(alone), h, w), np.int32)
        for k, (_, g) in enumerate(alone):
            stack[k, : g.shape[0], : g.shape[1]] = g
        return pa.concat_tables([n for n, _ in alone]), stack, 0

    size = 0
    for name, cells in _canvases(batches, keys):
        if len(cells) == 1:
            g = unpacked(*cells[0][2:])
            if alone and (size := size + g.size) > MOST // 4:
                yield stacked()
                alone, size = [], g.size
            alone.append((name, g))
        else:
            canvas = np.zeros((3 * SIDE, 3 * SIDE), np.int32)
            for dx, dy, c, h, w in cells:
                canvas[(dy + 1) * SIDE : (dy + 1) * SIDE + h, (dx + 1) * SIDE : (dx + 1) * SIDE + w] = unpacked(c, h, w)
            yield name, canvas[None], SIDE
    if alone:
        yield stacked()


def component_roots(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places set in a stack, as flat numbers; for each the first place of its connected area, diagonals included)."""
    places = np.flatnonzero(mask)
    number = np.full(mask.shape, -1, np.int64)
    number.reshape(-1)[places] = np.arange(len(places))
    near = [(number[:, :, :-1], number[:, :, 1:]), (number[:, :-1], number[:, 1:]), (number[:, :-1, :-1], number[:, 1:, 1:]), (number[:, :-1, 1:], number[:, 1:, :-1])]
    both = [(a >= 0) & (b >= 0) for a, b in near]
    a, b = (np.concatenate([pair[k][m] for pair, m in zip(near, both)]) for k in (0, 1))
    root = np.arange(len(places))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (root != (after := root[root])).any():
            root = after
    return places, places[root]


def edge_distances(stack: np.ndarray) -> np.ndarray:
    """Each place's distance to the nearest one with another label, rounded up, 255 at most; 0 without a label; all around is outside."""
    n, h, w = stack.shape
    own = stack > 0

    def run(axis: int) -> np.ndarray:
        """The lesser of the steps to both ends of the unbroken run along the axis."""
        v = np.moveaxis(stack, axis, 0)
        size = len(v)
        ahead, back = np.ones(v.shape, np.int32), np.ones(v.shape, np.int32)
        for i in range(1, size):
            ahead[i] += np.where(v[i] == v[i - 1], ahead[i - 1], 0)
            back[size - 1 - i] += np.where(v[size - 1 - i] == v[size - i], back[size - i], 0)
        return np.ascontiguousarray(np.moveaxis(np.minimum(ahead, back), 0, axis))

    g, up = run(2).reshape(-1), run(1).reshape(-1)
    far = np.minimum(np.minimum(g, up), SIDE)
    best = far.astype(np.int64) ** 2
    at, k = np.flatnonzero(own.reshape(-1) & (far > 1)), 1
    while len(at):
        for beside in (at - k * w, at + k * w):  # in the same run, as the run's ends are further off than k
            best[at] = np.minimum(best[at], g[beside].astype(np.int64) ** 2 + k * k)
        k += 1
        at = at[far[at] > k]
    return np.where(own, np.minimum(np.ceil(np.sqrt(best)), 255).astype(np.int32).reshape(stack.shape), 0)


def whole(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tx, ty, h, w, cells): painted tiles."""

    def rows(stack, tx, ty):
        n, h, w = stack.shape
        yield np.arange(n), {"tx": tx.astype(np.int32), "ty": ty.astype(np.int32), "h": np.full(n, h, np.int32), "w": np.full(n, w, np.int32), "cells": packed(stack)}

    return by_stack(rects, keys, "tx int, ty int, h int, w int, cells binary", rows)


def probed(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
    """(number of its tile for each row, a stack, rows): a tile (with cells) and the rows that follow it, without those that have no tile."""
    held: tuple[pa.Table, np.ndarray] | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        starts = _starts(t, keys)
        tile = np.zeros(t.num_rows, np.int64)
        tile[starts[1:]] = 1
        tile = np.cumsum(tile)
        has = t["cells"].is_valid().to_numpy()
        grids: list[np.ndarray | None] = [None] * len(starts)
        names = t.select([*keys, "tx", "ty"])
        if held is not None and held[0].equals(names.slice(0, 1)):
            grids[0] = held[1]
        cells = t.filter(pa.array(has))
        for k, c, h, w in zip(tile[has].tolist(), cells["cells"].to_pylist(), cells["h"].to_pylist(), cells["w"].to_pylist()):
            grids[k] = unpacked(c, h, w)
        if len(starts):
            held = (names.slice(int(starts[-1]), 1), grids[-1]) if grids[-1] is not None else None
        ask = np.flatnonzero(~has & np.array([g is not None for g in grids], bool)[tile]) if len(starts) else []
        while len(ask):
            first, h, w, j = tile[ask[0]], 0, 0, 0
            for j in range(first, len(grids)):  # tiles from the first on, as many as fit
                if (g := grids[j]) is None:
                    continue
                if j > first and (j - first + 1) * max(h, g.shape[0]) * max(w, g.shape[1]) > MOST:
                    j -= 1
                    break
                h, w = max(h, g.shape[0]), max(w, g.shape[1])
            stack = np.zeros((j - first + 1, h, w), np.int32)
            for k in range(first, j + 1):
                if grids[k] is not None:
                    stack[k - first, : grids[k].shape[0], : grids[k].shape[1]] = grids[k]
            now = ask[tile[ask] <= j]
            yield tile[now] - first, stack, t.take(pa.array(now))
            ask = ask[len(now):]

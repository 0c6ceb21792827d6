"""Painted labels and what lies in them: distances to the edge, safe boxes, filled areas, and outlines.

Rows are pixels (page, x, y, label), label 0 being none. Distances go along rows, then down columns; both are painted and measured in
tiles; holes are runs of free places joined over neighbouring rows; outlines are followed in tiles, and what leaves a tile is put in order
by doubling. Only the choice of a box inside one label takes that label's pixels into one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.functions.geometry import area, box
from plumage.operators import batches as batches_
from plumage.operators import borders, tiles
from plumage.operators.areas import grown_mask
from plumage.operators.detect import by_page, majority_label
from plumage.operators.lineage import cut
from plumage.operators.masks import in_areas
from plumage.operators.nodes import united
from plumage.operators.raster import largest_rectangle

#: The share of a label's shorter side that is kept free of text, by writing mode, in hundredths.
PADDING = {"horizontal": 12, "vertical": 20}


def paint(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Rectangles (page_id, x1, y1, x2, y2, v) to paint: boxes in the image, v their numbers by area (255 at most), smaller ones higher."""
    order = F.row_number().over(by_page(F.desc("_area"), "box_id"))
    b = boxes.withColumn("_area", area(box()).cast("long")).withColumn("v", order).where("v <= 255")
    return b.selectExpr("page_id", "greatest(x1, 0) as x1", "greatest(y1, 0) as y1", f"least(x2, {width}) as x2", f"least(y2, {height}) as y2", "v")


def painted(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """(page_id, x, y, label): boxes numbered by area (255 at most) and painted in that order, smaller ones over larger ones.

    Right and bottom edges are exclusive. A place gets the largest number over it; only boxes are shuffled, and painted in tiles.
    """
    return tiles.places(paint(boxes, width, height), ["page_id"], "label")


def _with_distances(rects: DataFrame, keys: list[str], columns: str, fn) -> DataFrame:
    """fn(labels, distances, x, y of each tile's corner) gives (number of its tile for each row, columns), tile by tile of painted rectangles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, stack, margin in tiles.around_stacks(batches, keys):
            dist = tiles.edge_distances(stack)
            if margin:
                stack, dist = (a[:, margin : 2 * margin, margin : 2 * margin] for a in (stack, dist))
            x, y = (names[c].to_numpy().astype(np.int64) * tiles.SIDE for c in ("tx", "ty"))
            for at, found in fn(stack, dist, x, y):
                yield from tiles.table(names.select(keys), at, **found)

    return tiles.with_neighbours(rects, keys).mapInArrow(run, tiles.schema_of(rects, keys, columns))


def distances(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, x, y, dist) of painted rectangles: tiles travel, with copies of those beside them, as 255 reaches no further."""

    def rows(stack, dist, left, top):
        n, y, x = np.nonzero(stack)
        yield n, {"label": stack[n, y, x], "x": (x + left[n]).astype(np.int32), "y": (y + top[n]).astype(np.int32), "dist": dist[n, y, x]}

    return _with_distances(rects, keys, "label int, x int, y int, dist int", rows)


def edge_distance(pixels: DataFrame) -> DataFrame:
    """(page, label, x, y, dist): each labelled pixel's distance to the nearest place outside its label, rounded up, 255 at most.

    Everything outside the pixels given is outside. First along each row, then the least of squared row distance and squared
    step over the column's run, no further than either of both already known.
    """
    own = tiles.points(pixels.where("label > 0").withColumnRenamed("label", "own"), ["page", "own"], F.lit(1))
    return distances(own, ["page", "own"]).select("page", F.col("own").alias("label"), "x", "y", "dist")


def _half_up(a: int, b: int) -> int:
    return (2 * a + b) // (2 * b)


def safe_box(dist: np.ndarray, share: int) -> tuple[int, int, int, int, int]:
    """(left, top, right, bottom, threshold) inside a label's grid of distances (0 outside the label).

    The padding asked for is ``share`` hundredths of the shorter side; where no place is that far in, three quarters, half, a
    quarter, 1 are tried, all against the largest distance. The largest rectangle of safe places is taken, of equal ones
    that nearest the middle of the safe places, or the innermost place where the middle is too near the edge.
    """
    height, width = dist.shape
    asked = min(255, max(1, _half_up(min(width, height) * share, 100)))
    most = int(dist.max())
    threshold = next(max(t, 1) for t in (asked, min(255, 3 * asked) // 4, asked // 2, asked // 4, 1) if max(t, 1) <= most)
    safe = dist >= threshold
    ys, xs = np.nonzero(safe)
    cx, cy = (min(n - 1, _half_up(int(v.sum()), len(v))) for v, n in ((xs, width), (ys, height)))
    if 10 * int(dist[cy, cx]) < 7 * most:
        cy, cx = divmod(int(dist.argmax()), width)
    if not safe[cy, cx]:
        k = int(((xs - cx) ** 2 + (ys - cy) ** 2).argmin())
        cx, cy = int(xs[k]), int(ys[k])
    return (*largest_rectangle(safe, (cx + 0.5, cy + 0.5)), threshold)


#: Labels of at most so many places on a side are judged together.
SMALL = 64


def safe_boxes_of(dist: np.ndarray, height: np.ndarray, width: np.ndarray, share: int) -> np.ndarray:
    """What ``safe_box`` gives for each of a stack of labels, their grids in its upper left corner; rows of five."""
    n, h, w = dist.shape
    flat, i = dist.reshape(n, -1), np.arange(n)
    asked = np.minimum(255, np.maximum(1, (2 * np.minimum(width, height) * share + 100) // 200))
    most = flat.max(1)
    threshold = np.ones(n, np.int64)
    for t in (asked // 4, asked // 2, np.minimum(255, 3 * asked) // 4, asked):
        threshold = np.where(np.maximum(t, 1) <= most, np.maximum(t, 1), threshold)
    safe = dist >= threshold[:, None, None]
    count, xs, ys = safe.sum((1, 2)), np.arange(w), np.arange(h)
    cx = np.minimum(width - 1, (2 * (safe.sum(1) * xs).sum(1) + count) // (2 * count))
    cy = np.minimum(height - 1, (2 * (safe.sum(2) * ys).sum(1) + count) // (2 * count))
    inner = flat.argmax(1)
    off = 10 * dist[i, cy, cx] < 7 * most
    cx, cy = np.where(off, inner % w, cx), np.where(off, inner // w, cy)
    away = (xs[None, None] - cx[:, None, None]) ** 2 + (ys[None, :, None] - cy[:, None, None]) ** 2
    near = np.where(safe, away, 1 << 30).reshape(n, -1).argmin(1)
    free = ~safe[i, cy, cx]
    cx, cy = np.where(free, near % w, cx), np.where(free, near // w, cy)
    tall = np.zeros((h, n, w), np.int64)
    for y in range(h):
        tall[y] = np.where(safe[:, y], (tall[y - 1] if y else 0) + 1, 0)
    tall = np.ascontiguousarray(tall.transpose(2, 1, 0))  # by column, so that a stretch of columns is compared at once
    best = np.zeros(n, np.int64)
    for left in range(w):
        high = tall[left]
        for right in range(left + 1, w + 1):
            high = np.minimum(high, tall[right - 1]) if right - 1 > left else high
            if not high.any():
                break
            far = (left + right - 2 * cx[:, None] - 1) ** 2 + (2 * (ys + 1)[None] - high - 2 * cy[:, None] - 1) ** 2
            # the largest, nearest, upper, left, tallest: one number, 13, 16, 7, 7 and 7 bits from the top
            key = ((((high * (right - left)) << 16 | 65535 - far) << 7 | 127 - ys[None]) << 7 | 127 - right) << 7 | high
            best = np.maximum(best, np.where(high > 0, key, 0).max(1))
    high, right, y, size = best & 127, 127 - (best >> 7 & 127), 127 - (best >> 14 & 127), best >> 37
    return np.stack([right - size // high, y + 1 - high, right, y + 1, threshold], 1)


def _crops(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, x0, y0, h, w, cells): each label's distances in each tile, as bytes in its bounds there."""

    def rows(stack, dist, left, top):
        n, y, x = np.nonzero(stack)
        v = stack[n, y, x].astype(np.int64)
        order = np.argsort(n * (1 << 32) + v, kind="stable")
        n, y, x, v = n[order], y[order], x[order], v[order]
        new = np.flatnonzero(np.concatenate([[True], (n[1:] != n[:-1]) | (v[1:] != v[:-1])]))
        group = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(n))))
        x0, x1, y0, y1 = (f.reduceat(a, new) for a in (x, y) for f in (np.minimum, np.maximum))
        h, w = y1 - y0 + 1, x1 - x0 + 1
        ends = np.append(0, np.cumsum(h * w))
        cells = np.zeros(ends[-1], np.uint8)
        cells[ends[group] + (y - y0[group]) * w[group] + x - x0[group]] = dist[n, y, x]
        held = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells)])
        at = n[new]
        yield at, {"label": v[new].astype(np.int32), "x0": (x0 + left[at]).astype(np.int32), "y0": (y0 + top[at]).astype(np.int32), "h": h.astype(np.int32), "w": w.astype(np.int32), "cells": held}

    return _with_distances(rects, keys, "label int, x0 int, y0 int, h int, w int, cells binary", rows)


def _boxes_in(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, mode, x, y, w, h, threshold): both modes' safe boxes of painted rectangles' labels. A label is one task's."""

    def whole(frame: list[tuple]) -> tuple[int, int, np.ndarray]:
        left, top = min(r[0] for r in frame), min(r[1] for r in frame)
        grid = np.zeros((max(r[1] + r[2] for r in frame) - top, max(r[0] + r[3] for r in frame) - left), np.uint8)
        for x, y, h, w, cells in frame:
            part = grid[y - top : y - top + h, x - left : x - left + w]
            np.maximum(part, np.frombuffer(cells, np.uint8).reshape(h, w), out=part)
        return left, top, grid

    def judged(names: list[tuple], found: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        out = []
        for share_of, share in PADDING.items():
            sizes: dict[int, list[int]] = {}
            for i, (_, _, g) in enumerate(found):
                sizes.setdefault(0 if max(g.shape) > SMALL else max(8, 1 << (g.shape[1] - 1).bit_length()), []).append(i)
            for size, members in sizes.items():
                if size:
                    height, width = (np.array([found[i][2].shape[k] for i in members]) for k in (0, 1))
                    stack = np.zeros((len(members), height.max(), width.max()), np.int64)
                    for k, i in enumerate(members):
                        stack[k, : height[k], : width[k]] = found[i][2]
                    boxes = safe_boxes_of(stack, height, width, share).tolist()
                else:
                    boxes = [safe_box(found[i][2].astype(np.int64), share) for i in members]
                out += [(*names[i], share_of, found[i][0] + b[0], found[i][1] + b[1], b[2] - b[0], b[3] - b[1], b[4]) for i, b in zip(members, boxes)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, columns = None, [*keys, "label", "mode", "x", "y", "w", "h", "threshold"]
        name, frame, names, found = None, [], [], []

        def done():
            kind = pa.schema([*[pa.field(k, kinds.field(k).type) for k in [*keys, "label"]], pa.field("mode", pa.string()), *[pa.field(c, pa.int32()) for c in columns[-5:]]])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*judged(names, found)), kind)], schema=kind)

        for batch in batches:
            kinds = batch.schema
            for row in zip(*[batch[c].to_pylist() for c in [*keys, "label", "x0", "y0", "h", "w", "cells"]]):
                if frame and row[:-5] != name:
                    names.append(name)
                    found.append(whole(frame))
                    frame = []
                    if len(names) >= 2000:
                        yield done()
                        names, found = [], []
                name = row[:-5]
                frame.append(row[-5:])
        if frame:
            names.append(name)
            found.append(whole(frame))
            yield done()

    crops = _crops(rects, keys)
    rows = crops.repartition(*keys, "label").sortWithinPartitions(*keys, "label")
    return rows.mapInArrow(run, tiles.schema_of(crops, [*keys, "label"], "mode string, x int, y int, w int, h int, threshold int"))


def painted_safe_boxes(rects: DataFrame) -> DataFrame:
    """``safe_boxes`` of painted rectangles (page, x1, y1, x2, y2, v)."""
    return _boxes_in(rects, ["page"])


def safe_boxes(pixels: DataFrame) -> DataFrame:
    """(page, label, mode, x, y, w, h, threshold): the box that text may fill in each label, for both writing modes. A label is one task's."""
    own = tiles.points(pixels.where("label > 0").withColumnRenamed("label", "own"), ["page", "own"], F.lit(1))
    return _boxes_in(own, ["page", "own"]).select("page", F.col("own").alias("label"), "mode", "x", "y", "w", "h", "threshold")


def painted_seed_labels(rects: DataFrame, seeds: DataFrame, width: int, height: int) -> DataFrame:
    """(page, seed, mode, label): the label that most places of each seed rectangle (page, seed, mode, x1, y1, x2, y2) have; of equal ones the highest.

    rects: (page, x1, y1, x2, y2, v), painted. A seed is moved into the image and holds a place at least; one without a labelled
    place has no row. Seeds go to the tiles that they touch and count there.
    """
    inner = lambda c, n: F.least(F.greatest(F.floor(c), F.lit(0)), F.lit(n - 1))
    s = seeds.withColumns({"x1": inner("x1", width), "y1": inner("y1", height)})
    s = s.withColumns({"x2": F.least(F.greatest(F.ceil("x2"), F.col("x1") + 1), F.lit(width)), "y2": F.least(F.greatest(F.ceil("y2"), F.col("y1") + 1), F.lit(height))})
    inside_one = " and ".join(f"floor({c}1 / {tiles.SIDE}) = floor(({c}2 - 1) / {tiles.SIDE})" for c in "xy")
    asked = tiles.tiled(s.withColumn("v", F.expr(f"if({inside_one}, 2, 1)")), ["page", "seed", "mode"])
    both = tiles.whole(rects, ["page"]).unionByName(asked, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, stack, rows in tiles.probed(batches, ["page"]):
            h, w = stack.shape[1:]
            x1, y1, x2, y2 = (rows[c].to_numpy().astype(np.int64) for c in ("x1", "y1", "x2", "y2"))
            whole_seed = rows["v"].to_numpy() == 2
            x2, y2 = np.minimum(x2, w), np.minimum(y2, h)
            x1, y1 = np.minimum(x1, x2), np.minimum(y1, y2)
            for a, z in tiles._pieces((x2 - x1) * (y2 - y1)):
                rect, place = tiles._cells_of(x1[a:z], y1[a:z], x2[a:z], y2[a:z], names[a:z], h, w)
                v = stack.reshape(-1)[place].astype(np.int64)
                pair, n = np.unique((rect << 32 | v)[v > 0], return_counts=True)
                if whole_seed[a:z].all():  # counted here to the end: the label that wins
                    order = np.lexsort((pair, n, pair >> 32))
                    last = np.append(np.diff(pair[order] >> 32) != 0, True)[: len(order)]
                    pair, n = pair[order][last], n[order][last]
                yield from tiles.table(rows.select(["page", "seed", "mode"]), a + (pair >> 32), label=(pair & (1 << 32) - 1).astype(np.int32), n=n.astype(np.int64))

    counts = tiles.gathered(both, ["page"], F.col("cells").isNull()).mapInArrow(run, tiles.schema_of(s, ["page", "seed", "mode"], "label int, n bigint"))
    counts = counts.repartition("page", "seed", "mode").groupBy("page", "seed", "mode", "label").agg(F.sum("n").alias("n"))
    return counts.groupBy("page", "seed", "mode").agg(F.max_by("label", F.struct("n", "label")).alias("label"))


def painted_layout_boxes(rects: DataFrame, seeds: DataFrame, width: int, height: int) -> DataFrame:
    """(page, seed, label, x, y, w, h): the safe box of the label under each seed rectangle (page, seed, mode, x1, y1, x2, y2); rects are painted."""
    found = painted_seed_labels(rects, seeds, width, height)
    return found.join(painted_safe_boxes(rects), ["page", "label", "mode"]).select("page", "seed", "label", "x", "y", "w", "h")


def layout_boxes(pixels: DataFrame, seeds: DataFrame, width: int, height: int) -> DataFrame:
    """``painted_layout_boxes`` of pixels (page, x, y, label), one label a place."""
    return painted_layout_boxes(tiles.points(pixels.where("label > 0"), ["page"], F.col("label")), seeds, width, height)


def enclosed_here(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``enclosed`` of pixels (keys, x, y, wx1, wy1, wx2, wy2) with their window, whose sides are 256 at most, so that it is one tile.

    Free places past the last pixels of a window are open, like those at its border.
    """

    def rows(stack, tx, ty):
        n, h, w = stack.shape
        places, roots = tiles.component_roots(stack == 0)
        rim = (places % w == 0) | (places % w == w - 1) | (places // w % h == 0) | (places // w % h == h - 1)
        is_open = np.zeros(stack.size, bool)
        is_open[roots[rim]] = True
        shut = places[~is_open[roots]]
        yield shut // (h * w), {"x": (shut % w).astype(np.int32), "y": (shut // w % h).astype(np.int32)}

    fits = F.assert_true((F.col("wx2") - F.col("wx1") <= tiles.SIDE) & (F.col("wy2") - F.col("wy1") <= tiles.SIDE), F.lit("a window is larger than a tile"))
    inner = pixels.select(*keys, "wx1", "wy1", (F.col("x") - F.col("wx1")).alias("x"), (F.col("y") - F.col("wy1")).alias("y"), F.coalesce(fits.cast("int"), F.lit(1)).alias("v"))
    found = tiles.by_stack(tiles.points(inner, [*keys, "wx1", "wy1"], F.col("v")), [*keys, "wx1", "wy1"], "x int, y int", rows)
    return found.select(*keys, (F.col("x") + F.col("wx1")).alias("x"), (F.col("y") + F.col("wy1")).alias("y"))


def enclosed(pixels: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): the free places of each window that no path of free places, diagonals included, joins to the window's border.

    pixels: (keys, x, y), all inside their window; windows: (keys, wx1, wy1, wx2, wy2; right and bottom exclusive), at least one for each
    key that has pixels. Free places are runs between a row's pixels; runs of neighbouring rows that touch are joined. Rows without
    pixels and runs at an edge are the border, so none of the free area outside becomes a row.
    """
    row = Window.partitionBy(*keys, "y").orderBy("x")
    p = pixels.select(*keys, "x", "y").distinct().withColumn("next", F.lead("x").over(row)).withColumn("prior", F.lag("x").over(row))
    p = p.join(windows.select(*keys, "wx1", "wy1", "wx2", "wy2"), keys)
    inner = p.where("next > x + 1").select(*keys, "y", (F.col("x") + 1).alias("a"), (F.col("next") - 1).alias("z"), ((F.col("y") == F.col("wy1")) | (F.col("y") == F.col("wy2") - 1)).alias("open"))
    first = p.where("prior is null and x > wx1").select(*keys, "y", F.col("wx1").alias("a"), (F.col("x") - 1).alias("z"), F.lit(True).alias("open"))
    last = p.where("next is null and x < wx2 - 1").select(*keys, "y", (F.col("x") + 1).alias("a"), (F.col("wx2") - 1).alias("z"), F.lit(True).alias("open"))
    # a row beside one with pixels that has none of its own is open from end to end
    rows = p.select(*keys, "y", "wx1", "wy1", "wx2", "wy2").distinct()
    beside = rows.withColumn("y", F.explode(F.array(F.col("y") - 1, F.col("y") + 1))).where("y >= wy1 and y < wy2").distinct().join(rows.select(*keys, "y"), [*keys, "y"], "left_anti")
    empty = beside.select(*keys, "y", F.col("wx1").alias("a"), (F.col("wx2") - 1).alias("z"), F.lit(True).alias("open"))
    runs = inner.unionAll(first).unionAll(last).unionAll(empty)
    runs = cut(runs.withColumn("c", F.col("y").cast("long") * (1 << 20) + F.col("a")))
    above = runs.select(*keys, (F.col("y") + 1).alias("y"), F.col("a").alias("oa"), F.col("z").alias("oz"), F.col("c").alias("d"))
    touch = runs.join(above, [*keys, "y"]).where("oa <= z + 1 and oz >= a - 1").select(*keys, "c", "d")
    touch = cut(touch.unionAll(touch.select(*keys, F.col("d").alias("c"), F.col("c").alias("d"))))
    found = united(runs.select(*keys, "c", F.when(F.col("open"), F.lit(-1)).otherwise(F.col("c")).cast("long").alias("l")), touch, keys)
    shut = runs.join(found.where("l >= 0").select(*keys, "c"), [*keys, "c"], "left_semi")
    return shut.select(*keys, F.explode(F.sequence("a", "z")).alias("x"), "y")


def _voted(own: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, area, bound): every area with pixels of its own, and the label above 0 that most of those have, if any has one."""
    vote = majority_label(own.select("page", "area", "x", "y").join(labels.where("label > 0"), ["page", "x", "y"]), "page", "area")
    return own.select("page", "area").distinct().join(vote.select("page", "area", F.col("label").alias("bound")), ["page", "area"], "left")


def _bounded(places: DataFrame, labels: DataFrame) -> DataFrame:
    """(page, x, y): the places (page, x, y, bound) whose label is their bound, or that have none."""
    at = places.select("page", "x", "y", "bound").distinct().join(labels.select("page", "x", "y", "label"), ["page", "x", "y"], "left")
    return at.where("bound is null or coalesce(label, 0) = bound").select("page", "x", "y").distinct()


def _whole_areas(pixels: DataFrame, areas: DataFrame, labels: DataFrame, width: int, height: int) -> DataFrame:
    """``whole`` of ``areas.covered`` for areas of any size, row by row."""
    own = in_areas(pixels, areas, F.col("r"), width, height)
    real = own.select("page", "area", "wx1", "wy1", "wx2", "wy2").distinct().join(_voted(own, labels), ["page", "area"])
    places = real.select("page", "bound", "wx1", "wx2", F.explode(F.expr("sequence(wy1, wy2 - 1)")).alias("y")).select("page", "bound", "y", F.explode(F.expr("sequence(wx1, wx2 - 1)")).alias("x"))
    return _bounded(places, labels)


def _closed_areas(pixels: DataFrame, areas: DataFrame, labels: DataFrame, width: int, height: int) -> DataFrame:
    """``closed`` of ``areas.covered`` for areas of any size, row by row."""
    areas = cut(areas)
    near = in_areas(pixels, areas, F.col("r"), width, height)
    bound = _voted(near.where("x >= x1 and x < x2 and y >= y1 and y < y2"), labels)
    out = near.select("page", "area", "x", "y", "r", "wx1", "wy1", "wx2", "wy2")
    for axis in "xy":  # a square goes line by line
        out = out.withColumn(axis, F.explode(F.sequence(F.col(axis) - F.col("r"), F.col(axis) + F.col("r")))).where(f"{axis} >= w{axis}1 and {axis} < w{axis}2").distinct()
    grown = cut(out.select("page", "area", "x", "y"))
    windows = near.select("page", "area", "wx1", "wy1", "wx2", "wy2").distinct()
    filled = grown.unionByName(enclosed(grown, windows, ["page", "area"]).select("page", "area", "x", "y"))
    kept = filled.join(areas.select("page", "area", "x1", "y1", "x2", "y2"), ["page", "area"]).where("x >= x1 and x < x2 and y >= y1 and y < y2").join(bound, ["page", "area"])
    return _bounded(kept, labels)


def filled_regions(pixels: DataFrame, blocks: DataFrame, labels: DataFrame, width: int, height: int, ratio: float = 0.45, least: int = 3, most: int = 8) -> DataFrame:
    """A mask (page, x, y) grown for redrawing: whole text blocks, then each connected area outside them, grown and with its holes filled.

    blocks: (page, area, x1, y1, x2, y2, r), filled with a margin of r if they hold a pixel of the mask, inside the label that most of
    those pixels have. An area left over is grown by ``ratio`` of its shorter side, ``least`` to ``most``, as the window of twice
    that margin shows it; its holes are what is shut off inside the window. Without pixels in a page nothing is added to it.
    labels: (page, x, y, label), or rectangles (page, x1, y1, x2, y2, v) to paint.
    """
    return grown_mask(pixels, blocks, labels, width, height, (ratio, least, most), ("whole", "closed"), {"whole": _whole_areas, "closed": _closed_areas})


def _stacked(stack: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, np.ndarray, borders.Lines]]:
    """(number of the first tile, tiles, their lines), of tiles with a place around them, as many at a time as is handy."""
    n, h, w = stack.shape
    stack = np.pad(stack, ((0, 0), (0, int(h < tiles.SIDE + 2)), (0, int(w < tiles.SIDE + 2))))
    step = max(1, most // max(1, stack[:1].size))
    for k in range(0, n, step):
        part = stack[k : k + step]
        yield k, part, borders.lines(part)


def _lines(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, head, to, ring, before, n, s, points): borders of painted rectangles in each tile, rings (to is null) and stretches.

    ring is a line's lowest edge, before and n count its points up to that and in all, s is its part of twice the enclosed area.
    """

    def rows(stack, tx, ty):
        for k, part, found in _stacked(stack):
            _, h, w = part.shape

            def spot(place):
                at = k + place // (h * w)
                return place % w + tx[at] * tiles.SIDE - 1, place // w % h + ty[at] * tiles.SIDE - 1

            def edge(e):
                x, y = spot(e // 4)
                return ((y << 20) + x) * 4 + e % 4

            (x, y), (nx, ny) = spot(found.point), spot(found.beyond)
            points = pa.ListArray.from_arrays(pa.array(np.append(found.start, len(x)).astype(np.int32)), pa.array((y << 20) + x))
            to = pa.array(edge(np.maximum(found.to, 0)), mask=found.to < 0)
            label = part.reshape(-1)[found.head // 4].astype(np.int32)
            counts = {"before": found.before.astype(np.int32), "n": found.moves.astype(np.int32), "s": borders.sums(x * ny - nx * y, found)}
            yield k + found.head // (4 * h * w), {"label": label, "head": edge(found.head), "to": to, "ring": edge(found.first), **counts, "points": points}

    return tiles.by_stack(rects, keys, "label int, head bigint, to bigint, ring bigint, before int, n int, s bigint, points array<bigint>", rows, halo=1)


def _rings(rects: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, ring, start, n, area2, points): the outer borders of painted rectangles' areas, in a row for each tile that they pass.

    Points count from start on, around the ring of n. Rings inside a tile are known; of others, stretches (not edges) are ranked
    by doubling: after k rounds a stretch knows the lowest edge of the 2^k from it on, and how far it is.
    """
    group = [*keys, "label"]
    found = cut(_lines(rects, keys))
    rings = found.where("to is null").select(*group, "ring", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("n"), F.abs("s").alias("area2"), "points")
    open_ = found.where("to is not null")
    if open_.isEmpty():
        return rings
    now = cut(open_.select(*group, "head", "to", "ring", F.lit(0).cast("long").alias("off")))
    k = 0
    while True:
        ahead = now.select(*group, F.col("head").alias("to"), F.col("to").alias("far"), F.col("ring").alias("ring2"), F.col("off").alias("off2"))
        nearer = F.col("ring") <= F.col("ring2")
        both = now.join(ahead, [*group, "to"])
        now = cut(both.select(*group, "head", F.col("far").alias("to"), F.least("ring", "ring2").alias("ring"), F.when(nearer, F.col("off")).otherwise(F.col("off2") + (1 << k)).alias("off"), (F.col("ring") != F.col("ring2")).alias("changed")))
        k += 1
        if now.where("changed").isEmpty():
            break
    # Rings whose lowest edge isn't a left one run around holes. The stretch with the lowest edge comes first, and last, as far as that edge.
    whole = Window.partitionBy(*group, "ring")
    order = whole.orderBy(F.when(F.col("off") == 0, 0).otherwise(1), F.desc("off"))
    ranked = now.where("ring % 4 = 0").select(*group, "head", "ring", "off").join(open_.select(*group, "head", "before", "n", "s"), [*group, "head"])
    lead = F.max(F.when(F.col("off") == 0, F.col("before"))).over(whole)
    ahead = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = ranked.select(*group, "head", "ring", (ahead - lead).alias("start"), F.sum("n").over(whole).alias("n"), F.abs(F.sum("s").over(whole)).alias("area2"))
    return rings.unionByName(ranked.join(open_.select(*group, "head", "points"), [*group, "head"]).drop("head"))


def _largest(rings: DataFrame, group: list[str]) -> DataFrame:
    best = rings.where("area2 > 0").groupBy(*group).agg(F.max_by(F.struct("ring", "n"), F.struct("area2", -F.col("ring"))).alias("b")).where("b.n >= 4")
    return rings.join(best.select(*group, F.col("b.ring").alias("ring")), [*group, "ring"], "left_semi")


def _in_order(rings: DataFrame, *columns: str) -> DataFrame:
    """A row for each point: (columns of its ring, i, x, y)."""
    p = rings.select(*columns, "start", "n", F.posexplode("points").alias("_k", "_p"))
    place = lambda v: v.cast("int")
    return p.select(*columns, place((F.col("start") + F.col("_k") + F.col("n")) % F.col("n")).alias("i"), place(F.col("_p").bitwiseAND((1 << 20) - 1)).alias("x"), place(F.shiftright("_p", 20)).alias("y"))


def _own(pixels: DataFrame) -> DataFrame:
    return tiles.points(pixels.where("label > 0").withColumnRenamed("label", "own"), ["page", "own"], F.lit(1))


def outlines(pixels: DataFrame) -> DataFrame:
    """(page, label, ring, i, x, y, area2): the border pixels of each connected area of a label, in order, its outer border only.

    Areas include diagonals. A ring starts at its first pixel by row and goes down its left side; a pixel passed twice is there
    twice; area2 is twice the area of the polygon of pixel centres. ``ring`` names the border by its first pixel. Borders are followed
    in tiles; only what leaves a tile is put together over all.
    """
    found = _in_order(_rings(_own(pixels), ["page", "own"]), "page", "own", "ring", "area2")
    return found.select("page", F.col("own").alias("label"), "ring", "i", "x", "y", "area2")


def largest_outlines(pixels: DataFrame) -> DataFrame:
    """(page, label, i, x, y): the outline with the largest area of each label, of equal ones the first by row; none under four points or without area."""
    found = _in_order(_largest(_rings(_own(pixels), ["page", "own"]), ["page", "own"]), "page", "own")
    return found.select("page", F.col("own").alias("label"), "i", "x", "y")


def _numbered(found: borders.Lines, best: np.ndarray) -> np.ndarray:
    """0, 1, ... along each of the best lines."""
    moves = found.moves[best]
    return (np.arange(moves.sum()) - np.repeat(np.cumsum(moves) - moves, moves)).astype(np.int32)


def painted_largest_outlines(rects: DataFrame, width: int, height: int) -> DataFrame:
    """``largest_outlines`` of painted rectangles (page, x1, y1, x2, y2, v) in images of that size; those of one tile are chosen where they are followed."""
    if max(width, height) > tiles.SIDE:
        return _in_order(_largest(_rings(rects, ["page"]), ["page", "label"]), "page", "label")

    def rows(stack, tx, ty):
        for k, part, found in _stacked(stack):
            _, h, w = part.shape
            best, at = borders.largest(part, found)
            point = found.point[at]
            yield k + point // (h * w), {"label": part.reshape(-1)[point].astype(np.int32), "i": _numbered(found, best), "x": (point % w - 1).astype(np.int32), "y": (point // w % h - 1).astype(np.int32)}

    inner = rects.where(F.coalesce(F.assert_true((F.col("x2") <= tiles.SIDE) & (F.col("y2") <= tiles.SIDE), F.lit("a rectangle is out of the image")).cast("boolean"), F.lit(True)))
    return tiles.by_stack(inner, ["page"], "label int, i int, x int, y int", rows, halo=1)


def _stretched(boxes: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """(page, label, mx1, my1, mx2, my2, bw, bh): a box's part of a mask that is at ``scale`` of the page's size, and the size it is stretched to."""
    inner = lambda c, n: F.least(F.greatest(F.round(F.col(c) * scale), F.lit(0)), F.lit(n)).cast("int")
    b = boxes.select("page", "label", "x1", "y1", "x2", "y2", inner("x1", width).alias("mx1"), inner("y1", height).alias("my1"), inner("x2", width).alias("mx2"), inner("y2", height).alias("my2"))
    b = b.where("mx2 > mx1 and my2 > my1")
    size = lambda a, z: F.greatest(F.round(z) - F.round(a), F.lit(1)).cast("int")
    return b.select("page", "label", "mx1", "my1", "mx2", "my2", size("x1", "x2").alias("bw"), size("y1", "y2").alias("bh"))


def box_masks(mask: DataFrame, boxes: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """(page, label, x, y): a mask's pixels inside each box, stretched to the box's size, at places from the box's corner on.

    mask: (page, x, y), at ``scale`` of the page's size; boxes: (page, label, x1, y1, x2, y2). A place takes the mask's pixel under its centre.
    """
    b = _stretched(boxes, width, height, scale)
    spots = b.withColumn("y", F.explode(F.expr("sequence(0, bh - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, bw - 1)")))
    under = lambda c, n, lo, hi: (F.col(lo) + F.floor((F.col(c) + 0.5) * (F.col(hi) - F.col(lo)) / F.col(n))).cast("int")
    spots = spots.select("page", "label", "x", "y", under("x", "bw", "mx1", "mx2").alias("sx"), under("y", "bh", "my1", "my2").alias("sy"))
    return spots.join(mask.select("page", F.col("x").alias("sx"), F.col("y").alias("sy")).distinct(), ["page", "sx", "sy"], "left_semi").select("page", "label", "x", "y")


def _box_grids(stack: np.ndarray, at: np.ndarray, group: np.ndarray, sides: dict[str, np.ndarray], most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of groups, their grids with a free place around them): tiles' parts stretched to boxes, those of a group of boxes laid over each other."""
    stack = np.pad(stack, ((0, 0), (0, 1), (0, 1)))  # the last row and column are free
    begin = np.flatnonzero(np.append(True, np.diff(group) != 0))[: len(group)]
    wide, tall = (np.maximum.reduceat(sides[c], begin) for c in ("bw", "bh"))
    order = np.lexsort((tall, wide))
    row_of = np.argsort(np.argsort(order)[group], kind="stable")
    ends = np.cumsum(np.diff(np.append(begin, len(group)))[order])
    i = 0
    while i < len(order):  # groups of like size together
        j, h, w = i, 0, 0
        while j < len(order) and (j == i or (j + 1 - i) * (max(h, tall[order[j]]) + 2) * (wide[order[j]] + 2) <= most):
            h, w, j = max(h, int(tall[order[j]])), int(wide[order[j]]), j + 1
        grids = np.zeros((j - i, h + 2, w + 2), np.uint8)
        rows = row_of[ends[i - 1] if i else 0 : ends[j - 1]]
        place = np.argsort(order)[group[rows]] - i
        for k in range(0, len(rows), step := max(1, most // (h * w))):
            r = rows[k : k + step]

            def under(n, size, low, high, free):
                x = np.arange(n)[None]
                m = sides[low][r][:, None] + np.floor((x + 0.5) * (sides[high] - sides[low])[r][:, None] / sides[size][r][:, None]).astype(np.int64)
                return np.where(x < sides[size][r][:, None], np.minimum(m, free), free)

            mx, my = under(w, "bw", "mx1", "mx2", stack.shape[2] - 1), under(h, "bh", "my1", "my2", stack.shape[1] - 1)
            part = stack[at[r][:, None, None], my[:, :, None], mx[:, None, :]] > 0
            to = place[k : k + step]
            new = np.flatnonzero(np.append(True, np.diff(to) != 0))
            grids[to[new], 1:-1, 1:-1] |= np.logical_or.reduceat(part, new, axis=0) if len(new) < len(to) else part
        yield order[i:j], grids
        i = j


def box_outlines(mask: DataFrame, boxes: DataFrame, width: int, height: int, scale: float) -> DataFrame:
    """``largest_outlines`` of ``box_masks``. A mask of one tile meets its page's boxes, which are stretched and followed there.

    Larger masks, or boxes larger than a tile, go through pixels.
    """
    b = _stretched(boxes.where("label > 0"), width, height, scale)
    if max(width, height) > tiles.SIDE or not b.where(f"bw > {tiles.SIDE} or bh > {tiles.SIDE}").isEmpty():
        return largest_outlines(box_masks(mask, boxes, width, height, scale))
    inside = mask.where((F.col("x") < width) & (F.col("y") < height))
    both = tiles.whole(tiles.points(inside, ["page"], F.lit(1)), ["page"]).unionByName(b.withColumns({"tx": F.lit(0), "ty": F.lit(0)}), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, stack, rows in tiles.probed(batches_.unsplit(batches, ["page", "label"]), ["page"]):
            sides = {c: rows[c].to_numpy().astype(np.int64) for c in ("mx1", "my1", "mx2", "my2", "bw", "bh")}
            begin = batches_.starts(rows, ["page", "label"])
            group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(at))))
            for members, grids in _box_grids(stack, at, group, sides):
                _, h, w = grids.shape
                found = borders.lines(grids)
                best, k = borders.largest(grids, found)
                point = found.point[k]
                own = begin[members[point // (h * w)]]
                yield from tiles.table(rows.select(["page", "label"]), own, i=_numbered(found, best), x=(point % w - 1).astype(np.int32), y=(point // w % h - 1).astype(np.int32))

    rows = tiles.gathered(both, ["page"], F.col("cells").isNull(), "label")
    return rows.mapInArrow(run, tiles.schema_of(b, ["page", "label"], "i int, x int, y int"))

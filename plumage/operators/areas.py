"""Areas of a page (its text blocks, or connected pixels) grown or filled in tiles, each inside the label that its pixels have.

An area is one row, sent to the tile that its window's middle lies in. On pages larger than a tile, tiles see half a tile around
them, so that they hold every window of up to a tile; what ``beyond`` does is for larger ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.operators import tiles
from plumage.operators.lineage import cut
from plumage.operators.nodes import components

#: What areas become, and how often their r is added on all sides of their box for the window in which pixels count.
PAD = {"grown": 2, "whole": 1, "closed": 1}
#: Places of windows that are judged at once.
MOST = 1 << 19

Sides = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _bounds(mask: np.ndarray, lab: np.ndarray, at: np.ndarray, box: Sides) -> np.ndarray:
    """The label above 0 that most of each box's pixels have, of equal ones the highest; 0 if none has one."""
    (_, h, w), bound = mask.shape, np.zeros(len(at), np.int64)
    for a, z in tiles._pieces((box[2] - box[0]) * (box[3] - box[1]), MOST):
        rect, place = tiles._cells_of(*[s[a:z] for s in box], at[a:z], h, w)
        hit = mask.reshape(-1)[place]
        rect, v = rect[hit], lab.reshape(-1)[place[hit]].astype(np.int64)
        pair, n = np.unique((rect << 32 | v)[v > 0], return_counts=True)
        order = np.lexsort((pair, n, pair >> 32))  # the last of each box wins
        bound[a + (pair[order] >> 32)] = pair[order] & (1 << 32) - 1
    return bound


def _sums(mask: np.ndarray) -> np.ndarray:
    """The number of pixels above and to the left of each corner of a place."""
    n, h, w = mask.shape
    out = np.zeros((n, h + 1, w + 1), np.int32)
    np.cumsum(np.cumsum(mask, 1, dtype=np.int32), 2, out=out[:, 1:, 1:])
    return out


def _any(sums: np.ndarray, at: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray) -> np.ndarray:
    """Whether each rectangle holds a pixel."""
    _, h, w = sums.shape
    flat, top, bottom = sums.reshape(-1), (at * h + y1) * w, (at * h + y2) * w
    return flat[bottom + x2] - flat[top + x2] - flat[bottom + x1] + flat[top + x1] > 0


def _closed(grown: np.ndarray) -> np.ndarray:
    """Windows with their holes: free places that no path of free places, diagonals included, joins to the border."""
    _, h, w = grown.shape
    places, roots = tiles.component_roots(~grown)
    rim = (places % w == 0) | (places % w == w - 1) | (places // w % h == 0) | (places // w % h == h - 1)
    is_open = np.zeros(grown.size, bool)
    is_open[roots[rim]] = True
    out = grown.copy()
    out.reshape(-1)[places[~is_open[roots]]] = True
    return out


def _alike(wide: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of windows that fit into a stack of about MOST places, a window at least."""
    i = 0
    while i < len(wide):
        w, h = (np.maximum.accumulate(s[i : i + 4096]) for s in (wide, high))
        j = i + max(1, int(np.searchsorted(np.arange(1, len(w) + 1) * w * h, MOST, "right")))
        yield i, j
        i = j


def cover(kind: str, mask: np.ndarray, lab: np.ndarray, out: np.ndarray, at: np.ndarray, box: Sides, window: Sides, r: np.ndarray) -> None:
    """Sets in ``out`` what areas of a stack of tiles cover; at: their tiles."""
    _, h, w = mask.shape
    sums, asked = _sums(mask), window if kind == "whole" else box
    some = np.flatnonzero(_any(sums, at, *asked))
    if kind == "closed":  # windows of about the same size make up a stack
        some = some[np.argsort(((window[2] - window[0]) * (window[3] - window[1]))[some], kind="stable")]
    at, r, box, window, asked = at[some], r[some], *(tuple(s[some] for s in sides) for sides in (box, window, asked))
    bound = _bounds(mask, lab, at, asked)
    wide, high = window[2] - window[0], window[3] - window[1]
    for a, z in _alike(wide, high) if kind == "closed" else tiles._pieces(wide * high, MOST):
        own = tuple(s[a:z] for s in window)
        rect, place = tiles._cells_of(*own, at[a:z], h, w)
        fits = (bound[a:z][rect] == 0) | (lab.reshape(-1)[place] == bound[a:z][rect])
        x, y = place % w, place // w % h
        if kind != "whole":
            far, (x1, y1, x2, y2) = r[a:z][rect], (s[rect] for s in own)
            hit = _any(sums, at[a:z][rect], np.maximum(x - far, x1), np.maximum(y - far, y1), np.minimum(x + far + 1, x2), np.minimum(y + far + 1, y2))
            if kind == "closed":
                stack = np.zeros((z - a, int(high[a:z].max()), int(wide[a:z].max())), bool)
                zero = np.zeros(z - a, np.int64)
                _, inner = tiles._cells_of(zero, zero, wide[a:z], high[a:z], np.arange(z - a), *stack.shape[1:])
                stack.reshape(-1)[inner] = hit
                hit = _closed(stack).reshape(-1)[inner]
                b = tuple(s[a:z][rect] for s in box)
                hit &= (x >= b[0]) & (y >= b[1]) & (x < b[2]) & (y < b[3])
            fits &= hit
        out.reshape(-1)[place[fits]] = True


def _windows(c: dict[str, np.ndarray], pad: int, halo: int, width: int, height: int) -> tuple[Sides, Sides]:
    """Of areas (x1, y1, x2, y2, v being r, tx, ty), the box and its window in the image, both at places of their tile."""
    low, high = [], []
    for s, n in (("x", width), ("y", height)):
        corner = c[f"t{s}"] * tiles.SIDE - halo
        low.append(np.maximum(c[f"{s}1"] - pad * c["v"], -corner))
        high.append(np.minimum(c[f"{s}2"] + pad * c["v"], n - corner))
    first = [np.maximum(c[f"{s}1"], a) for s, a in zip("xy", low)]
    last = [np.maximum(np.minimum(c[f"{s}2"], z), a) for s, a, z in zip("xy", first, high)]
    return (*first, *last), (*low, *high)


def _stacks(batches: Iterator[pa.RecordBatch], kind: str, halo: int, width: int, height: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """(a row with page, tx, ty for each tile, its mask, its labels, what its areas cover), of gathered labels (k = 0, by v), pixels (1) and areas (2)."""
    held: tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray] | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        c = {x: t[x].to_numpy().astype(np.int64) for x in ("k", "tx", "ty", "x1", "y1", "x2", "y2", "v")}
        starts = tiles._starts(t, ["page"])
        tile = np.zeros(t.num_rows, np.int64)
        tile[starts[1:]] = 1
        tile = np.cumsum(tile)
        areas = np.flatnonzero(c["k"] == 2)
        box, window = _windows({k: a[areas] for k, a in c.items()}, PAD[kind], halo, width, height)
        for i, x in enumerate(("x1", "y1", "x2", "y2")):  # tiles hold windows
            c[x][areas] = window[i]
        tall, wide = (np.maximum.reduceat(c[f"{s}2"], starts) for s in "yx")
        i, n = 0, len(starts)
        while i < n:  # tiles i to j are one stack
            j, h, w = i, 0, 0
            while j < n and (j == i or (j + 1 - i) * max(h, tall[j]) * max(w, wide[j]) <= tiles.MOST // 4):
                h, w, j = max(h, int(tall[j])), max(w, int(wide[j])), j + 1
            first, last = int(starts[i]), int(starts[j]) if j < n else t.num_rows
            names = t.select(["page", "tx", "ty"]).take(pa.array(starts[i:j]))
            same = held is not None and held[0].equals(names.slice(0, 1))
            if held is not None and not same:
                yield held
            if held is not None and same:
                h, w = max(h, held[1].shape[1]), max(w, held[1].shape[2])
            mask, lab, out = (np.zeros((j - i, h, w), dtype) for dtype in (bool, np.int32, bool))
            if held is not None and same:
                for now, was in zip((mask, lab, out), held[1:]):
                    now[:1, : was.shape[1], : was.shape[2]] = was
            for k in (0, 1):
                some = first + np.flatnonzero(c["k"][first:last] == k)
                x1, y1, x2, y2 = (c[x][some] for x in ("x1", "y1", "x2", "y2"))
                for a, z in tiles._pieces((x2 - x1) * (y2 - y1)):
                    rect, place = tiles._cells_of(x1[a:z], y1[a:z], x2[a:z], y2[a:z], tile[some[a:z]] - i, h, w)
                    if k:
                        mask.reshape(-1)[place] = True
                    else:
                        lab.reshape(-1)[place] = c["v"][some[a:z]][rect]  # the last one counts, which is the largest
            a, z = np.searchsorted(areas, (first, last))
            if z > a:
                cover(kind, mask, lab, out, tile[areas[a:z]] - i, tuple(x[a:z] for x in box), tuple(x[a:z] for x in window), c["v"][areas[a:z]])
            if j - i > 1:
                yield names.slice(0, j - i - 1), mask[:-1], lab[:-1], out[:-1]
            held = names.slice(j - i - 1, 1), mask[-1:].copy(), lab[-1:].copy(), out[-1:].copy()
            i = j
    if held is not None:
        yield held


def _left_over(rest: np.ndarray, radius: tuple[float, int, int], width: int, height: int) -> tuple[np.ndarray, Sides, np.ndarray]:
    """(tiles, boxes, radii) of the connected areas of a stack of whole pages, their boxes grown by the radius."""
    (_, h, w), (ratio, least, most) = rest.shape, radius
    places, roots = tiles.component_roots(rest)
    order = np.argsort(roots, kind="stable")
    places, roots = places[order], roots[order]
    first = np.flatnonzero(np.append(True, roots[1:] != roots[:-1])[: len(roots)])
    x, y = places % w, places // w % h
    if not len(first):
        return first, (first, first, first, first), first
    x1, y1, x2, y2 = (f.reduceat(v, first) for f, v in ((np.minimum, x), (np.minimum, y), (np.maximum, x + 1), (np.maximum, y + 1)))
    side = np.minimum(x2 - x1, y2 - y1) * ratio
    r = np.maximum(least, np.minimum(most, (np.floor(side) + (side - np.floor(side) >= 0.5)).astype(np.int64)))
    return roots[first] // (h * w), (np.maximum(x1 - r, 0), np.maximum(y1 - r, 0), np.minimum(x2 + r, width), np.minimum(y2 + r, height)), r


def _asked(areas: DataFrame, page: Column, width: int, height: int, kind: str) -> DataFrame:
    """Areas in whole places with their window (wx1 to wy2) in the image; those without one, or with nulls, are left out."""
    a = areas.select(page, "area", *[F.ceil(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.col("r").cast("int").alias("r")).dropna(subset=["page", "x1", "y1", "x2", "y2", "r"])
    low = {f"w{c}1": F.greatest(F.col(f"{c}1") - PAD[kind] * F.col("r"), F.lit(0)) for c in "xy"}
    high = {f"w{c}2": F.least(F.col(f"{c}2") + PAD[kind] * F.col("r"), F.lit(n)) for c, n in (("x", width), ("y", height))}
    return a.withColumns(low | high).where("wx2 > wx1 and wy2 > wy1")


def _together(pixels: DataFrame, asked: DataFrame, rects: DataFrame, page: Column, halo: int) -> DataFrame:
    """What ``_stacks`` takes: rows (page, tx, ty, x1, y1, x2, y2, v, k), tile by tile."""
    own = asked.withColumns({"k": F.lit(2), "v": F.col("r")})
    for c in "xy":  # the middle of a window is in its tile
        own = own.withColumn(f"t{c}", F.floor((F.col(f"w{c}1") + F.col(f"w{c}2")) / (2 * tiles.SIDE)).cast("int") if halo else F.lit(0))
        own = own.withColumns({x: (F.col(x) - F.col(f"t{c}") * tiles.SIDE + halo).cast("int") for x in (f"{c}1", f"{c}2")})
    tile = lambda r, k: tiles.tiled(r.where("page is not null").withColumn("page", page), ["page"], halo).withColumn("k", F.lit(k))
    both = tile(rects, 0).unionByName(tile(tiles.points(pixels, ["page"], F.lit(1)), 1))
    return tiles.gathered(both.unionByName(own.select("page", "tx", "ty", "x1", "y1", "x2", "y2", "v", "k")), ["page"], "k", "v")


def _rows(names: pa.Table, found: np.ndarray, halo: int, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The places that are set in a stack, with the values of other stacks there."""
    tx, ty = (names[c].to_numpy().astype(np.int64) * tiles.SIDE - halo for c in ("tx", "ty"))
    for i in range(0, len(found), step := max(1, (1 << 20) // found[0].size)):
        at, y, x = np.nonzero(found[i : i + step])
        at += i
        yield from tiles.table(names.select(["page"]), at, x=(x + tx[at]).astype(np.int32), y=(y + ty[at]).astype(np.int32), **{k: g[at, y, x] for k, g in columns.items()})


def covered(pixels: DataFrame, areas: DataFrame, rects: DataFrame, width: int, height: int, kind: str, beyond: Callable[..., DataFrame]) -> DataFrame:
    """(page, x, y, base, covered): each place of the image that is a pixel (base) or that an area covers.

    pixels: (page, x, y) in the image; areas: (page, area, x1, y1, x2, y2, r; right and bottom exclusive); rects: labels to paint. Areas
    count if the box, or for ``whole`` the window, holds a pixel. ``grown`` covers the places of the window within r of its
    pixels, ``whole`` the window, ``closed`` those of the box that are within r of the window's pixels or in holes of that. Only places
    of the label that most pixels asked have are covered, or all if none has one. beyond(pixels, areas, labels by place,
    width, height) gives (page, x, y) of areas whose window is larger than a tile.
    """
    halo = tiles.SIDE // 2 if max(width, height) > tiles.SIDE else 0
    page = F.col("page").cast(dict(pixels.dtypes)["page"]).alias("page")
    asked, fits = _asked(areas, page, width, height, kind), f"wx2 - wx1 <= {tiles.SIDE} and wy2 - wy1 <= {tiles.SIDE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = slice(halo, halo + tiles.SIDE)
        for names, mask, _, out in _stacks(batches, kind, halo, width, height):
            found = out.copy()
            found[:, own, own] |= mask[:, own, own]
            yield from _rows(names, found, halo, base=mask, covered=out)

    found = _together(pixels, asked.where(fits), rects, page, halo).mapInArrow(run, tiles.schema_of(pixels, ["page"], "x int, y int, base boolean, covered boolean"))
    if not halo:
        return found
    large = asked.where(f"not ({fits})").select("page", "area", "x1", "y1", "x2", "y2", "r")
    if large.limit(1).count():
        # merged: Spark judges places by the rectangles, and pixels by what is on disk, far fewer bytes than they take in memory
        more = beyond(pixels.hint("merge"), large, tiles.places(rects, ["page"], "label").hint("merge"), width, height)
        found = found.unionByName(more.select("page", "x", "y", F.lit(False).alias("base"), F.lit(True).alias("covered")))
    return found.groupBy("page", "x", "y").agg(F.max("base").alias("base"), F.max("covered").alias("covered"))  # tiles and large areas overlap


def _in_one_tile(pixels: DataFrame, blocks: DataFrame, rects: DataFrame, width: int, height: int, radius: tuple[float, int, int], kinds: tuple[str, str]) -> DataFrame:
    """``grown_mask`` of pages that fit in a tile, with all their pixels: blocks, and then what they leave over, in one go."""
    page = F.col("page").cast(dict(pixels.dtypes)["page"]).alias("page")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, mask, lab, out in _stacks(batches, kinds[0], 0, width, height):
            at, box, r = _left_over(mask & ~out, radius, width, height)
            if len(at):
                pad = PAD[kinds[1]] * r
                window = (np.maximum(box[0] - pad, 0), np.maximum(box[1] - pad, 0), np.minimum(box[2] + pad, width), np.minimum(box[3] + pad, height))
                more = [max(0, int(window[k].max()) - n) for k, n in ((3, mask.shape[1]), (2, mask.shape[2]))]
                mask, lab, out = (np.pad(g, ((0, 0), (0, more[0]), (0, more[1]))) for g in (mask, lab, out))
                rest, added = mask & ~out, np.zeros_like(out)
                cover(kinds[1], rest, lab, added, at, box, window, r)
                out |= added
            yield from _rows(names, mask | out, 0)

    return _together(pixels, _asked(blocks, page, width, height, kinds[0]), rects, page, 0).mapInArrow(run, tiles.schema_of(pixels, ["page"], "x int, y int"))


def grown_mask(pixels: DataFrame, blocks: DataFrame, labels: DataFrame, width: int, height: int, radius: tuple[float, int, int], kinds: tuple[str, str], beyond: dict[str, Callable[..., DataFrame]]) -> DataFrame:
    """A mask (page, x, y) with what text blocks cover of it, then what each connected area does that no block has covered.

    radius: of an uncovered area, the share of its shorter side, the least and the most; its bounds are grown by it. kinds: how blocks
    and such areas are covered. labels: (page, x, y, label), or rectangles (page, x1, y1, x2, y2, v) to paint.
    """
    rects = labels if "v" in labels.columns else tiles.points(labels.where("label > 0"), ["page"], F.col("label"))
    image = f"coalesce(page is not null and x >= 0 and x < {width} and y >= 0 and y < {height}, false)"
    spread = lambda px, own, kind: covered(px.where(image), own, rects, width, height, kind, beyond[kind])
    base, kind = cut(pixels.select("page", "x", "y")), dict(pixels.dtypes)
    typed = lambda df: df.select("page", *[F.col(c).cast(kind[c]).alias(c) for c in "xy"])
    outside = base.where(f"not {image}")
    if max(width, height) <= tiles.SIDE and not outside.dropna().limit(1).count():
        return typed(_in_one_tile(base.where(image), blocks, rects, width, height, radius, kinds).unionAll(outside.distinct()))
    first = cut(spread(base, blocks, kinds[0]))
    rest = first.where("base and not covered").select("page", "x", "y").unionAll(outside)

    ratio, least, most = radius
    side = F.least(F.max("x") - F.min("x") + 1, F.max("y") - F.min("y") + 1)
    r = F.greatest(F.lit(least), F.least(F.lit(most), F.round(side * ratio).cast("int")))
    own = components(rest).groupBy("page", F.col("c").alias("area")).agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"), r.alias("r"))
    wide = {k: F.greatest(F.col(k) - F.col("r"), F.lit(0)) for k in ("x1", "y1")} | {k: F.least(F.col(k) + F.col("r"), F.lit(n)) for k, n in (("x2", width), ("y2", height))}
    second = spread(rest, own.withColumns(wide), kinds[1]).where("covered")
    return typed(first.select("page", "x", "y").unionAll(outside).unionAll(second.select("page", "x", "y")).distinct())

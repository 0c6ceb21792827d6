"""Distances, safe boxes, filled regions, holes and outlines on random and hard masks against plain Python."""

import math
from collections import defaultdict

import numpy as np
import pytest

from plumage.operators import raster, regions


def frame(spark, grids, name="label"):
    rows = [(p, x, y, int(g[y, x])) for p, g in enumerate(grids) for y, x in np.argwhere(g)]
    return spark.createDataFrame([(p, int(x), int(y), v) for p, x, y, v in rows], f"page int, x int, y int, {name} int").repartition(3)


def grids(seed=0):
    rng = np.random.default_rng(seed)
    out = [(rng.random((h, w)) < d).astype(int) for h, w, d in ((1, 1, 1.1), (1, 9, 0.7), (12, 1, 0.8), (9, 11, 0.5), (20, 23, 0.8), (30, 40, 0.97), (16, 16, 0.3))]
    for _ in range(4):  # several labels on a page
        g = np.zeros((26, 30), int)
        for k in range(1, 7):
            y, x = rng.integers(0, 20), rng.integers(0, 22)
            g[y : y + rng.integers(1, 16), x : x + rng.integers(1, 18)] = k
        out.append(g)
    ring = np.ones((15, 15), int)
    ring[3:12, 3:12] = 0
    ring[6:9, 6:9] = 1  # an area inside another's hole
    out += [ring, np.eye(7, dtype=int), np.pad(np.ones((60, 300), int), 1)]
    return out


def brute_distance(g):
    out = {}
    for k in set(g[g > 0].tolist()):
        pad = np.pad(g == k, 1)
        away = np.argwhere(~pad)
        for y, x in np.argwhere(pad):
            out[k, int(x) - 1, int(y) - 1] = min(255, math.ceil(math.sqrt(((away - (y, x)) ** 2).sum(1).min())))
    return out


def test_distance(spark):
    gs = grids()
    got = {(r.page, r.label, r.x, r.y): r.dist for r in regions.edge_distance(frame(spark, gs)).collect()}
    assert got == {(p, *k): d for p, g in enumerate(gs) for k, d in brute_distance(g).items()}


def test_distance_stops_at_255(spark):
    row = spark.createDataFrame([(0, x, y, 1) for x in range(600) for y in range(3)], "page int, x int, y int, label int").where("y = 1 or true")
    assert {r.dist for r in regions.edge_distance(row.where("y < 3")).collect()} == {1, 2}
    tall = spark.range(0, 520 * 520).selectExpr("0 as page", "cast(id % 520 as int) as x", "cast(floor(id / 520) as int) as y", "1 as label")
    assert regions.edge_distance(tall).agg({"dist": "max"}).first()[0] == 255


def brute_safe(dist, share):
    h, w = dist.shape
    asked = min(255, max(1, math.floor(min(w, h) * share / 100 + 0.5)))
    for t in (asked, min(255, asked * 3) // 4, asked // 2, asked // 4, 1, 0):
        t = max(t, 1)
        places = [(x, y) for y in range(h) for x in range(w) if dist[y, x] >= t]
        if places:
            break
    cx, cy = (min(n - 1, math.floor(sum(p[i] for p in places) / len(places) + 0.5)) for i, n in ((0, w), (1, h)))
    if dist[cy, cx] < 0.7 * dist.max() - 1e-9:
        cx, cy = next((x, y) for y in range(h) for x in range(w) if dist[y, x] == dist.max())
    if (cx, cy) not in set(places):
        cx, cy = min(places, key=lambda p: ((p[0] - cx) ** 2 + (p[1] - cy) ** 2, p[1], p[0]))
    best = None
    for y1 in range(h):
        for x1 in range(w):
            for y2 in range(y1 + 1, h + 1):
                for x2 in range(x1 + 1, w + 1):
                    if (dist[y1:y2, x1:x2] >= t).all():
                        key = (-(x2 - x1) * (y2 - y1), (x1 + x2 - 2 * cx - 1) ** 2 + (y1 + y2 - 2 * cy - 1) ** 2, y2, x2, y1 - y2)
                        best = min(best, (key, (x1, y1, x2 - x1, y2 - y1, t))) if best else (key, (x1, y1, x2 - x1, y2 - y1, t))
    return best[1]


def test_safe_boxes(spark):
    gs = [g for g in grids(3) if g.size < 600] + [np.ones((14, 18), int)]
    got = {(r.page, r.label, r["mode"]): (r.x, r.y, r.w, r.h, r.threshold) for r in regions.safe_boxes(frame(spark, gs)).collect()}
    want = {}
    for p, g in enumerate(gs):
        d = brute_distance(g)
        for k in {k for k, *_ in d}:
            x0, y0 = min(x for j, x, _ in d if j == k), min(y for j, _, y in d if j == k)
            grid = np.zeros_like(g)
            for (j, x, y), v in d.items():
                if j == k:
                    grid[y - y0, x - x0] = v
            ys, xs = np.nonzero(grid)
            grid = grid[: ys.max() + 1, : xs.max() + 1]
            for mode, share in regions.PADDING.items():
                x, y, w, h, t = brute_safe(grid, share)
                want[p, k, mode] = (x + x0, y + y0, w, h, t)
    assert got == want


def test_a_tail_is_left_out_and_columns_get_more_room(spark):
    g = np.zeros((140, 220), int)
    g[20:100, 20:120] = 1
    g[55:65, 120:190] = 1
    seeds = spark.createDataFrame([(0, 1, "horizontal", 60.0, 50.0, 80.0, 70.0), (0, 2, "vertical", 60.0, 50.0, 80.0, 70.0), (0, 3, "vertical", 0.0, 120.0, 9.0, 130.0)], "page int, seed int, mode string, x1 double, y1 double, x2 double, y2 double")
    got = {r.seed: r for r in regions.layout_boxes(frame(spark, [g]), seeds, 220, 140).collect()}
    assert set(got) == {1, 2}
    across, down = got[1], got[2]
    assert across.x >= 20 and across.y >= 20 and across.x + across.w <= 122 and across.y + across.h <= 100
    assert down.w < across.w and down.h < across.h and down.x > across.x and down.y > across.y


def test_holes_equal_those_of_whole_pages(spark):
    gs = grids(5) + [(np.random.default_rng(k).random((24, 24)) < 0.6).astype(int) for k in range(6)]
    spiral = np.zeros((21, 21), int)
    for k in range(0, 10, 2):
        spiral[k, k : 21 - k] = spiral[20 - k, k : 21 - k] = spiral[k : 21 - k, k] = spiral[k : 21 - k, 20 - k] = 1
        if k < 8:
            spiral[k + 1, k] = 0 if k % 4 else 1
    gs.append(spiral)
    windows = spark.createDataFrame([(p, 0, 0, g.shape[1], g.shape[0]) for p, g in enumerate(gs)], "page int, wx1 int, wy1 int, wx2 int, wy2 int")
    got = {(r.page, r.x, r.y) for r in regions.enclosed(frame(spark, gs), windows, ["page"]).collect()}
    want = {(p, int(x), int(y)) for p, g in enumerate(gs) for y, x in np.argwhere(raster.holes(g))}
    assert got == want and len(want) > 100


def brute_regions(mask, labels, blocks, ratio, least, most):
    """The rule area by area on whole grids."""
    h, w = mask.shape
    out, covered = mask.copy(), np.zeros_like(mask)

    def vote(pix, x1, y1, x2, y2):
        n = defaultdict(int)
        for y, x in np.argwhere(pix[y1:y2, x1:x2]):
            if labels[y + y1, x + x1]:
                n[labels[y + y1, x + x1]] += 1
        return max(n, key=lambda k: (n[k], k)) if n else 0

    clip = lambda x1, y1, x2, y2, r: (max(0, x1 - r), max(0, y1 - r), min(w, x2 + r), min(h, y2 + r))
    for *box, r in blocks:
        x1, y1, x2, y2 = clip(*box, r)
        if mask[y1:y2, x1:x2].any():
            k = vote(mask, x1, y1, x2, y2)
            spot = np.zeros_like(mask)
            spot[y1:y2, x1:x2] = 1
            spot &= (labels == k) if k else 1
            out |= spot
            covered |= spot
    rest, left = mask & ~covered & 1, None
    left = set(map(tuple, np.argwhere(rest).tolist()))
    while left:
        todo, area = [left.pop()], []
        while todo:
            y, x = todo.pop()
            area.append((y, x))
            near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        ys, xs = zip(*area)
        box = min(xs), min(ys), max(xs) + 1, max(ys) + 1
        r = max(least, min(most, math.floor(min(box[2] - box[0], box[3] - box[1]) * ratio + 0.5)))
        sx1, sy1, sx2, sy2 = clip(*box, r)
        wx1, wy1, wx2, wy2 = clip(sx1, sy1, sx2, sy2, r)
        local = rest[wy1:wy2, wx1:wx2]
        grown = np.zeros_like(local)
        for y, x in np.argwhere(local):
            grown[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = 1
        grown |= raster.holes(grown)
        k = vote(rest, sx1, sy1, sx2, sy2)
        whole = np.zeros_like(mask)
        whole[wy1:wy2, wx1:wx2] = grown
        spot = np.zeros_like(mask)
        spot[sy1:sy2, sx1:sx2] = whole[sy1:sy2, sx1:sx2]
        out |= spot & ((labels == k) if k else 1)
    return {(int(x), int(y)) for y, x in np.argwhere(out)}


def test_region_fill(spark):
    rng = np.random.default_rng(8)
    masks, labels, blocks, want = [], [], [], set()
    for p in range(6):
        m = (rng.random((40, 50)) < (0.02, 0.05, 0.1)[p % 3]).astype(int)
        m[20:34, 20:36] = 0
        m[20, 20:36] = m[33, 20:36] = m[20:34, 20] = m[20:34, 35] = 1  # a frame around a hole
        g = np.zeros((40, 50), int)
        g[2:30, 3:28] = 4
        g[10:38, 24:48] = 9
        own = [tuple(map(int, (x, y, x + rng.integers(1, 9), y + rng.integers(1, 9), rng.integers(0, 4)))) for x, y in rng.integers(0, 45, (5, 2)) % (45, 35)]
        masks.append(m)
        labels.append(g)
        blocks += [(p, p * 10 + k, *b) for k, b in enumerate(own)]
        want |= {(p, x, y) for x, y in brute_regions(m, g, own, 0.45, 1, 5)}
    b = spark.createDataFrame(blocks, "page int, area int, x1 int, y1 int, x2 int, y2 int, r int")
    got = [(r.page, r.x, r.y) for r in regions.filled_regions(frame(spark, masks, "v"), b, frame(spark, labels), 50, 40, 0.45, 1, 5).collect()]
    assert set(got) == want and len(got) == len(want)


def trace(area):
    """Border following from the first pixel by row, its left neighbour being outside: always the next pixel anticlockwise."""
    turn = [(-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1)]  # clockwise from the left, y downwards
    start = min(area, key=lambda p: (p[1], p[0]))
    first = next(((start[0] + a, start[1] + b) for a, b in turn if (start[0] + a, start[1] + b) in area), None)
    if first is None:
        return [start]
    out, prior, now = [], first, start
    while True:
        out.append(now)
        k = turn.index((prior[0] - now[0], prior[1] - now[1]))
        step = next((now[0] + a, now[1] + b) for a, b in (turn[(k - j) % 8] for j in range(1, 9)) if (now[0] + a, now[1] + b) in area)
        if step == start and now == first:
            return out
        prior, now = now, step


def areas_of(places):
    left, found = set(places), []
    while left:
        todo, area = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            area.add((x, y))
            near = {(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        found.append(area)
    return found


def twice_area(points):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])))


def test_outlines(spark):
    gs = grids(7)
    rings, best = defaultdict(list), defaultdict(list)
    for r in regions.outlines(frame(spark, gs)).orderBy("i").collect():
        rings[r.page, r.label, r.ring].append((r.x, r.y))
    for r in regions.largest_outlines(frame(spark, gs)).orderBy("i").collect():
        best[r.page, r.label].append((r.x, r.y))
    want, top = defaultdict(list), {}
    for p, g in enumerate(gs):
        for k in set(g[g > 0].tolist()):
            traced = sorted((trace(a) for a in areas_of({(int(x), int(y)) for y, x in np.argwhere(g == k)})), key=lambda t: (t[0][1], t[0][0]))
            for t in traced:
                if len(t) > 1:
                    want[p, k, (t[0][1] << 22) + t[0][0] * 4] = t
            t = max(traced, key=twice_area)
            if len(t) >= 4 and twice_area(t):
                top[p, k] = t
    assert rings == want and best == top and len(want) > 40


@pytest.mark.parametrize("scale", [0.25, 0.5])
def test_box_masks(spark, scale):
    rng = np.random.default_rng(4)
    m = (rng.random((20, 24)) < 0.5).astype(int)
    sides = [(float(a), float(b), float(a + c), float(b + d)) for a, b, c, d in rng.random((12, 4)) * (60, 50, 40, 30)] + [(90.0, 70.0, 99.0, 79.0), (5.0, 5.0, 5.1, 5.1)]
    want = set()
    for k, (x1, y1, x2, y2) in enumerate(sides):
        half = lambda v: math.floor(v + 0.5)
        a, c = (min(24, max(0, half(v * scale))) for v in (x1, x2))
        b, d = (min(20, max(0, half(v * scale))) for v in (y1, y2))
        if c > a and d > b:
            w, h = max(1, half(x2) - half(x1)), max(1, half(y2) - half(y1))
            want |= {(k, x, y) for x in range(w) for y in range(h) if m[b + math.floor((y + 0.5) * (d - b) / h), a + math.floor((x + 0.5) * (c - a) / w)]}
    boxes = spark.createDataFrame([(0, k, *b) for k, b in enumerate(sides)], "page int, label int, x1 double, y1 double, x2 double, y2 double")
    got = {(r.label, r.x, r.y) for r in regions.box_masks(frame(spark, [m], "v"), boxes, 24, 20, scale).collect()}
    assert got == want


def test_outlines_over_tiles(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g = np.zeros((600, 540), int)
    g[20:580, 30:520] = 1
    g[200:300, 200:300] = 0  # a hole over the corner of four tiles
    g[240:262, 240:262] = 2
    for k in range(60, 500, 40):  # a comb, whose border leaves and enters tiles many times
        g[40:560, k : k + 9] = 0
    g[255:258, 100:480] = 3
    g[580:600, 0:540] = np.where(rng.random((20, 540)) < 0.6, 4, 0)
    g[:, 256] = np.where(g[:, 256] == 0, 5, g[:, 256])  # one column of a tile
    held, cut = [], regions.cut
    monkeypatch.setattr(regions, "cut", lambda df: (held.append(cut(df)), held[-1])[1])
    rings, best = defaultdict(list), defaultdict(list)
    for r in regions.outlines(frame(spark, [g])).orderBy("i").collect():
        rings[r.label, r.ring].append((r.i, r.x, r.y, r.area2))
    assert max(df.count() for df in held) < sum(map(len, rings.values())) / 5  # rows are lines, not pixels
    for r in regions.largest_outlines(frame(spark, [g])).orderBy("i").collect():
        best[r.label].append((r.x, r.y))
    want, top = {}, {}
    for k in range(1, 6):
        traced = sorted((trace(a) for a in areas_of({(int(x), int(y)) for y, x in np.argwhere(g == k)})), key=lambda t: (t[0][1], t[0][0]))
        want |= {(k, (t[0][1] << 22) + t[0][0] * 4): [(i, *p, twice_area(t)) for i, p in enumerate(t)] for t in traced if len(t) > 1}
        t = max(traced, key=twice_area)
        if len(t) >= 4 and twice_area(t):
            top[k] = t
    assert rings == want and best == top and len(top) == 4
    rects = [(0, int(x), int(y), int(x) + 1, int(y) + 1, int(g[y, x])) for y, x in np.argwhere(g[:250, :250])]
    table = spark.createDataFrame(rects, "page int, x1 int, y1 int, x2 int, y2 int, v int")
    one, more = (sorted(map(tuple, regions.painted_largest_outlines(table, n, n).collect())) for n in (250, 257))
    assert one == more and len(one) > 100


def test_box_outlines(spark):
    rng = np.random.default_rng(6)
    masks = [(rng.random((30, 40)) < d).astype(int) for d in (0.15, 0.6, 0.0, 0.9)]
    sides = [(p, k, float(a), float(b), float(a + c), float(b + d)) for p in range(5) for k, (a, b, c, d) in enumerate(rng.random((40, 4)) * (110, 80, 60, 50))]
    sides += [(1, 3, 0.0, 0.0, 60.0, 30.0), (1, 3, 5.2, 9.7, 90.0, 80.0), (0, 99, 5.0, 5.0, 5.1, 5.1)]  # one label of several boxes
    pixels = frame(spark, masks, "v")
    for more in ([(3, 77, 1.0, 2.0, 1.0 + 290, 70.0)], []):  # one that is larger than a tile, or none
        boxes = spark.createDataFrame(sides + more, "page int, label bigint, x1 double, y1 double, x2 double, y2 double")
        want = regions.largest_outlines(regions.box_masks(pixels, boxes, 40, 30, 1 / 3)).collect()
        got = regions.box_outlines(pixels, boxes, 40, 30, 1 / 3)
        assert got.columns == ["page", "label", "i", "x", "y"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")

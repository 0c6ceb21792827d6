"""Rasters in tiles: what lies over their edges against brute force, and how many rows are shuffled."""

import re

import numpy as np
import pytest

from plumage.operators import nodes, raster, regions, tiles
from plumage.plans.catalog import QUERIES

DIR = "/root/testdata/sf0.001"
H, W = 530, 520


def some_rects(seed=1):
    rng = np.random.default_rng(seed)
    out = []
    for v in range(1, 30):
        x, y = int(rng.integers(0, W - 20)), int(rng.integers(0, H - 20))
        out.append((x, y, min(W, x + int(rng.integers(1, 120))), min(H, y + int(rng.integers(1, 90))), v))
    return out + [(255, 0, 257, H, 40), (0, 254, 300, 258, 41), (510, 510, 514, 514, 42)]


def painted(rects):
    g = np.zeros((H, W), np.int32)
    for x1, y1, x2, y2, v in sorted(rects, key=lambda r: r[-1]):
        g[y1:y2, x1:x2] = v
    return g


def as_rows(spark, rects):
    return spark.createDataFrame([(0, *r) for r in rects], "page int, x1 int, y1 int, x2 int, y2 int, v int").repartition(3)


def shuffled(spark, df):
    """Rows shuffled by a run of df."""
    sc, group = spark.sparkContext, f"rows-{id(df)}"
    sc.setJobGroup(group, group)
    df.write.format("noop").mode("overwrite").save()
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {k for j in sc.statusTracker().getJobIdsForGroup(group) for k in sc.statusTracker().getJobInfo(j).stageIds}
    total = 0
    for k in stages:
        try:
            total += sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords()
        except Exception:  # a stage that was skipped
            continue
    return total


def test_places_and_distances_over_the_edges_of_tiles(spark):
    rects = some_rects()
    g = painted(rects)
    got = np.zeros_like(g)
    for r in tiles.places(as_rows(spark, rects), ["page"], "label").collect():
        assert not got[r.y, r.x]
        got[r.y, r.x] = r.label
    assert (got == g).all()
    dist = np.zeros_like(g)
    for r in regions.distances(as_rows(spark, rects), ["page"]).collect():
        assert r.label == g[r.y, r.x]
        dist[r.y, r.x] = r.dist
    assert (dist == tiles.edge_distances(g[None])[0]).all()  # which tests/test_regions.py holds against brute force


def test_seeds_over_the_edges_of_tiles(spark):
    rects, rng = some_rects(), np.random.default_rng(3)
    g = painted(rects)
    seeds = [(0, k, "vertical", int(x), int(y), int(x) + int(rng.integers(1, 50)), int(y) + int(rng.integers(1, 50))) for k, (x, y) in enumerate(rng.integers(0, 500, (80, 2)))]
    want = {}
    for _, k, _, x1, y1, x2, y2 in seeds:
        v, n = np.unique(g[y1:y2, x1:x2][g[y1:y2, x1:x2] > 0], return_counts=True)
        if len(v):
            want[k] = max(zip(n.tolist(), v.tolist()))[1]
    s = spark.createDataFrame(seeds, "page int, seed int, mode string, x1 int, y1 int, x2 int, y2 int")
    assert {r.seed: r.label for r in regions.painted_seed_labels(as_rows(spark, rects), s, W, H).collect()} == want


def test_safe_boxes_together_are_those_one_by_one():
    rng = np.random.default_rng(5)
    own = [rng.random((h, w)) < d for h, w, d in rng.random((300, 3)) * (20, 20, 1) + (1, 1, 0.3) for h, w in [(int(h), int(w))]]
    own = [g for g in own if g.any()]
    dist = [tiles.edge_distances(g.astype(np.int32)[None])[0] for g in own]
    sizes = np.array([g.shape for g in own])
    stack = np.zeros((len(own), *sizes.max(0)), np.int64)
    for k, d in enumerate(dist):
        stack[k, : d.shape[0], : d.shape[1]] = d
    for share in (12, 20, 60):
        assert [tuple(r) for r in regions.safe_boxes_of(stack, sizes[:, 0], sizes[:, 1], share).tolist()] == [tuple(map(int, regions.safe_box(d, share))) for d in dist]


#: Rows shuffled for each box at most; with a row for each place it was ten and more.
MOST = {"raster_dilate": 2, "raster_close": 5, "raster_enclosed": 5, "raster_component_boxes": 2, "detector_bubble_mask": 4, "raster_paint_labels": 4, "raster_edge_distance": 4, "raster_safe_boxes": 6, "raster_layout_boxes": 8}


@pytest.mark.parametrize("name", MOST)
def test_no_row_for_each_place_is_shuffled(spark, name):
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        assert shuffled(spark, QUERIES[name](spark, DIR)) <= MOST[name] * n
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["raster_dilate", "raster_close", "raster_holes", "raster_combine_area"])
def test_neighbourhoods_are_not_aggregated_place_by_place(spark, name):
    pixels = spark.createDataFrame([(0, 1, 1, 5), (0, 3, 3, 0)], "page int, x int, y int, v int")
    made = {"raster_dilate": lambda: raster.dilated(pixels, 1, 32, 32), "raster_close": lambda: raster.closed(pixels, 1, 32, 32), "raster_holes": lambda: raster.dilated(pixels, 1, 32, 32, diamond=True), "raster_combine_area": lambda: raster.combined(pixels, 3)}[name]()
    assert not re.search(r"Aggregate\(keys=\[page#\d+L?, x#", made._jdf.queryExecution().executedPlan().toString())


def test_components_and_neighbourhoods_over_the_edges_of_tiles(spark):
    rng = np.random.default_rng(9)
    g = np.zeros((300, 300), np.int32)
    g[250:262] = rng.random((12, 300)) < 0.5
    g[:, 252:260] = rng.random((300, 8)) < 0.4
    px = spark.createDataFrame([(0, int(x), int(y), 1) for y, x in np.argwhere(g)], "page int, x int, y int, v int")
    places, roots = tiles.component_roots(g[None] > 0)
    want = {(int(p % 300), int(p // 300)): (int(r // 300) << 20) + int(r % 300) for p, r in zip(places, roots)}
    assert {(r.x, r.y): r.c for r in nodes.components(px).collect()} == want
    pad = np.pad(g, 2)
    big = np.max([pad[1 + dy : 303 + dy, 1 + dx : 303 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)[1:-1, 1:-1]
    rim = np.pad(big, 1, constant_values=1)
    closed = np.min([rim[1 + dy : 301 + dy, 1 + dx : 301 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
    assert {(r.x, r.y) for r in raster.closed(px, 1, 300, 300).collect()} == {(int(x), int(y)) for y, x in np.argwhere(closed)}

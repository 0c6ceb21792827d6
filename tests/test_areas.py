"""Areas grown and filled in tiles: pages and windows larger than a tile against brute force, and what the queries shuffle and broadcast."""

import math

import numpy as np
import pytest

from plumage.operators import masks, regions
from plumage.plans.catalog import QUERIES
from tests.test_regions import brute_regions, frame
from tests.test_whole_rasters import components

DIR = "/root/testdata/sf0.001"
H, W = 290, 300


def vote(pixels, labels, x1, y1, x2, y2):
    own = labels[y1:y2, x1:x2][pixels[y1:y2, x1:x2] > 0]
    v, n = np.unique(own[own > 0], return_counts=True)
    return max(zip(n.tolist(), v.tolist()))[1] if len(v) else 0


def clip(x1, y1, x2, y2, r):
    return max(0, x1 - r), max(0, y1 - r), min(W, x2 + r), min(H, y2 + r)


def brute_grown(pixels, labels, areas):
    out = np.zeros_like(pixels)
    for *box, r in areas:
        x1, y1, x2, y2 = clip(*box, 0)
        if not pixels[y1:y2, x1:x2].any():
            continue
        k = vote(pixels, labels, x1, y1, x2, y2)
        wx1, wy1, wx2, wy2 = clip(*box, 2 * r)
        spot = np.zeros_like(pixels[wy1:wy2, wx1:wx2])
        for y, x in np.argwhere(pixels[wy1:wy2, wx1:wx2]):
            spot[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1] = 1
        out[wy1:wy2, wx1:wx2] |= spot & ((labels[wy1:wy2, wx1:wx2] == k) if k else 1)
    return out


def left_over(rest, ratio, least, most):
    """Connected areas, their bounds grown by their radius."""
    out = []
    for _, x1, y1, x2, y2, _ in components({(0, int(x), int(y)) for y, x in np.argwhere(rest)}):
        r = max(least, min(most, math.floor(min(x2 - x1, y2 - y1) * ratio + 0.5)))
        out.append((*clip(x1, y1, x2, y2, r), r))
    return out


def brute_expanded(mask, labels, blocks, ratio, least, most):
    covered = brute_grown(mask, labels, blocks)
    rest = mask & ~covered & 1
    return mask | covered | brute_grown(rest, labels, left_over(rest, ratio, least, most))


def large_pages(seed):
    """Masks, labels and blocks of two pages larger than a tile; blocks over its edges, one larger than it, some without pixels or outside."""
    rng = np.random.default_rng(seed)
    grids, labels, blocks = [], [], []
    for p in range(2):
        m = (rng.random((H, W)) < 0.003).astype(int)
        m[120:140, 100:130] = 0
        m[120, 100:130] = m[139, 100:130] = m[120:140, 100] = m[120:140, 129] = 1  # a frame over the edge of half a tile
        m[250:261, 240:268] = rng.random((11, 28)) < 0.6  # an area over the edges of tiles
        if not p:  # an area longer than a tile, with a hole
            m[286, 12:279] = m[266, 100:140] = 1
            m[266:287, 100] = m[266:287, 139] = 1
            m[267:286, 101:139] = 0
        g = np.zeros((H, W), int)
        g[10:200, 5:150], g[100:280, 120:290], g[240:270, 230:262] = 4, 9, 2
        own = [(int(x), int(y), int(x + rng.integers(2, 60)), int(y + rng.integers(2, 40)), int(rng.integers(0, 5))) for x, y in zip(rng.integers(0, 200, 12), rng.integers(0, 90, 12))]
        own += [(118, 60, 140, 90, 3), (250, 30, 259, 100, 2), (-9, -9, -2, -2, 3), (2, 262, 8, 289, 1), (285, 200, 330, 340, 4)] + [(4, 30, 280, 60, 2)] * (p == 1)
        grids.append(m)
        labels.append(g)
        blocks += [(p, p * 100 + k, *b) for k, b in enumerate(own)]
    return grids, labels, blocks


def as_blocks(spark, blocks):
    return spark.createDataFrame(blocks, "page int, area int, x1 int, y1 int, x2 int, y2 int, r int")


def places(rows):
    found = [tuple(r) for r in rows.select("page", "x", "y").collect()]
    assert len(set(found)) == len(found)
    return set(found)


def test_masks_grown_over_the_edges_of_tiles(spark):
    grids, labels, blocks = large_pages(1)
    want = {(p, int(x), int(y)) for p, (m, g) in enumerate(zip(grids, labels)) for y, x in np.argwhere(brute_expanded(m, g, [b[2:] for b in blocks if b[0] == p], 0.4, 1, 5))}
    assert places(masks.expanded(frame(spark, grids, "v"), as_blocks(spark, blocks), frame(spark, labels), W, H, 0.4, 1, 5)) == want


def test_regions_filled_over_the_edges_of_tiles(spark):
    grids, labels, blocks = large_pages(2)
    want = {(p, x, y) for p, (m, g) in enumerate(zip(grids, labels)) for x, y in brute_regions(m, g, [b[2:] for b in blocks if b[0] == p], 0.45, 1, 5)}
    assert {(0, 120, 276)} <= want  # in the hole
    assert places(regions.filled_regions(frame(spark, grids, "v"), as_blocks(spark, blocks), frame(spark, labels), W, H, 0.45, 1, 5)) == want


def test_a_tile_in_several_batches(spark):
    rng = np.random.default_rng(4)
    grids, labels = [(rng.random((40, 50)) < 0.05).astype(int) for _ in range(3)], [np.pad(np.full((20, 20), k + 1), ((5, 15), (8, 22))) for k in range(3)]
    blocks = [(p, k, int(x), int(y), int(x) + 5, int(y) + 4, 1 + k % 3) for p in range(3) for k, (x, y) in enumerate(rng.integers(0, 40, (60, 2)))]
    far = spark.createDataFrame([(7, 70, 5)], "page int, x int, y int")  # outside, so that pages aren't done in one go
    run = lambda more=far.limit(0): [places(f(frame(spark, grids, "v").select("page", "x", "y").unionAll(more), as_blocks(spark, blocks), frame(spark, labels), 50, 40, 0.4, 1, 3)) for f in (masks.expanded, regions.filled_regions)]
    want = run()
    assert run(far) == [w | {(7, 70, 5)} for w in want]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        assert run() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_pixels_and_blocks(spark):
    pixels = spark.createDataFrame([(0, 3, 3), (0, 3, 3), (None, 4, 4), (0, None, 2), (0, 60, 5)], "page int, x int, y int")
    blocks = spark.createDataFrame([(0, 1, 2, 2, 5, 5, 1), (None, 2, 2, 2, 8, 8, 1), (0, 3, None, 0, 40, 40, 3), (0, 4, 0, 0, 40, 40, None)], "page int, area int, x1 int, y1 int, x2 int, y2 int, r int")
    none = spark.createDataFrame([], "page int, x int, y int, label int")
    want = {(0, x, y) for x in (2, 3, 4) for y in (2, 3, 4)} | {(None, 4, 4), (0, None, 2), (0, 60, 5)}
    assert places(masks.expanded(pixels, blocks, none, 40, 40, 0.4, 1, 3)) == want


def ran(spark, name):
    """(rows shuffled, plans) of all that a query runs, what it writes on the way included."""
    sc, group = spark.sparkContext, f"all-{name}"
    plans = lambda: {e.executionId(): e.physicalPlanDescription() for e in map(store.apply, range(store.size()))}
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    before = set(plans())
    sc.setJobGroup(group, group)
    QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save()
    sc.setLocalProperty("spark.jobGroup.id", None)
    store = spark._jsparkSession.sharedState().statusStore().executionsList()
    total = 0
    for k in {k for j in sc.statusTracker().getJobIdsForGroup(group) for k in sc.statusTracker().getJobInfo(j).stageIds}:
        try:
            total += sc._jsc.sc().statusStore().lastStageAttempt(k).shuffleWriteRecords()
        except Exception:  # a stage that was skipped
            continue
    return total, [p for k, p in plans().items() if k not in before]


#: Rows shuffled for each box at most.
MOST = {"raster_expand_mask": 2, "raster_region_fill": 1}


@pytest.mark.parametrize("name", MOST)
def test_masks_are_not_broadcast_or_shuffled_place_by_place(spark, name):
    n = spark.read.parquet(f"{DIR}/lineitem.parquet").count()
    rows, plans = ran(spark, name)
    assert len(plans) > 1 and not [p for p in plans if "Broadcast" in p]
    assert rows <= MOST[name] * n, rows / n

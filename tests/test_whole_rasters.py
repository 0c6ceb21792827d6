"""Raster queries on all boxes and pages against brute force."""

from collections import defaultdict

import pytest

from plumage.operators.nodes import component_boxes
from plumage.plans.catalog import QUERIES
from plumage.sources.fixtures import boxes

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def all_boxes(spark):
    return boxes(spark, DIR).collect()


def components(places):
    left, found = set(places), []
    while left:
        todo, area = [left.pop()], []
        while todo:
            page, x, y = todo.pop()
            area.append((x, y))
            near = {(page, x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
            left -= near
            todo += near
        xs, ys = zip(*area)
        found.append((page, min(xs), min(ys), max(xs) + 1, max(ys) + 1, len(area)))
    return sorted(found)


def test_components_of_all_pixels(spark, all_boxes):
    want = components({(b.page_id, b.x1 % 40, b.y1 % 40) for b in all_boxes})
    got = sorted((r.page, r.x1, r.y1, r.x2, r.y2, r.n) for r in QUERIES["raster_component_boxes"](spark, DIR).collect())
    assert got == want and len({r[0] for r in got}) == len({b.page_id for b in all_boxes})


def test_components_of_dense_pages(spark):
    places = {(p, x * x % 23, (x * 7 + p) % 19) for p in range(3) for x in range(200)}
    got = component_boxes(spark.createDataFrame(sorted(places), "page int, x int, y int")).collect()
    assert sorted((r.page, r.x1, r.y1, r.x2, r.y2, r.n) for r in got) == components(places)


def test_refined_mask_in_all_boxes(spark, all_boxes):
    tiles, values = defaultdict(set), defaultdict(int)
    for b in all_boxes:
        tiles[b.page_id // 64] |= {(x, y) for x in range(b.x1 % 20, b.x1 % 20 + 6) for y in range(b.y1 % 20, b.y1 % 20 + 4)}
        place = (b.page_id // 64, b.x1 % 32, b.y1 % 32)
        values[place] = max(values[place], b.score % 256)
    steps = [(a, b) for a in range(-2, 3) for b in range(-2, 3) if abs(a) + abs(b) <= 2]
    seeds = [(p, x, y) for (p, x, y), v in values.items() if v > 60 and (x, y) in tiles[p]]
    want = {(p, x + a, y + b) for p, x, y in seeds for a, b in steps if 0 <= x + a < 32 and 0 <= y + b < 32 and (x + a, y + b) in tiles[p]}
    got = [(r.page, r.x, r.y) for r in QUERIES["raster_refine_mask"](spark, DIR).collect()]
    assert sorted(got) == sorted(want) and {p for p, _, _ in got} == {b.page_id // 64 for b in all_boxes}

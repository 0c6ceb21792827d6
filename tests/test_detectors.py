"""Detectors as plans against the same chains in plain Python, and golden cases of the filters and of blending."""

import math
import random
from collections import defaultdict

from plumage.operators import aggregate, layout, raster
from plumage.plans import detectors
from plumage.plans.catalog import QUERIES
from plumage.plans.detector_queries import _nodes
from plumage.sources.fixtures import boxes

DIR = "/root/testdata/sf0.001"


def cut(b, width, height):
    x1, y1, x2, y2 = b
    b = min(max(x1, 0), width), min(max(y1, 0), height), min(max(x2, 0), width), min(max(y2, 0), height)
    return b if b[2] - b[0] > 5 and b[3] - b[1] > 5 else None


def test_text_and_bubbles(spark):
    pages, stay = defaultdict(list), defaultdict(int)
    for r in boxes(spark, DIR).collect():
        pages[r.page_id].append(r)
        stay[r.page_id] += r.x1 % 3 != 0
    want = set()
    for page, own in pages.items():
        found = []
        for k, up in ((0, 0), (1, 12)):
            scored = []
            for b in own:
                y1, y2 = (max(b.y1 - up, 0), max(b.y2 - up, 0)) if k else (b.y1, b.y2)
                scored += [(-s, b.box_id, n, (b.x1, y1, b.x2, y2)) for n, s in (("bubble", b.score), ("text_bubble", (b.x1 * 7 + b.score) % 1000), ("text_free", (b.y1 * 3 + b.score) % 1000))]
            scored.sort()
            found += [(n, -s, (x1, y1 + up, x2, y2 + up)) for s, _, n, (x1, y1, x2, y2) in scored[: len(own)] if -s >= 300]
        found = [(n, s, c) for n, s, b in found if (c := cut(b, 900, 1300))]
        text = [(s, b) for n, s, b in layout.merged_slices(found, 1300) if n != "bubble"]
        text = [(s, c) for s, b in layout.merged_regions(text) if (c := cut(b, 900, 1300))]
        order = layout.reading_order([b for _, b in text], True)
        want |= {(page, stay[page] + k, *map(int, (text[i][0], *text[i][1]))) for k, i in enumerate(order)}
    got = [tuple(r) for r in QUERIES["detector_text_and_bubbles"](spark, DIR).select("page_id", "at", "score", "x1", "y1", "x2", "y2").collect()]
    assert set(got) == want and len(got) == len(want) > 1000


def test_layout_blocks_follow_what_stays(spark):
    rows = [(1, 1, "Text", 900, 0, 0, 100, 20), (1, 2, "plain_text", 800, 2, 1, 98, 19), (1, 3, "Figure", 900, 0, 0, 50, 50), (1, 4, "TITLE", 249, 0, 50, 30, 90), (1, 5, "content", 250, 40, 90, 30, 50), (2, 1, "text", 999, 0, 0, 5, 60)]
    regions = spark.createDataFrame(rows, "page_id int, box_id int, label string, score int, x1 int, y1 int, x2 int, y2 int")
    nodes = spark.createDataFrame([(1, "text"), (1, "image"), (1, "mask")], "page_id int, kind string")
    got = {(r.box_id, r["at"], r.x1, r.y1, r.x2, r.y2, r.direction) for r in detectors.layout_blocks(regions, nodes).collect()}
    assert got == {(1, 2, 0, 0, 100, 20, "horizontal"), (5, 3, 30, 50, 40, 90, "vertical")}


def test_bubbles_are_painted_by_their_masks(spark):
    px = [(0, 1, 2, 1), (0, 1, 1, 2), (0, 1, 2, 2)] + [(0, 2, x, y) for x in range(3) for y in range(3)] + [(0, 3, 9, 9)]
    regions = spark.createDataFrame([(0, 1, 3), (0, 2, 9), (0, 3, 1), (0, 4, 50)], "page_id int, box_id int, area int")
    got = {(r.x, r.y): r.label for r in detectors.bubble_mask(regions, spark.createDataFrame(px, "page_id int, box_id int, x int, y int"), 6, 6).collect()}
    assert got == {(x, y): 2 for x in range(3) for y in range(3)} | {(2, 1): 3, (1, 2): 3, (2, 2): 3}


def test_logit_filters(spark):
    rng = random.Random(2)
    groups = {k: [round(rng.uniform(-4, 4), 2) for _ in range(rng.randrange(1, 30))] for k in range(25)} | {90: [0.0] * 4, 91: [5.0, -1000.0]}
    df = spark.createDataFrame([(k, i, v) for k, vs in groups.items() for i, v in enumerate(vs)], "k int, token int, logit double")
    got, deep = defaultdict(set), defaultdict(set)
    for r in aggregate.typical_filter(df, ["k"], "token", "logit", 0.5, 2).collect():
        got[r.k].add(r.token)
    for r in aggregate.sigma_filter(df, ["k"], "logit", 1.0).collect():
        deep[r.k].add(r.token)
    for k, vs in groups.items():
        e = [math.exp(v - max(vs)) for v in vs]
        p = [x / sum(e) for x in e]
        s = [-math.log(x) if x > 0 else 0.0 for x in p]
        h = sum(a * b for a, b in zip(p, s))
        order, kept, total = sorted(range(len(vs)), key=lambda i: (round(abs(s[i] - h), 9), i)), set(), 0.0
        for n, i in enumerate(order):
            kept.add(i)
            total += p[i]
            if total > 0.5 and n >= 1:
                break
        mean = sum(vs) / len(vs)
        floor = max(vs) - math.sqrt(sum((v - mean) ** 2 for v in vs) / len(vs))
        assert got[k] == kept and deep[k] == {i for i, v in enumerate(vs) if v >= floor}


def test_penalties(spark):
    logits = spark.createDataFrame([("a", t, v) for t, v in enumerate([2.0, -2.0, 1.0, 0.0])] + [("b", 0, 1.0)], "k string, token int, logit double")
    history = spark.createDataFrame([("a", i, t) for i, t in enumerate([2, 0, 0, 1, 9])], "k string, place int, token int")
    ask = lambda last: {(r.k, r.token): r.logit for r in aggregate.penalised(logits, history, ["k"], "token", "logit", "place", last, 2.0, 0.5, 0.25).collect()}
    none = {("a", 0): 2.0, ("a", 1): -2.0, ("a", 2): 1.0, ("a", 3): 0.0, ("b", 0): 1.0}
    assert ask(0) == none
    assert ask(4) == none | {("a", 0): 1.0 - 1.0 - 0.25, ("a", 1): -4.0 - 0.5 - 0.25}
    assert ask(-1) == none | {("a", 0): 1.0 - 1.0 - 0.25, ("a", 1): -4.0 - 0.5 - 0.25, ("a", 2): 0.5 - 0.5 - 0.25}


def test_blending(spark):
    layers = [(0, 0, 0, 2, 255, 0, 0, 128), (0, 0, 0, 1, 0, 0, 255, 255), (0, 1, 0, 1, 9, 8, 7, 0), (0, 2, 0, 5, 1, 2, 3, 255), (0, 2, 0, 4, 9, 9, 9, 9), (0, 3, 0, 1, 200, 100, 0, 100)]
    df = spark.createDataFrame(layers, "page int, x int, y int, z int, r int, g int, b int, a int")
    got = {r.x: (r.r, r.g, r.b, r.a) for r in raster.blended(df).collect()}
    assert got == {0: (128, 0, 127, 255), 1: (0, 0, 0, 0), 2: (1, 2, 3, 255), 3: (200, 100, 0, 100)}


def test_nodes_of_a_page_are_counted_once(spark):
    assert _nodes(spark, DIR).count() == boxes(spark, DIR).count()

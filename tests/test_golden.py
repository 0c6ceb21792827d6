"""Operators that SQL can't express, on small cases worked out by hand, and invariants."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumage.functions import text as t
from plumage.operators import changelog, detect, layout, raster
from plumage.plans import registry
from plumage.sources import store


def boxes(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows, 1)], "page_id int, box_id int, x1 int, y1 int, x2 int, y2 int, score int, label string")


def test_nms_keeps_best_and_only_kept_boxes_suppress(spark):
    df = boxes(spark, [(0, 0, 10, 10, 50, "a"), (1, 0, 11, 10, 90, "a"), (2, 0, 12, 10, 40, "a"), (0, 0, 10, 10, 30, "b"), (7, 0, 17, 10, 35, "a")])
    got = {r.box_id for r in detect.nms(df, 35).collect()}
    assert got == {2, 4, 5}


def test_keep_first_is_not_an_anti_join(spark):
    # 2 lies in 1 and goes; 3 lies in 2 only, so it stays.
    df = boxes(spark, [(0, 0, 10, 10, 1, "a"), (1, 0, 11, 10, 1, "a"), (2, 0, 12, 10, 1, "a")])
    assert [r.box_id for r in detect.keep_first(df).collect()] == [1, 3]


def test_reading_order():
    side_by_side = [(0, 0, 40, 100), (60, 0, 100, 100)]
    assert layout.reading_order(side_by_side, True) == [1, 0]
    assert layout.reading_order(side_by_side, False) == [0, 1]
    rows = [(0, 0, 40, 40), (60, 0, 100, 40), (0, 80, 40, 120), (60, 80, 100, 120)]
    assert layout.reading_order(rows, True) == [1, 0, 3, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 300), st.integers(0, 300), st.integers(1, 90), st.integers(1, 90)), max_size=14), st.booleans())
def test_reading_order_is_a_permutation(items, rtl):
    b = [(x, y, x + w, y + h) for x, y, w, h in items]
    assert sorted(layout.reading_order(b, rtl)) == list(range(len(b)))
    united = layout.united_windows(b)
    assert all(not (p[0] <= q[2] and q[0] <= p[2] and p[1] <= q[3] and q[1] <= p[3]) for i, p in enumerate(united) for q in united[:i])


def test_union_grows_into_new_touches():
    assert layout.united_windows([(0, 0, 10, 10), (20, 0, 30, 10), (9, 5, 21, 30), (12, 20, 40, 40)]) == [(0, 0, 40, 40)]


def test_merging_regions_and_slices():
    got = layout.merged_regions([(5, (0, 0, 10, 10)), (9, (100, 100, 120, 120)), (7, (2, 0, 12, 10))])
    assert sorted(got) == [(7, (0, 0, 12, 10)), (9, (100, 100, 120, 120))]
    rows = [("t", 5, (10, 10, 110, 210)), ("t", 8, (12, 12, 108, 205)), ("b", 9, (10, 10, 110, 210)), ("t", 6, (10, 212, 112, 400))]
    got = layout.merged_slices(rows, 1000)
    assert len(got) == 2 and ("t", 8, (10, 10, 112, 400)) in got and ("b", 9, (10, 10, 110, 210)) in got


@pytest.mark.parametrize(
    "text,n,want",
    [
        ("[1]a\n[2]b", 2, ["a", "b"]), (" \t[2] x\n y\n[1]z", 3, ["z", "x\n y", ""]), ("no tags", 2, None), ("[1][2]b", 2, ["", "b"]),
        ("[1]a\n[1]b", 1, ["b"]), ("[9]a\n[1]b", 1, ["b"]), ("a [1] b", 1, None), ("[0]x\n[1]y", 1, ["y"]), (None, 1, None), ("", 2, None),
    ],
)
def test_tags(text, n, want):
    assert t.parse_tags(text, n) == want


def test_repetition():
    assert t.repeated_suffix_start("abc" + "x" * 12) == 3
    assert t.repeated_suffix_start("ok " + "ab " * 6) == 3
    assert t.repeated_suffix_start("é" + "la" * 6) == 2
    assert t.repeated_suffix_start("xxxx") is None and t.repeated_suffix_start("x" * 11) is None and t.repeated_suffix_start(None) is None


@pytest.mark.parametrize("text,want", [("!!", "‼"), ("!?", "⁉"), ("?!", "⁈"), ("!!!", "‼!"), ("!??", "!⁇"), ("a!", "a!"), ("！？b", "⁉b"), ("?!?", "⁈?"), ("!?!!", "⁉‼")])
def test_emphasis(text, want):
    assert t.pair_emphasis(text) == want


def test_line_breaks():
    assert t.line_breaks([3, 3, 3, 3], 6) == [2, 4]
    assert t.line_breaks([10, 2], 5) == [1, 2]
    assert t.line_breaks([], 5) == [] and t.line_breaks([1, 2], 0) == [2]
    assert t.line_breaks([4, 4], 9, [1, 1]) == [2]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 14), max_size=40), max_size=9), st.integers(1, 30), st.sampled_from([1, 3, 64]))
def test_line_breaks_of_many_texts(texts, width, group):
    assert t.line_breaks_many(texts, float(width), group=group) == [t.line_breaks(list(map(float, w)), float(width)) for w in texts]


def test_visual_order_and_chunks():
    assert t.visual_order([0, 1, 1, 0]) == [0, 2, 1, 3]
    assert t.visual_order([0, 0]) == [0, 1] and t.visual_order([]) == []
    assert t.visual_order([1, 2, 2, 1]) == [3, 1, 2, 0]
    assert t.utf16_chunks("ab😀c", 3) == ["ab", "😀c"] and t.utf16_chunks("", 3) == [] and t.utf16_chunks("😀😀", 1) == ["😀", "😀"]


@given(st.binary(max_size=600))
@settings(deadline=None)
def test_packbits_round_trip(data):
    assert raster.unpackbits(raster.packbits(data)) == data


def test_packed_and_ordered_columns(spark):
    df = spark.createDataFrame([(bytearray(b"aaab"), [0, 1, 1, 0]), (None, None), (bytearray(), [])], "row binary, levels array<int>")
    got = df.select(raster.packed_rows("row"), raster.unpacked_rows(raster.packed_rows("row")), t.visual_orders("levels")).collect()
    assert [tuple(r) for r in got] == [(raster.packbits(b"aaab"), b"aaab", [0, 2, 1, 3]), (None, None, None), (b"", b"", [])]


def test_packbits_form():
    assert raster.packbits(b"aaab") == bytes([254, 97, 0, 98])
    assert raster.packbits(b"aab") == bytes([2]) + b"aab"
    assert raster.packbits(b"z" * 130) == bytes([129, 122, 1]) + b"zz"


def test_holes_and_rectangle():
    g = np.zeros((5, 5), int)
    g[1:4, 1:4] = 1
    g[2, 2] = 0
    assert np.argwhere(raster.holes(g)).tolist() == [[2, 2]]
    g[1, 1] = 0  # now open at a corner
    assert not raster.holes(g).any()
    assert raster.largest_rectangle(np.array([[1, 1, 0], [1, 1, 1]], bool), (0, 0)) == (0, 0, 2, 2)
    assert raster.largest_rectangle(np.zeros((2, 2), bool), (0, 0)) is None


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.integers(0, 2**31))
def test_holes_and_rectangles_by_brute_force(h, w, seed):
    g = (np.random.default_rng(seed).random((h, w)) < 0.55).astype(int)
    todo = {(y, x) for y in range(h) for x in range(w) if not g[y, x] and (y in (0, h - 1) or x in (0, w - 1))}
    free = set(todo)
    while todo:
        y, x = todo.pop()
        more = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if 0 <= y + a < h and 0 <= x + b < w and not g[y + a, x + b]} - free
        free |= more
        todo |= more
    assert {tuple(p) for p in np.argwhere(raster.holes(g)).tolist()} == {(y, x) for y in range(h) for x in range(w) if not g[y, x]} - free
    anchor, best = (w / 2, h / 2), None
    for y1 in range(h):
        for x1 in range(w):
            for y2 in range(y1 + 1, h + 1):
                for x2 in range(x1 + 1, w + 1):
                    if g[y1:y2, x1:x2].all():
                        key = (-(x2 - x1) * (y2 - y1), ((x1 + x2) / 2 - anchor[0]) ** 2 + ((y1 + y2) / 2 - anchor[1]) ** 2)
                        best = min(best, key) if best else key
    r = raster.largest_rectangle(g > 0, anchor)
    assert (r is None) == (best is None)
    if r:
        x1, y1, x2, y2 = r
        assert g[y1:y2, x1:x2].all() and (-(x2 - x1) * (y2 - y1), ((x1 + x2) / 2 - anchor[0]) ** 2 + ((y1 + y2) / 2 - anchor[1]) ** 2) == best


def test_depths(spark):
    schema = "place int, id string, needs array<string>, produces array<string>"
    steps = [(0, "b", ["x"], ["y"]), (1, "a", [], ["x"]), (2, "a2", ["z"], ["x"]), (3, "c", ["y", "none"], []), (4, "z", [], ["z"])]
    assert {r.id: r.depth for r in registry.depths(spark.createDataFrame(steps, schema)).collect()} == {"a": 0, "z": 0, "a2": 1, "b": 2, "c": 3}
    for bad in ([(0, "a", ["y"], ["x"]), (1, "b", ["x"], ["y"])], [(0, "a", [], []), (1, "a", [], [])]):
        with pytest.raises(ValueError):
            registry.depths(spark.createDataFrame(bad, schema))


def test_history(spark):
    rows = [(1, i, c, i) for i, c in enumerate(["apply", "apply", "undo", "redo", "undo", "apply", "redo", "undo", "undo", "undo"])]
    df = spark.createDataFrame(rows, "entity int, epoch long, command string, v int")
    assert changelog.history(df).count() == 0
    assert [r.v for r in changelog.history(df.where("epoch < 7")).orderBy("position").collect()] == [0, 5]
    capped = changelog.history(spark.createDataFrame([(1, i, "apply" if i < 5 else "undo", i) for i in range(9)], df.schema), 2)
    assert [r.v for r in capped.orderBy("position").collect()] == [0, 1, 2]


def test_inverse_undoes(spark):
    log = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "a", None), (3, 1, "b", 7), (4, 1, "a", 9)], "epoch long, entity int, field string, v int")
    back = changelog.inverse(log).where("seq <= 2")
    after = changelog.state_at(log.select("epoch", "entity", "field", "v").unionAll(back.selectExpr("seq + 100 as epoch", "entity", "field", "v").where("field = 'a'")))
    assert {(r.field, r.v) for r in after.collect()} == {("a", None), ("b", 7)}
    assert {(r.field, r.unset) for r in back.collect()} == {("a", False), ("b", True)}


def test_snapshot_and_log(spark, tmp_path):
    root, schema = str(tmp_path), "epoch long, entity int, field string, v int"
    assert store.read_snapshot(spark, root, "entity int, field string, v int")[1] == -1
    log = spark.createDataFrame([(e, e % 2, "ab"[e % 3 % 2], e * 10) for e in range(1, 9)], schema)
    store.append_log(log, root)
    for epoch in (2, 5):
        store.write_snapshot(changelog.state_at(log, epoch).withColumnRenamed("epoch", "at"), root, epoch)
    snap, epoch = store.read_snapshot(spark, root, "entity int, field string, at long, v int")
    assert epoch == 5 and {tuple(r) for r in snap.collect()} == {(r.entity, r.field, r.epoch, r.v) for r in changelog.state_at(log, 5).collect()}
    rest = store.truncated_log(spark, root, schema)
    assert sorted(r.epoch for r in rest.collect()) == [6, 7, 8]
    again = changelog.replay(snap.selectExpr("at as epoch", "entity", "field", "v"), rest, epoch)
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in changelog.state_at(log).collect()}


def test_op_errors(spark):
    pages = spark.createDataFrame([(1,), (2,)], "page long")
    nodes = spark.createDataFrame([(1, 10, "text"), (1, 11, "image")], "page long, node long, kind string")
    rows = [
        ("add_page", 3, None, None, 2, None, None), ("add_page", 3, None, None, 3, None, "index out of range"), ("add_page", 1, None, None, 0, None, "page exists"),
        ("remove_page", 9, None, None, None, None, "page not found"), ("update_page", 2, None, None, None, None, None), ("update_project", None, None, None, None, None, None),
        ("reorder_pages", None, None, None, None, [2, 1], None), ("reorder_pages", None, None, None, None, [2, 2], "other pages"), ("reorder_pages", None, None, None, None, [2], "other pages"),
        ("add_node", 1, 12, None, 2, None, None), ("add_node", 1, 10, None, 0, None, "node exists"), ("add_node", 2, 10, None, 1, None, "index out of range"), ("add_node", 7, 10, None, 0, None, "page not found"),
        ("remove_node", 2, 10, None, None, None, "node not found"), ("update_node", 1, 10, "text", None, None, None), ("update_node", 1, 10, "image", None, None, "node of another kind"), ("update_node", 1, 11, None, None, None, None),
        ("reorder_nodes", 1, None, None, None, [11, 10], None), ("reorder_nodes", 1, None, None, None, [11, 10, 11], "other nodes"), ("reorder_nodes", 1, None, None, None, [11, 12], "other nodes"), ("reorder_nodes", 2, None, None, None, [], None),
    ]
    ops = spark.createDataFrame([(k, 0, *r[:6]) for k, r in enumerate(rows)] + [(0, 1, "remove_page", 9, None, None, None, None)], "batch long, place int, op string, page long, node long, kind string, at long, ids array<long>")
    errors = changelog.op_errors(ops, pages, nodes)
    assert {(r.batch, r.place): r.error for r in errors.collect()} == {(k, 0): r[6] for k, r in enumerate(rows) if r[6]} | {(0, 1): "page not found"}
    assert sorted(r.batch for r in changelog.accepted(ops, errors).collect()) == [k for k, r in enumerate(rows) if not r[6] and k]


def test_log_and_store(spark, tmp_path):
    root = str(tmp_path)
    log = spark.createDataFrame([(1, "a"), (2, "b"), (4, "d")], "epoch long, name string")
    store.append_log(log.coalesce(1), root)
    assert sorted(r.epoch for r in store.read_log(spark, root, 1, "epoch long, name string").collect()) == [2, 4]
    (tmp_path / "log" / "part-bad.json").write_text('{"epoch":3,"name":\n')
    assert sorted(r.epoch for r in store.read_log(spark, root, 0, "epoch long, name string").collect()) == [1, 2]
    (tmp_path / "in").mkdir()
    for name, data in (("page-10.bin", b"x"), ("page-2.bin", b"y"), ("page-3.bin", b"x")):
        (tmp_path / "in" / name).write_bytes(data)
    files = store.import_files(spark, f"{root}/in")
    assert [r.name for r in files.orderBy("key").collect()] == ["page-2.bin", "page-3.bin", "page-10.bin"]
    blobs = store.put(None, files)
    assert blobs.count() == 2 and store.put(blobs, files).count() == 0
    w, h = store.raw_header(files["content"])
    raw = spark.createDataFrame([(bytearray(b"RGBA" + (300).to_bytes(4, "little") + (2).to_bytes(4, "little")),)], "content binary")
    w, h = store.raw_header(raw["content"])
    assert tuple(raw.select(w, h).first()) == (300, 2)


def test_entry_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['plumage.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'box_nms' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, timeout=100)


def test_reading_positions_of_all_pages_at_once():
    rng = np.random.default_rng(5)
    for step, most in ((1, 300), (10, 60), (0.5, 200)):
        sizes = rng.integers(1, 14, 200)
        page = np.repeat(np.arange(200), sizes)
        x1, y1 = (rng.integers(0, most, len(page)) * step for _ in "xy")
        x2, y2 = (c + rng.integers(-1, 40, len(page)) * step for c in (x1, y1))
        for rtl in (True, False):
            got = layout.reading_positions(page, *[c.astype(float) for c in (x1, y1, x2, y2)], rtl)
            for p in range(200):
                own = [tuple(float(c[i]) for c in (x1, y1, x2, y2)) for i in np.flatnonzero(page == p)]
                assert np.argsort(got[page == p]).tolist() == layout.reading_order(own, rtl)
    assert layout.reading_positions(np.zeros(0, int), *[np.zeros(0)] * 4, True).tolist() == []

"""Typed operations on random logs against plain copies of the scene, and back again; undo stacks and checks at scale."""

import copy
import random

import pytest
from pyspark.sql import functions as F

from plumage.operators import changelog, scene

KINDS = ["text", "image", "mask"]


def op(seq, batch, name, page=None, node=None, place=None, kind=None, fields=None, items=None, ids=None, project=1):
    return (project, seq, batch, name, page, node, place, kind, fields, items, ids)


def random_log(rng, n, project):
    out, batch = [], 0
    for seq in range(n):
        batch += rng.random() < 0.6
        page, node, place, kind = rng.choice("ABCD"), rng.choice("stuvw"), rng.randrange(4), rng.choice(KINDS)
        fields = {k: rng.choice([None, "1", "2", "ü\n"]) for k in rng.sample(["name", "x", "text"], rng.randrange(3))}
        name = rng.choice(scene_ops)
        items = [(x, rng.choice(KINDS), {"text": "t", "x": None}) for x in rng.sample("stuvw", rng.randrange(3))] if name == "add_page" else None
        if name == "add_node" and rng.random() < 0.5:
            fields["role"] = rng.choice(["source", "segment", "custom"])
        ids = [rng.choice("ABCDstuvw") for _ in range(rng.randrange(4))] if rng.random() < 0.3 else rng.sample("ABCD" if name == "reorder_pages" else "stuvw", rng.randrange(1, 4))
        out.append(op(seq, batch, name, page, node, place, rng.choice([None, kind]) if name == "update_node" else kind, fields, items, ids, project))
    return out


scene_ops = ["update_project", "add_page", "add_page", "remove_page", "update_page", "reorder_pages", "add_node", "add_node", "add_node", "remove_node", "update_node", "update_node", "reorder_nodes", "rename"]
set_ = lambda old, new: {k: v for k, v in {**old, **(new or {})}.items() if v is not None}


def naive(state, o):
    """The scene after one operation as a new copy, or None; state: (fields, [(page, fields, [(node, kind, fields)])])."""
    _, _, _, name, page, node, place, kind, fields, items, ids = o
    top, pages = copy.deepcopy(state)
    names = [p[0] for p in pages]
    at = names.index(page) if page in names else None

    def ordered(rows):
        known = [r[0] for r in rows]
        if len(ids) != len(known) or set(ids) - set(known):
            return None
        for k, i in enumerate(ids):
            j = [r[0] for r in rows].index(i)
            rows.insert(k, rows.pop(j))
        return rows

    if name == "update_project":
        return set_(top, fields), pages
    if name == "add_page":
        if at is not None or place > len(pages):
            return None
        pages.insert(place, (page, set_({}, fields), [(n, k, set_({}, f)) for n, k, f in items or []]))
        return top, pages
    if name == "reorder_pages":
        return (top, pages) if ordered(pages) else (None if ids or pages else (top, pages))
    if at is None or name == "rename":
        return None
    own = pages[at][2]
    spot = next((i for i, n in enumerate(own) if n[0] == node), None)
    if name == "remove_page":
        pages.pop(at)
    elif name == "update_page":
        pages[at] = (page, set_(pages[at][1], fields), own)
    elif name == "add_node":
        role = (kind, (fields or {}).get("role"))
        if spot is not None or place > len(own) or role in scene.SINGLE and any((k, f.get("role")) == role for _, k, f in own):
            return None
        own.insert(place, (node, kind, set_({}, fields)))
    elif name == "reorder_nodes":
        if ordered(own) is None:
            return None
    elif spot is None:
        return None
    elif name == "remove_node":
        own.pop(spot)
    else:
        if kind is not None and kind != own[spot][1]:
            return None
        own[spot] = (node, own[spot][1], set_(own[spot][2], fields))
    return top, pages


def rows_of(project, state):
    top, pages = state
    out = {(project, None, None, None, None, tuple(sorted(top.items())))}
    for k, (page, fields, nodes) in enumerate(pages):
        out.add((project, page, None, k, None, tuple(sorted(fields.items()))))
        out |= {(project, page, n, i, kind, tuple(sorted(f.items()))) for i, (n, kind, f) in enumerate(nodes)}
    return out


def collected(items):
    return {(r.project, r.page, r.node, r.place, r.kind, tuple(sorted((r.fields or {}).items()))) for r in items.collect()}


def test_random_logs_and_back(spark):
    rng, logs, want, failed, start = random.Random(5), [], set(), {}, set()
    for project in range(12):
        log = random_log(rng, 60, project)
        state = ({"name": "p"}, [("A", {"name": "a"}, [("s", "text", {"text": "x"}), ("t", "image", {"role": "source"})]), ("B", {}, [])]) if project % 2 else ({}, [])
        start |= rows_of(project, state)
        logs += log
        for b in sorted({o[2] for o in log}):
            now = state
            for o in (x for x in log if x[2] == b):
                now = naive(now, o)
                if now is None:
                    failed[project, b] = o[1]
                    break
            state = now or state
        want |= rows_of(project, state)
    assert 40 < len(failed) and len(want) > 60
    log = spark.createDataFrame(logs, scene.LOG).repartition(5)
    first = spark.createDataFrame([(p, pg, n, pl, k, dict(f)) for p, pg, n, pl, k, f in start], scene.SCENE).repartition(3)
    ops, after = scene.applied(first, log)
    assert collected(after) == want
    rows = ops.collect()
    assert len(rows) == len(logs) and {(r.project, r.batch) for r in rows if r.error} == set(failed)
    assert {(r.project, r.batch): r.seq for r in rows if r.error and r.error != "batch failed"} == failed
    ops2, back = scene.applied(after, scene.inverted(ops))
    assert collected(back) == start and not ops2.where("error is not null").count()
    again, forth = scene.applied(back, scene.inverted(ops2).withColumn("seq", F.col("seq")))
    assert collected(forth) == want


def test_rules(spark):
    node = lambda seq, batch, n, **k: op(seq, batch, "add_node", "A", n, 0, **k)
    log = [
        op(0, 0, "add_page", "A", place=0, fields={"name": "a"}), op(1, 1, "add_page", "B", place=2), op(2, 2, "add_page", "B", place=1),
        node(3, 3, "s", kind="image", fields={"role": "source", "x": "0"}), node(4, 4, "s2", kind="image", fields={"role": "source"}),
        op(5, 5, "update_node", "A", "s", kind="mask", fields={"x": "50"}), op(6, 6, "update_node", "A", "s", kind="image", fields={"x": "50"}),
        node(7, 7, "t", kind="text"), op(8, 7, "remove_node", "A", "none"), op(9, 7, "update_page", "A", fields={"name": "b"}),
        op(10, 8, "reorder_pages", ids=["A", "A"]), op(11, 9, "reorder_pages", ids=["A"]),
    ]
    ops, after = scene.applied(spark.createDataFrame([], scene.SCENE), spark.createDataFrame(log, scene.LOG))
    errors = {r.seq: r.error for r in ops.collect()}
    assert errors == {0: None, 1: "index out of range", 2: None, 3: None, 4: "more than one source image", 5: "node of another kind", 6: None, 7: "batch failed", 8: "node not found", 9: "batch failed", 10: None, 11: "other pages"}
    got = {(r.page, r.node): (r.place, dict(r.fields or {})) for r in after.collect()}
    assert got == {(None, None): (None, {}), ("B", None): (0, {}), ("A", None): (1, {"name": "a"}), ("A", "s"): (0, {"role": "source", "x": "50"})}
    prior = {r.seq: r.prior for r in ops.collect()}
    assert prior[6].fields == {"x": "0"} and prior[10].ids == ["A", "B"]


def test_empty(spark):
    ops, after = scene.applied(spark.createDataFrame([], scene.SCENE), spark.createDataFrame([], scene.LOG))
    assert ops.count() == after.count() == 0


@pytest.mark.parametrize("cap", [1, 3, 500])
def test_undo_stacks(spark, cap):
    rng = random.Random(cap)
    rows = [(e, k, rng.choice(["apply", "apply", "undo", "redo"]), k) for e in ["a", "b", None] for k in range(400)]
    want = set()
    for e in ["a", "b", None]:
        done, undone, fixed = [], [], []
        for _, k, command, v in (r for r in rows if r[0] == e):
            if command == "undo" and done:
                undone.append(done.pop())
            elif command == "redo" and undone:
                done.append(undone.pop())
            elif command == "apply":
                done, undone = [*done, v], []
                if len(done) > cap:
                    fixed.append(done.pop(0))
        want |= {(e, i, v, v) for i, v in enumerate(fixed + done)}
    got = changelog.history(spark.createDataFrame(rows, "entity string, epoch long, command string, v int"), cap)
    assert {(r.entity, r.position, r.epoch, r.v) for r in got.collect()} == want and got.limit(0).count() == 0


def test_orders_of_many_pages(spark):
    """Node numbers that repeat on every page meet those of their own page only."""
    nodes = spark.range(0, 60_000).selectExpr("id div 6 as page", "id % 6 as node", "'text' as kind")
    ops = spark.range(0, 10_000).selectExpr("id as batch", "0 as place", "'reorder_nodes' as op", "id as page", "cast(null as bigint) as node", "cast(null as string) as kind", "0L as at", "case when id % 5 = 0 then array(0L, 1L, 2L, 3L, 4L, 4L) else array(5L, 4L, 3L, 2L, 1L, 0L) end as ids")
    errors = changelog.op_errors(ops, nodes.select("page").distinct(), nodes)
    assert errors.count() == 2_000 and errors.where("error <> 'other nodes' or batch % 5 <> 0").count() == 0

"""Typed operations on trees of projects, pages and nodes, applied in order and inverted.

A scene has a row for each item: (project, page, node, place, kind, fields). A project's own row has neither page nor node, a
page's row no node; ``place`` counts from 0 among a project's pages or a page's nodes, and ``fields`` is a map.

A log has a row for each operation: (project, seq, batch, op, page, node, place, kind, fields, items, ids). What an operation needs
depends on all before it, so a project's log is one ordered fold; projects are independent, and a task reads its projects'
scenes and then their logs as a sorted stream, holding one scene and one batch at a time, however long the log is. The fold
leaves what each operation replaced beside it, so an inverse is an expression on the log alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumage.operators.lineage import cut

FIELDS = "map<string,string>"
ITEMS = f"array<struct<node:string,kind:string,fields:{FIELDS}>>"
SCENE = f"project bigint, page string, node string, place int, kind string, fields {FIELDS}"
LOG = f"project bigint, seq bigint, batch bigint, op string, page string, node string, place int, kind string, fields {FIELDS}, items {ITEMS}, ids array<string>"
_PRIOR = f"prior struct<place:int,kind:string,fields:{FIELDS},items:{ITEMS},ids:array<string>>"
_OUT = f"row string, {LOG}, error string, {_PRIOR}"

# Kinds and roles of which a page holds one node at most.
SINGLE = {("image", "source"), ("image", "inpainted"), ("image", "rendered"), ("mask", "segment"), ("mask", "brushInpaint"), ("mask", "bubble")}


class Wrong(Exception):
    """What an operation asks can't be done on the scene as it stands."""


def _moved(items: dict, order: list[str]) -> dict:
    """``items`` in the order given, each id in turn being moved to its place."""
    now = list(items)
    for k, i in enumerate(order):
        now.insert(k, now.pop(now.index(i)))
    return {i: items[i] for i in now}


def _inserted(items: dict, key: str, value: object, place: int) -> dict:
    pairs = list(items.items())
    pairs.insert(place, (key, value))
    return dict(pairs)


def _patched(fields: dict, patch: dict) -> tuple[dict, dict]:
    """The fields after the patch, and what it replaced; null clears a field."""
    return {k: v for k, v in (fields | patch).items() if v is not None}, {k: fields.get(k) for k in patch}


class Scene:
    """A project's fields and its pages, in order: page -> [fields, node -> (kind, fields)]."""

    def __init__(self) -> None:
        self.fields: dict = {}
        self.pages: dict[str, list] = {}

    def apply(self, o: dict) -> dict:
        """Applies the operation and gives what it replaced; where it can't be done the scene stays as it was."""
        op, patch, place = o["op"], dict(o["fields"] or ()), o["place"]
        if op == "update_project":
            self.fields, before = _patched(self.fields, patch)
            return {"fields": before}
        if op == "add_page":
            if o["page"] in self.pages:
                raise Wrong("page exists")
            if place > len(self.pages):
                raise Wrong("index out of range")
            nodes = {x["node"]: (x["kind"], {k: v for k, v in x["fields"] or () if v is not None}) for x in o["items"] or ()}
            self.pages = _inserted(self.pages, o["page"], [_patched({}, patch)[0], nodes], place)
            return {}
        if op == "reorder_pages":
            return self._reorder(o["ids"] or [])
        page = self.pages.get(o["page"])
        if page is None:
            raise Wrong("page not found")
        if op == "remove_page":
            place = list(self.pages).index(o["page"])
            del self.pages[o["page"]]
            return {"place": place, "fields": page[0], "items": [{"node": n, "kind": k, "fields": f} for n, (k, f) in page[1].items()]}
        if op == "update_page":
            page[0], before = _patched(page[0], patch)
            return {"fields": before}
        nodes, node = page[1], o["node"]
        if op == "add_node":
            if node in nodes:
                raise Wrong("node exists")
            if place > len(nodes):
                raise Wrong("index out of range")
            fields = _patched({}, patch)[0]
            role = (o["kind"], fields.get("role"))
            if role in SINGLE and role in {(k, f.get("role")) for k, f in nodes.values()}:
                raise Wrong(f"more than one {role[1]} {role[0]}")
            page[1] = _inserted(nodes, node, (o["kind"], fields), place)
            return {}
        if op == "reorder_nodes":
            ids = o["ids"] or []
            if len(ids) != len(nodes) or not all(i in nodes for i in ids):
                raise Wrong("other nodes")
            page[1] = _moved(nodes, ids)
            return {"ids": list(nodes)}
        if op not in ("remove_node", "update_node"):
            raise Wrong("unknown operation")
        if node not in nodes:
            raise Wrong("node not found")
        kind, fields = nodes[node]
        if op == "remove_node":
            place = list(nodes).index(node)
            del nodes[node]
            return {"place": place, "kind": kind, "fields": fields}
        if o["kind"] is not None and o["kind"] != kind:
            raise Wrong("node of another kind")
        after, before = _patched(fields, patch)
        nodes[node] = (kind, after)
        return {"kind": o["kind"], "fields": before}

    def _reorder(self, ids: list[str]) -> dict:
        if len(ids) != len(self.pages) or not all(i in self.pages for i in ids):
            raise Wrong("other pages")
        before, self.pages = list(self.pages), _moved(self.pages, ids)
        return {"ids": before}

    def undo(self, o: dict, prior: dict) -> None:
        """Takes an operation back that was the last to be applied."""
        self.apply(inverse_of(o, prior))

    def items(self) -> Iterator[dict]:
        yield {"fields": self.fields}
        for k, (page, (fields, nodes)) in enumerate(self.pages.items()):
            yield {"page": page, "place": k, "fields": fields}
            for i, (node, (kind, own)) in enumerate(nodes.items()):
                yield {"page": page, "node": node, "place": i, "kind": kind, "fields": own}


# The operation that takes one back. Others are taken back by themselves, with the values that were there.
INVERSE = {"add_page": "remove_page", "remove_page": "add_page", "add_node": "remove_node", "remove_node": "add_node"}


def inverse_of(o: dict, prior: dict) -> dict:
    op, at = o["op"], lambda k: prior.get(k)
    if op in ("add_page", "add_node"):
        return o | {"op": INVERSE[op]}
    asks = {"fields": list((at("fields") or {}).items()), "items": [x | {"fields": list(x["fields"].items())} for x in at("items") or ()], "ids": at("ids")}
    return o | asks | {"op": INVERSE.get(op, op), "place": at("place"), "kind": at("kind")}


def _fold(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(part, SCENE and LOG columns), sorted by project, scene before log, to rows of operations with what they replaced, and of items."""
    project, scene, group, done, out = None, None, None, [], []
    empty = dict.fromkeys(schema.names)

    def close_batch(error: str | None = None) -> None:
        for o, prior in done:
            out.append(empty | o | {"row": "op", "error": error, "prior": None if error else prior})
        done.clear()

    def close_project() -> None:
        close_batch()
        if scene is not None:
            out.extend(empty | {"row": "item", "project": project} | x for x in scene.items())

    def flush() -> pa.RecordBatch:
        columns = [pa.array([_pairs(r[f.name]) if f.name == "fields" else r[f.name] for r in out], f.type) for f in schema]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    failed = False
    for b in batches:
        for r in b.to_pylist():
            part = r.pop("part")
            if scene is None or r["project"] != project:
                close_project()
                project, scene, group, failed = r["project"], Scene(), None, False
            if part == 0:
                fields = {k: v for k, v in r["fields"] or () if v is not None}
                if r["page"] is None:
                    scene.fields = fields
                elif r["node"] is None:
                    scene.pages[r["page"]] = [fields, {}]
                elif r["page"] in scene.pages:
                    scene.pages[r["page"]][1][r["node"]] = (r["kind"], fields)
                continue
            if group is None or r["batch"] != group:
                close_batch()
                group, failed = r["batch"], False
            if failed:
                out.append(empty | r | {"row": "op", "error": "batch failed"})
                continue
            try:
                done.append((r, scene.apply(r)))
            except Wrong as wrong:
                for o, prior in reversed(done):
                    scene.undo(o, prior)
                failed = True
                close_batch("batch failed")
                out.append(empty | r | {"row": "op", "error": str(wrong)})
            if len(out) > 4096:
                yield flush()
    close_project()
    if out:
        yield flush()


def _pairs(fields: object) -> list | None:
    return list(fields.items()) if isinstance(fields, dict) else fields


def applied(scene: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with ``error`` and ``prior`` (place, kind, fields, items, ids: what the operation replaced), and the scene after it.

    scene: SCENE columns; log: LOG columns, applied by ``seq``. Operations next to each other with one ``batch`` stand or fall
    together: where one can't be done, those before it are taken back, it carries the error, and the others "batch failed". An
    update's ``fields`` are those it sets, null clearing one; a cleared field and a missing one are the same. Adding takes
    ``place``, at most the number there are, and a page its ``items``; an order has as many ids as there are, all known.
    Pages without a project's row, and projects without a scene, count as empty ones. Null ids are ids as others.
    """
    blank = {n: F.lit(None).cast(t) for n, t in (c.split(" ", 1) for c in LOG.split(", "))}
    columns = list(blank)
    items = scene.select(*[(F.col(c) if c in scene.columns else blank[c]).alias(c) for c in columns]).withColumn("part", F.lit(0))
    both = items.unionByName(log.select(*columns).withColumn("part", F.lit(1)))
    pages_first = [F.col("page").isNotNull(), F.col("node").isNotNull(), F.col("place")]
    both = both.repartition("project").sortWithinPartitions("project", "part", F.asc_nulls_first("seq"), *[F.when(F.col("part") == 0, c.cast("int")) for c in pages_first])
    schema = to_arrow_schema(StructType.fromDDL(_OUT))
    out = cut(both.select("part", *columns).mapInArrow(lambda batches: _fold(batches, schema), _OUT))
    ops = out.where("row = 'op'").select(*columns, "error", "prior")
    return ops, out.where("row = 'item'").select("project", "page", "node", "place", "kind", "fields")


def inverted(ops: DataFrame) -> DataFrame:
    """The log that takes the operations of ``applied`` back, last one first; those that weren't done aren't in it."""
    done, op = ops.where("error is null"), F.col("op")
    adds = op.isin("add_page", "add_node")
    to = op
    for a, b in INVERSE.items():
        to = F.when(op == a, b).otherwise(to)
    was = lambda c: F.when(adds, F.col(c)).otherwise(F.col(f"prior.{c}")).alias(c)
    back: list[Column] = [was(c) for c in ("place", "kind", "fields", "items", "ids")]
    return done.select("project", (-F.col("seq")).alias("seq"), (-F.col("batch")).alias("batch"), to.alias("op"), "page", "node", *back)

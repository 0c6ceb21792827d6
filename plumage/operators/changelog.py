"""Versioned state from a log of invertible field changes, in DataFrame expressions.

A change is a row (epoch, entity, field, v) with a total order by epoch; a null v sets the field to null. State is
a fold of the log, so replay, undo and inverse are queries on it. A batch is validated first and applied as a whole or not
at all.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def state_at(changes: DataFrame, epoch: int | None = None) -> DataFrame:
    """The last value of each field of each entity, up to an epoch; a null value is kept, being set."""
    rows = changes if epoch is None else changes.where(F.col("epoch") <= epoch)
    return rows.groupBy("entity", "field").agg(F.max(F.struct("epoch", "v")).alias("last")).select("entity", "field", F.col("last.epoch").alias("epoch"), F.col("last.v").alias("v"))


def with_prior(changes: DataFrame) -> DataFrame:
    """Each change with the value it replaces; present says whether there was one."""
    w = Window.partitionBy("entity", "field").orderBy("epoch")
    return changes.withColumns({"prior": F.lag("v").over(w), "present": F.lag("epoch").over(w).isNotNull()})


def inverse(changes: DataFrame) -> DataFrame:
    """The changes that undo these, last one first: seq, entity, field, v (to restore), unset (where nothing was before)."""
    top = changes.agg(F.max("epoch").alias("top"))
    p = with_prior(changes).crossJoin(F.broadcast(top))  # one row
    return p.select((F.col("top") - F.col("epoch") + 1).alias("seq"), "entity", "field", F.col("prior").alias("v"), (~F.col("present")).alias("unset"))


def replay(snapshot: DataFrame, log: DataFrame, epoch: int) -> DataFrame:
    """State from a snapshot at ``epoch`` and the log after it."""
    return state_at(snapshot.unionByName(log.where(F.col("epoch") > epoch)))


def merge_patch(current: DataFrame, patch: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Sparse update: a field changes where <field>_present is true, also to null; new keys are added."""
    c, p = current.alias("c"), patch.alias("p")
    both = c.join(p, F.col(f"c.{key}") == F.col(f"p.{key}"), "full_outer")
    pick = lambda f: F.when(F.coalesce(F.col(f"p.{f}_present"), F.lit(False)), F.col(f"p.{f}")).otherwise(F.col(f"c.{f}")).alias(f)
    return both.select(F.coalesce(f"c.{key}", f"p.{key}").alias(key), *[pick(f) for f in fields])


def upsert(current: DataFrame, new: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row for each key: the new value where there is one."""
    return current.withColumnRenamed(value, "_old").join(new, keys, "full_outer").select(*keys, F.coalesce(value, "_old").alias(value))


def replace_kind(nodes: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Nodes (page, ord, kind, name) less those of a kind, then the new ones, numbered anew."""
    kept = nodes.where(F.col("kind") != kind).withColumn("late", F.lit(0))
    w = Window.partitionBy("page").orderBy("late", "ord")
    return kept.unionByName(new.withColumn("late", F.lit(1))).withColumn("position", F.row_number().over(w) - 1).select("page", "position", "kind", "name")


def reorder_within_kind(nodes: DataFrame, kind: str, order: Column) -> DataFrame:
    """Nodes of a kind take their kind's places of the page in a new order; all others stay."""
    own = nodes.where(F.col("kind") == kind)
    places = own.select("page", "ord", F.row_number().over(Window.partitionBy("page").orderBy("ord")).alias("k"))
    ranked = own.withColumn("k", F.row_number().over(Window.partitionBy("page").orderBy(order, "ord"))).drop("ord")
    return nodes.where(F.col("kind") != kind).select("page", "ord", "kind", "name").unionByName(ranked.join(places, ["page", "k"]).select("page", "ord", "kind", "name"))


def violations(nodes: DataFrame) -> DataFrame:
    """Pages with more than one node of a role that must be single (page, role, n)."""
    return nodes.where("single").groupBy("page", "role").agg(F.count("*").alias("n")).where("n > 1")


def history(commands: DataFrame, cap: int = 500) -> DataFrame:
    """The live actions of each entity after apply, undo and redo (entity, position, epoch, v), oldest first.

    Undo moves the newest action to the redo stack, redo moves it back, a new action clears the redo stack, and only the newest
    ``cap`` actions can be undone (older ones stay). A task reads its entities' commands as a sorted stream: an action that can't
    be undone any more leaves at once, so no more than 2 ``cap`` actions are held, however many commands an entity has.
    """
    kind = dict(commands.dtypes)["entity"]
    rows = commands.select("entity", F.col("epoch").cast("bigint"), "command", F.col("v").cast("int")).repartition("entity").sortWithinPartitions("entity", "epoch")
    return rows.mapInArrow(lambda batches: _live(batches, cap), f"entity {kind}, position int, epoch bigint, v int")


def _live(batches: Iterator[pa.RecordBatch], cap: int) -> Iterator[pa.RecordBatch]:
    entity, started, place = None, False, 0
    done: deque[tuple] = deque()
    undone: list[tuple] = []
    out: list[tuple] = []

    def leave() -> None:
        nonlocal place
        out.append((entity, place, *done.popleft()))
        place += 1

    for b in batches:
        for e, epoch, command, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if not started or e != entity:
                while done:
                    leave()
                entity, started, place = e, True, 0
                undone.clear()
            if command == "undo" and done:
                undone.append(done.pop())
            elif command == "redo" and undone:
                done.append(undone.pop())
            elif command == "apply":
                undone.clear()
                done.append((epoch, v))
                if len(done) > cap:
                    leave()
        yield _columns(out, b.schema.field(0).type)
        out.clear()
    while done:
        leave()
    if out:
        yield _columns(out, b.schema.field(0).type)


def _columns(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [("entity", kind), ("position", pa.int32()), ("epoch", pa.int64()), ("v", pa.int32())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])


# The kinds of typed operations on a scene of pages and nodes.
OPS = ["update_project", "add_page", "remove_page", "update_page", "reorder_pages", "add_node", "remove_node", "update_node", "reorder_nodes"]


def op_errors(ops: DataFrame, pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(batch, place, error): what is wrong with typed operations against the scene as it stands.

    ops: (batch, place, op, page, node, kind, at, ids); pages: (page); nodes: (page, node, kind). A page or node that is added must
    be new and its place at most the number there are; one that is removed or updated must exist, an update that names a
    kind must name the node's own; an order must have the same pages, or nodes of the page, each once. A batch counts as
    wrong by any of its operations; each is judged on the scene, not on what those before it would leave.
    """
    o = ops.join(pages.select("page", F.lit(True).alias("_page")), "page", "left")
    own = nodes.select("page", "node", F.col("kind").alias("_kind"))
    o = o.join(own, ["page", "node"], "left")
    o = o.join(nodes.groupBy("page").agg(F.count("*").alias("_nodes")), "page", "left").crossJoin(F.broadcast(pages.agg(F.count("*").alias("_pages"))))  # one row
    at = F.when(F.col("op") == "reorder_pages", F.lit(-1)).otherwise(F.col("page")).alias("_at")  # node numbers repeat on every page
    listed = ops.where(F.col("op").isin("reorder_pages", "reorder_nodes")).select("batch", "place", "op", at, F.explode("ids").alias("id")).groupBy("batch", "place", "op", "_at", "id").agg(F.count("*").alias("n"))
    known = nodes.select(F.col("page").alias("_at"), F.col("node").alias("id"), F.lit("reorder_nodes").alias("op"), F.lit(1).alias("_in")).unionAll(pages.select(F.lit(-1), "page", F.lit("reorder_pages"), F.lit(1)))
    hit = listed.alias("l").join(known.alias("k"), (F.col("l.op") == F.col("k.op")) & (F.col("l.id") == F.col("k.id")) & (F.col("l._at") == F.col("k._at")), "left")
    order = hit.groupBy("l.batch", "l.place").agg(F.count("k._in").alias("_found"), F.max(F.greatest(F.col("l.n"), F.when(F.col("k._in").isNull(), 2).otherwise(1))).alias("_worst"))
    o = o.join(order, ["batch", "place"], "left")
    has_page, has_node, op = F.col("_page").isNotNull(), F.col("_kind").isNotNull(), F.col("op")
    size = F.when(op == "reorder_pages", F.col("_pages")).otherwise(F.coalesce("_nodes", F.lit(0)))
    same = (F.coalesce("_found", F.lit(0)) == size) & (F.coalesce("_worst", F.lit(1)) == 1)
    error = (
        F.when(~op.isin(*OPS), "unknown operation")
        .when(op == "update_project", None)
        .when(op == "add_page", F.when(has_page, "page exists").when(F.col("at") > F.col("_pages"), "index out of range"))
        .when(op == "reorder_pages", F.when(~same, "other pages"))
        .when(~has_page, "page not found")
        .when(op == "add_node", F.when(has_node, "node exists").when(F.col("at") > F.coalesce("_nodes", F.lit(0)), "index out of range"))
        .when(op.isin("remove_node", "update_node") & ~has_node, "node not found")
        .when((op == "update_node") & (F.col("kind") != F.col("_kind")), "node of another kind")
        .when((op == "reorder_nodes") & ~same, "other nodes")
    )
    return o.select("batch", "place", error.alias("error")).where("error is not null")


def accepted(ops: DataFrame, errors: DataFrame) -> DataFrame:
    """The operations of batches without an error: a batch counts as a whole or not at all."""
    return ops.join(errors.select("batch").distinct(), "batch", "left_anti")

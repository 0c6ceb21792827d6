"""Registered queries on change logs and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.operators import changelog as c
from plumage.sources.fixtures import CHANGES_SQL, changes, table
from plumage.streaming import jobs as j
from plumage.streaming import recovery as rc

#: Event types as job tags, by the order of their names.
TAGS = ["started", "progress", "warning", "finished"]


def events(s, d):
    e = table(s, d, "events")
    tag = F.get(F.array(*map(F.lit, TAGS)), F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(4)).cast("int"))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("job_id"), tag.alias("tag"), "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


EVENTS = "e as (select event_id as seq, user_id as job_id, (['started', 'progress', 'warning', 'finished'])[(event_id * 7 + user_id) % 4 + 1] as tag, event_type, value, ts from events)"


def _undo(s, d):
    cmd = F.when(F.col("epoch") % 5 == 3, "undo").when(F.col("epoch") % 11 == 4, "redo").otherwise("apply")
    return c.history(changes(s, d).select("entity", "epoch", cmd.alias("command"), "v"), 20)


def _replay(s, d):
    log = changes(s, d)
    return c.replay(c.state_at(log, 4000).select("epoch", "entity", "field", "v"), log, 4000)


def _patch(s, d):
    base = table(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    p = table(s, d, "customer").where("c_custkey % 3 = 0").select(
        "c_custkey", F.lit(True).alias("c_mktsegment_present"), F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment"), F.lit(False).alias("c_acctbal_present"), F.lit(0.0).alias("c_acctbal")
    )
    return c.merge_patch(base, p, "c_custkey", ["c_mktsegment", "c_acctbal"])


def nodes(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("name"))


NODES = "nodes as (select conv_id as page, turn as ord, role as kind, coalesce(text, '') as name from conversations)"


def _replace(s, d):
    n = nodes(s, d)
    return c.replace_kind(n, n.where("kind = 'user' and ord < 2").withColumn("name", F.lit("new")), "user")


def _upsert(s, d):
    n = nodes(s, d).groupBy("page", "kind").agg(F.count("*").alias("n"))
    new = n.where("page % 2 = 0").select("page", F.lit("mask").alias("kind"), F.lit(0).cast("long").alias("n")).unionByName(n.where("kind = 'user'").withColumn("n", F.col("n") + 100))
    return c.upsert(n, new, ["page", "kind"], "n")


def _resumed(s, d):
    clients = table(s, d, "customer").select(F.col("c_custkey").alias("client"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey") * 7).alias("last_seq"))
    return j.resumed(clients, events(s, d))


#: Operations on conversations as pages and turns as nodes: (op, page, node, kind, at) by the event's number.
OP_COLUMNS = [
    "cast(floor(event_id / 3) as bigint) as batch", "cast(event_id % 3 as int) as place",
    f"case event_id % 11 {' '.join(f'when {k} then {chr(39)}{x}{chr(39)}' for k, x in enumerate(c.OPS))} else 'rename' end as op",
    "user_id * 3 as page", "event_id % 9 as node", "case when event_id % 5 < 3 then 'user' when event_id % 5 = 3 then 'assistant' end as kind", "event_id % 8 as at",
]


def _ops(s, d):
    pages = table(s, d, "conversations").select(F.col("conv_id").alias("page")).distinct()
    own = table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("node"), F.col("role").alias("kind"))
    lists = own.groupBy("page").agg(F.collect_list("node").alias("ids"))  # a page's nodes
    ops = table(s, d, "events").selectExpr(*OP_COLUMNS).join(lists, "page", "left")
    ops = ops.withColumn("ids", F.when(F.col("node") < 3, F.col("ids")).when(F.col("node") < 6, F.concat("ids", F.array("node"))).otherwise(F.array_remove("ids", F.col("node"))))
    return ops, pages, own


def _accepted(s, d):
    ops, pages, own = _ops(s, d)
    return c.accepted(ops, c.op_errors(ops, pages, own)).select("batch", "place", "op")


def _failures(s, d):
    return j.isolated_failures(events(s, d).select(F.col("job_id").alias("page"), F.col("seq").alias("step"), (F.col("seq") % 23 == 0).alias("failed")))


def _bus_events(s, d):
    """Ten jobs share a bus; a bus is read every 37 events, of which it keeps 20."""
    e = events(s, d).withColumn("bus", F.floor(F.col("job_id") / 10))
    seq = F.row_number().over(Window.partitionBy("bus").orderBy("seq")).cast("long")
    return e.withColumn("seq", seq).select("bus", "seq", "job_id", "tag", F.floor(F.col("seq") / 37).alias("read"))


QUERIES = {
    "event_lag_reads": lambda s, d: rc.reads(_bus_events(s, d), "read", 20),
    "event_lag_recovery": lambda s, d: rc.mirrored(rc.frames(_bus_events(s, d), "read", 20)),
    "change_fold": lambda s, d: c.state_at(changes(s, d)),
    "change_prior": lambda s, d: c.with_prior(changes(s, d)).select("epoch", "v", F.col("prior").cast("double").alias("prior"), "present"),
    "change_inverse": lambda s, d: c.inverse(changes(s, d)).withColumn("v", F.col("v").cast("double")),
    "change_replay": _replay,
    "change_sparse_patch": _patch,
    "change_undo": _undo,
    "node_replace_kind": _replace,
    "node_reorder_within_kind": lambda s, d: c.reorder_within_kind(nodes(s, d), "user", F.col("name")),
    "node_upsert_by_role": _upsert,
    "node_violations": lambda s, d: c.violations(nodes(s, d).select("page", F.col("kind").alias("role"), (F.col("kind") != "user").alias("single"))),
    "event_replay_tail": lambda s, d: j.replay_since(events(s, d), 9900).select("seq", "job_id", "tag"),
    "scene_op_errors": lambda s, d: c.op_errors(*_ops(s, d)),
    "scene_batches_accepted": _accepted,
    "event_gap_replay": lambda s, d: j.gaps(events(s, d)),
    "event_resume": _resumed,
    "event_job_state": lambda s, d: j.job_state(events(s, d)),
    "event_change_points": lambda s, d: j.change_points(events(s, d), "job_id", "event_type").select("seq", "job_id", "event_type"),
    "event_debounce": lambda s, d: j.debounced(events(s, d), "job_id", "30 minutes").groupBy("job_id").agg(F.count("*").alias("bursts"), F.max("n").alias("most")),
    "event_failure_isolation": _failures,
    "event_progress_percent": lambda s, d: events(s, d).select("seq", F.expr("least(seq * 100 div (job_id * 60 + 1), 100)").alias("percent"), F.least(F.lit(10_000), F.lit(200) * F.pow(F.lit(2), F.least(F.col("job_id") % 9, F.lit(6)))).cast("int").alias("backoff_ms")),
}

_ERRORS = f"""p as (select distinct conv_id as page from conversations), n as (select conv_id as page, turn as node, role as kind from conversations),
l as (select page, list(node) as ids, count(*) as nodes from n group by 1), e0 as (select {", ".join(OP_COLUMNS)} from events),
o as (select e0.*, l.nodes, p.page is not null as has_page, n.kind as own, case when e0.node < 3 then ids when e0.node < 6 then list_append(ids, e0.node) else list_filter(ids, lambda x: x <> e0.node) end as ids from e0 left join l on l.page = e0.page left join p on p.page = e0.page left join n on n.page = e0.page and n.node = e0.node),
w as (select *, (select count(*) from p) as pages from o),
v as (select batch, place, op, case when op = 'rename' then 'unknown operation' when op = 'update_project' then null
  when op = 'add_page' then case when has_page then 'page exists' when w."at" > pages then 'index out of range' end
  when op = 'reorder_pages' then case when not coalesce(len(ids) = pages and len(list_distinct(ids)) = pages and list_has_all((select list(page) from p), ids), false) then 'other pages' end
  when not has_page then 'page not found'
  when op = 'add_node' then case when own is not null then 'node exists' when w."at" > nodes then 'index out of range' end
  when op in ('remove_node', 'update_node') and own is null then 'node not found'
  when op = 'update_node' and kind <> own then 'node of another kind'
  when op = 'reorder_nodes' and not (node < 3 or node >= 6 and own is null) then 'other nodes' end as error from w)"""
_BUSES = f"{EVENTS}, be as (select *, cast(floor(job_id / 10) as bigint) as bus from e), bs as (select bus, job_id, tag, row_number() over (partition by bus order by seq) as seq from be)"
ORACLES = {
    "event_lag_reads": f"with {_BUSES}, r as (select bus, cast(floor(seq / 37) as bigint) as read, count(*) as n, max(seq) as top from bs group by all) select bus, read, top - least(n, 20) + 1 as from_seq, least(n, 20) as n_events, n - least(n, 20) as lost, n > 20 or row_number() over (partition by bus order by read) = 1 as snapshot from r",
    "event_lag_recovery": f"with {_BUSES}, l as (select *, max(seq) filter (tag = 'started') over (partition by job_id) as start from bs) select bus, job_id, case when count(*) filter (tag = 'finished') = 0 then 'running' when count(*) filter (tag = 'warning') = 0 then 'completed' else 'completed_with_errors' end as status, count(*) filter (tag = 'warning') as warnings, max(seq) as last_seq from l where start is null or seq >= start group by all",
    "scene_op_errors": f"with {_ERRORS} select batch, place, error from v where error is not null",
    "scene_batches_accepted": f"with {_ERRORS} select batch, place, op from v where batch not in (select batch from v where error is not null)",
    "change_fold": f"with {CHANGES_SQL} select entity, field, epoch, v from changes qualify row_number() over (partition by entity, field order by epoch desc) = 1",
    "change_prior": f"with {CHANGES_SQL} select epoch, v, cast(lag(v) over w as double) as prior, lag(epoch) over w is not null as present from changes window w as (partition by entity, field order by epoch)",
    "change_inverse": f"with {CHANGES_SQL} select max(epoch) over () - epoch + 1 as seq, entity, field, cast(lag(v) over w as double) as v, lag(epoch) over w is null as unset from changes window w as (partition by entity, field order by epoch)",
    "change_replay": f"with {CHANGES_SQL} select entity, field, epoch, v from changes qualify row_number() over (partition by entity, field order by epoch desc) = 1",
    "change_undo": f"""with recursive {CHANGES_SQL},
c as (select entity, row_number() over (partition by entity order by epoch) as i, {{'epoch': epoch, 'v': v}} as item, case when epoch % 5 = 3 then 'undo' when epoch % 11 = 4 then 'redo' else 'apply' end as cmd from changes),
k as (select distinct entity, cast(0 as bigint) as i, cast([] as struct(epoch bigint, v int)[]) as done, cast([] as struct(epoch bigint, v int)[]) as undone, cast([] as struct(epoch bigint, v int)[]) as fixed from c
  union all select k.entity, c.i,
    case when cmd = 'apply' then (list_append(done, item))[greatest(len(done) + 2 - 20, 1):] when cmd = 'undo' and len(done) > 0 then done[:len(done) - 1] when cmd = 'redo' and len(undone) > 0 then list_append(done, undone[len(undone)]) else done end,
    case when cmd = 'apply' then [] when cmd = 'undo' and len(done) > 0 then list_append(undone, done[len(done)]) when cmd = 'redo' and len(undone) > 0 then undone[:len(undone) - 1] else undone end,
    case when cmd = 'apply' and len(done) = 20 then list_append(fixed, done[1]) else fixed end
  from k join c on c.entity = k.entity and c.i = k.i + 1),
f as (select entity, list_concat(fixed, done) as items from k qualify i = max(i) over (partition by entity))
select entity, cast(p as int) as position, items[p + 1].epoch as epoch, items[p + 1].v as v from f, unnest(range(len(items))) r(p)""",
    "change_sparse_patch": "select c_custkey, case when c_custkey % 3 = 0 then case when c_custkey % 2 = 0 then 'NEW' end else c_mktsegment end as c_mktsegment, c_acctbal from customer",
    "node_replace_kind": f"with {NODES} select page, cast(row_number() over (partition by page order by late, ord) - 1 as int) as position, kind, name from (select *, 0 as late from nodes where kind <> 'user' union all select page, ord, kind, 'new', 1 from nodes where kind = 'user' and ord < 2)",
    "node_reorder_within_kind": f"with {NODES} select page, ord, kind, name from nodes where kind <> 'user' union all select a.page, b.ord, a.kind, a.name from (select *, row_number() over (partition by page order by encode(name), ord) as k from nodes where kind = 'user') a join (select *, row_number() over (partition by page order by ord) as k from nodes where kind = 'user') b on a.page = b.page and a.k = b.k",
    "node_upsert_by_role": f"with {NODES}, g as (select page, kind, count(*) as n from nodes group by all), w as (select distinct page, 'mask' as kind, cast(0 as bigint) as n, page % 2 as p from g) select page, kind, case when kind = 'user' then n + 100 else n end as n from g union all select page, kind, n from (select page, kind, n, count(*) as times from (select g.page, 'mask' as kind, cast(0 as bigint) as n from g where page % 2 = 0) group by all), range(times)",
    "node_violations": f"with {NODES} select page, kind as role, count(*) as n from nodes where kind <> 'user' group by all having count(*) > 1",
    "event_replay_tail": f"with {EVENTS} select seq, job_id, tag from e where seq > 9900 and seq > (select max(seq) from e) - 256",
    "event_gap_replay": f"with {EVENTS} select job_id, before + 1 as missing_from, seq - 1 as missing_to from (select *, lag(seq) over (partition by job_id order by seq) as before from e) where seq > before + 1",
    "event_resume": f"with {EVENTS}, r as (select seq from e where seq > (select max(seq) from e) - 256), c as (select c_custkey as client, case when c_custkey % 9 <> 0 then c_custkey * 7 end as last_seq from customer) select client, last_seq, cast(count(seq) as int) as n_replayed, last_seq is null or coalesce(min(seq) > last_seq + 1, false) as snapshot from c left join r on seq > last_seq group by client, last_seq",
    "event_job_state": f"with {EVENTS} select job_id, case when count(*) filter (tag = 'finished') = 0 then 'running' when count(*) filter (tag = 'warning') = 0 then 'completed' else 'completed_with_errors' end as status, count(*) filter (tag = 'warning') as warnings, max(seq) as last_seq from (select *, max(seq) filter (tag = 'started') over (partition by job_id) as start from e) where start is null or seq >= start group by 1",
    "event_change_points": f"with {EVENTS} select seq, job_id, event_type from (select *, lag(event_type) over (partition by job_id order by seq) as b from e) where b is distinct from event_type",
    "event_debounce": f"with {EVENTS}, s as (select job_id, ts, sum(case when ts - b < interval 30 minutes then 0 else 1 end) over (partition by job_id order by ts, seq) as k from (select *, lag(ts) over (partition by job_id order by ts, seq) as b from e)) select job_id, count(*) as bursts, max(n) as most from (select job_id, k, count(*) as n from s group by all) group by 1",
    "event_failure_isolation": f"with {EVENTS} select page, step, failed from (select job_id as page, seq as step, seq % 23 = 0 as failed, coalesce(max(case when seq % 23 = 0 then 1 else 0 end) over (partition by job_id order by seq rows between unbounded preceding and 1 preceding), 0) as f from e) where f = 0",
    "event_progress_percent": f"with {EVENTS} select seq, least(seq * 100 // (job_id * 60 + 1), 100) as percent, cast(least(10000, 200 * pow(2, least(job_id % 9, 6))) as int) as backoff_ms from e",
}

"""Registered queries on typed operations applied to scenes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.operators import scene as sc
from plumage.sources import ingest as ing
from plumage.sources.fixtures import table

#: Conversations are pages, ten of them a project; turns are nodes. Each turn also stands for an operation on its page.
PROJECT = "cast(floor(conv_id / 10) as bigint)"


def scenes(s, d):
    """The scene of all conversations, whole texts as fields."""
    c = table(s, d, "conversations")
    pages = c.select("conv_id").distinct().select(F.expr(PROJECT).alias("project"), F.col("conv_id").cast("string").alias("page"))
    pages = pages.withColumn("place", F.expr("cast(row_number() over (partition by project order by cast(page as bigint)) - 1 as int)"))
    name = lambda v: F.create_map(F.lit("name"), v)
    none = lambda c, t="string": F.lit(None).cast(t).alias(c)
    projects = pages.select("project").distinct().select("project", none("page"), none("node"), none("place", "int"), none("kind"), name(F.col("project").cast("string")).alias("fields"))
    own = pages.select("project", "page", none("node"), "place", none("kind"), name(F.col("page")).alias("fields"))
    nodes = c.select(
        F.expr(PROJECT).alias("project"), F.col("conv_id").cast("string").alias("page"), F.col("turn").cast("string").alias("node"), F.expr("cast(row_number() over (partition by conv_id order by turn) - 1 as int)").alias("place"),
        F.expr("case when role = 'system' then 'mask' else 'text' end").alias("kind"), F.expr("map('role', role, 'text', text)").alias("fields"),
    )
    return projects.unionAll(own).unionAll(nodes)


def logs(s, d):
    """An operation for each turn, of all kinds, some of which can't be done; two or three make a batch."""
    k = "((conv_id * 7 + turn * 3) % 11)"
    c = table(s, d, "conversations").select(F.expr(PROJECT).alias("project"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.expr(k).alias("k"), "conv_id", "turn", "role", "text")
    own = c.groupBy("conv_id").agg(F.transform(F.reverse(F.array_sort(F.collect_list("turn"))), lambda x: x.cast("string")).alias("nodes"))  # a page's nodes
    pages = c.groupBy("project").agg(F.transform(F.reverse(F.array_sort(F.collect_set("conv_id"))), lambda x: x.cast("string")).alias("pages"))  # ten at most
    c = c.join(own, "conv_id").join(pages, "project")
    kinds = ["update_page", "add_node", "remove_node", "update_node", "reorder_nodes", "add_page", "remove_page", "reorder_pages", "update_project", "update_node", "rename"]
    items = f"case when k = 5 then array(named_struct('node', 'a', 'kind', 'text', 'fields', map('text', text)), named_struct('node', 'b', 'kind', 'mask', 'fields', map('role', 'segment'))) end"
    return c.select(
        "project", "seq", F.floor(F.col("seq") / 3).alias("batch"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("k") + 1).cast("int")).alias("op"),
        F.expr("case when k = 5 then concat('new', seq) when k = 6 then cast(conv_id - 1 as string) else cast(conv_id as string) end").alias("page"),
        F.expr("case when k = 1 then concat('x', turn) else cast(turn as string) end").alias("node"), F.expr("cast(turn % 4 as int)").alias("place"),
        F.expr("case when k = 9 then 'image' when k in (1, 3) then case when role = 'system' then 'mask' else 'text' end end").alias("kind"),
        F.expr("case when k = 3 then map('text', cast(null as string), 'style', role) when k = 1 then map('text', text, 'role', 'segment') else map('name', concat('n', turn), 'style', role) end").alias("fields"),
        F.expr(items).alias("items"), F.expr("case when k = 7 then pages when turn % 2 = 0 then nodes else array_append(nodes, 'y') end").alias("ids"),
    )


def _flat(df):
    """Fields as text, in order of their names, so that they can be compared."""
    entry = F.transform(F.array_sort(F.map_entries(F.map_filter("fields", lambda _, v: v.isNotNull()))), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return df.withColumn("fields", F.array_join(entry, ";"))


def _ops(s, d):
    ops, _ = sc.applied(scenes(s, d), logs(s, d))
    return ops.select("project", "seq", "op", "error", F.col("prior.place").alias("prior_place"), F.size(F.coalesce("prior.items", F.array())).alias("n_items"), F.array_join("prior.ids", ",").alias("prior_ids"))


def _items(s, d):
    return _flat(sc.applied(scenes(s, d), logs(s, d))[1])


def _round_trip(s, d):
    ops, after = sc.applied(scenes(s, d), logs(s, d))
    return _flat(sc.applied(after, sc.inverted(ops))[1])


def _updates(s, d):
    """Updates alone, which always can be done: each field's last value."""
    return _flat(sc.applied(scenes(s, d), logs(s, d).where("op in ('update_page', 'update_project') or op = 'update_node' and kind <> 'image'"))[1])


def _files(s, d):
    """Documents as files of projects, numbered without leading zeros."""
    return table(s, d, "documents").selectExpr("cast(floor(doc_id / 25) as bigint) as project", "concat('page-', doc_id % 25, '.png') as name", "sha2(coalesce(text, ''), 256) as hash", "cast(600 + length(coalesce(text, '')) % 400 as int) as width", "900 as height", "floor(doc_id / 25) % 2 = 0 as replace")


def _import(s, d):
    return ing.import_pages(_files(s, d), scenes(s, d)).select("project", "batch", "op", "page", "place", F.element_at("fields", "name").alias("name"), F.get("items", F.lit(0))["fields"]["blob"].alias("blob"))


def _inpaint(seen):
    """A step that makes a picture of a page's masks, and can't do so for every seventh upload."""
    made = seen.groupBy("project", "seq", "page").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "role", "blob"))), ";"), 256).alias("blob"))  # six masks at most
    op = F.when(F.col("seq") % 7 == 0, "failed").otherwise("add_node")
    fields = F.create_map(F.lit("role"), F.lit("inpainted"), F.lit("blob"), F.col("blob"))
    return ing.operations(made, project=F.col("project"), seq=F.col("seq") * 1000 + 1, batch=F.col("seq"), op=op, page=F.col("page"), node=F.lit("inpainted"), place=F.lit(0), kind=F.lit("image"), fields=fields)


def _masks(s, d):
    """One upload for each page; the scene after those that the step could follow."""
    c = table(s, d, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    up = c.select(F.expr(PROJECT).alias("project"), F.col("conv_id").alias("seq"), F.col("conv_id").cast("string").alias("page"), F.when(F.col("turn") % 2 == 0, "system").otherwise("brushInpaint").alias("role"), F.concat(F.lit("new"), "turn").alias("blob"))
    scene = scenes(s, d)
    after = sc.applied(scene, ing.upload_masks(up, scene, _inpaint))[1]
    return after.where("kind in ('mask', 'image')").select("project", "page", "node", "kind", F.element_at("fields", "role").alias("role"), F.element_at("fields", "blob").alias("blob"), F.element_at("fields", "visible").alias("visible"))


def _layers(s, d):
    up = table(s, d, "conversations").where("role = 'user'").select(F.expr(PROJECT).alias("project"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("page"), F.lit(None).cast("string").alias("name"), F.sha2("text", 256).alias("hash"), (F.length("text") % 90).alias("width"), (F.length("text") % 70).alias("height"))
    sized = scenes(s, d).withColumn("fields", F.when(F.col("page").isNotNull() & F.col("node").isNull(), F.map_concat("fields", F.create_map(F.lit("width"), F.lit("640"), F.lit("height"), F.lit("480")))).otherwise(F.col("fields")))
    after = sc.applied(sized, ing.add_image_layers(up, sized))[1]
    return after.where("kind = 'image'").select("project", "page", "node", "place", *[F.element_at("fields", k).alias(k) for k in ("name", "x", "y", "blob")])


QUERIES = {"ingest_pages": _import, "mask_upload": _masks, "image_layers": _layers} | {"scene_applied_ops": _ops, "scene_applied": _items, "scene_round_trip": _round_trip, "scene_updates": _updates}

_SCENE = f"""pg as (select distinct {PROJECT} as project, conv_id from conversations), sc as (
select distinct project, null::varchar as page, null::varchar as node, null::int as place, null::varchar as kind, 'name=' || project as fields from pg
union all select project, conv_id::varchar, null, cast(row_number() over (partition by project order by conv_id) - 1 as int), null, 'name=' || conv_id from pg
union all select {PROJECT}, conv_id::varchar, turn::varchar, cast(row_number() over (partition by conv_id order by turn) - 1 as int), case when role = 'system' then 'mask' else 'text' end,
  concat_ws(';', 'role=' || role, 'text=' || text) from conversations)"""
_LAST = f"""lg as (select {PROJECT} as project, conv_id, turn, role, (conv_id * 7 + turn * 3) % 11 as k from conversations)"""
_TEXT_FILES = "select cast(floor(doc_id / 25) as bigint) as project, doc_id % 25 as k, 'page-' || doc_id % 25 || '.png' as name, sha256(coalesce(text, '')) as hash, floor(doc_id / 25) % 2 = 0 as replace from documents"
ORACLES = {
    "ingest_pages": f"""with f as ({_TEXT_FILES}), pg as (select distinct {PROJECT} as project, conv_id from conversations), n as (select project, count(*) as n from pg group by 1),
a as (select f.project, name, hash, row_number() over (partition by f.project order by k) - 1 + case when replace then 0 else coalesce(n, 0) end as place from f left join n using (project))
select project, 1 as batch, 'add_page' as op, hash || '-' || place as page, cast(place as int) as place, name, hash as blob from a
union all select pg.project, 0, 'remove_page', conv_id::varchar, null, null, null from pg where project in (select project from f where replace)""",
    "mask_upload": f"""with c as (select conv_id, max(turn) as t, min(turn) filter (role = 'system') as sys, count(*) filter (role = 'system') as n from conversations group by 1), u as (select *, case when t % 2 = 0 then 'system' else 'brushInpaint' end as role, 'new' || t as blob, conv_id % 7 <> 0 as done from c),
m as (select conv_id, turn::varchar as node, 'mask' as kind, 'system' as role, case when done and u.role = 'system' and turn = sys then u.blob end as blob, null as visible from conversations join u using (conv_id) where conversations.role = 'system'
  union all select conv_id, 'mask-' || role, 'mask', role, blob, case when role = 'brushInpaint' then 'true' else 'false' end from u where done and (role <> 'system' or sys is null)
  union all select conv_id, 'inpainted', 'image', 'inpainted', sha256(case when role <> 'system' and sys is not null then role || '=' || blob || ';system' else role || '=' || blob end), null from u where done)
select {PROJECT} as project, conv_id::varchar as page, node, kind, role, blob, visible from m""",
    "image_layers": f"""with c as (select conv_id, turn, text, count(*) over (partition by conv_id) as n, role from conversations), u as (select *, row_number() over (partition by conv_id order by turn) - 1 as k from c where role = 'user')
select {PROJECT} as project, conv_id::varchar as page, 'layer-' || (conv_id * 100 + turn) as node, cast(n + k as int) as place, 'layer.png' as name, cast(round((640 - length(text) % 90) * 0.5) as bigint)::varchar as x, cast(round((480 - length(text) % 70) * 0.5) as bigint)::varchar as y, sha256(text) as blob from u""",
    "scene_round_trip": f"with {_SCENE} select * from sc",
    "scene_updates": f"""with {_SCENE}, {_LAST}, up as (select project, arg_max('n' || turn, conv_id * 1000 + turn) as name, arg_max(role, conv_id * 1000 + turn) as style from lg where k = 8 group by 1),
ua as (select conv_id::varchar as page, arg_max('n' || turn, turn) as name, arg_max(role, turn) as style from lg where k = 0 group by 1), un as (select conv_id::varchar as page, turn::varchar as node, role as style from lg where k = 3)
select sc.project, sc.page, sc.node, place, kind, case when sc.page is null and up.name is not null then concat_ws(';', 'name=' || up.name, 'style=' || up.style) when sc.node is null and ua.name is not null then concat_ws(';', 'name=' || ua.name, 'style=' || ua.style)
  when un.node is not null then concat_ws(';', 'role=' || un.style, 'style=' || un.style) else fields end as fields
from sc left join up on sc.page is null and up.project = sc.project left join ua on sc.node is null and ua.page = sc.page left join un on un.page = sc.page and un.node = sc.node""",
}

"""Registered queries on nodes, small rules and JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import geometry as g
from plumage.operators import nodes as n
from plumage.sources.fixtures import BOXES_SQL, boxes, table


def talk(s, d):
    return table(s, d, "conversations").select(
        F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.col("role").alias("kind"), "role", F.coalesce("text", F.lit("")).alias("name"), F.when(F.col("turn") % 3 == 0, "  ").otherwise(F.col("text")).alias("text"), (F.col("conv_id") * 100 + F.col("turn")).alias("id")
    )


TALK = "t as (select conv_id as page, turn as ord, role as kind, role, coalesce(text, '') as name, case when turn % 3 = 0 then '  ' else text end as text, conv_id * 100 + turn as id from conversations)"


def _targets(s, d):
    allowed = talk(s, d).where("page % 2 = 0").select("id")
    return n.targets(talk(s, d), allowed).select("page", "ord")


def _predictions(s, d):
    p = table(s, d, "events").select((F.col("event_id") % 120).alias("page"), F.pmod("user_id", F.lit(10)).cast("int").alias("k"), "event_id")
    return n.by_index(p, talk(s, d), "k").select("event_id", "page", "ord")


def _same_ids(s, d):
    a = table(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).alias("i"))
    b = table(s, d, "orders").select(F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3 + (F.col("o_custkey") % 50 == 0).cast("int")).alias("i"))
    return n.same_ids(a, b, "k", "i")


def _status(s, d):
    e = table(s, d, "events").select("user_id", F.col("event_id").alias("seq"), F.get(F.array(*map(F.lit, ["empty", "loading", "ready", "failed"])), (F.col("event_id") % 4).cast("int")).alias("status"))
    return n.latest_status(e, "user_id")


def _patched(s, d):
    cur = table(s, d, "supplier").select("s_suppkey", F.col("s_name").alias("secret"))
    patch = table(s, d, "supplier").where("s_suppkey % 2 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 4 == 0, "[REDACTED]").otherwise("new").alias("secret"))
    return n.patched_list(cur, patch, "s_suppkey", "secret")


def _snapped(s, d):
    b = boxes(s, d)
    c = [(F.col(x) % 256).cast("int") for x in ("x1", "y1", "score")]
    o = [(F.col(x) % 256).cast("int") for x in ("x2", "y2", "score")]
    r = n.snapped(c)
    return b.select("page_id", "box_id", *[x.cast("int").alias(k) for x, k in zip(r, "rgb")], n.similar_colours(c, o, 60).alias("similar"))


def _sizes(s, d):
    b = boxes(s, d)
    w, h = n.scaled(F.col("x2"), F.col("y2"), 512)
    left, right = n.crop_side(F.col("x1"), F.col("x2"), 40, 1010)
    radius = n.dilate_radius(F.when(F.col("box_id") % 2 == 0, F.col("score") / 10), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), 0.25, 2, 12)
    return b.select("page_id", "box_id", w.alias("w"), h.alias("h"), n.ceil_multiple(F.col("x2"), 8).alias("m"), left.alias("crop_from"), right.alias("crop_to"), radius.alias("radius"), F.round(n.rate(F.col("score"), F.col("x1") / 1000), 6).alias("rate"))


def _clip(s, d):
    b = boxes(s, d)
    c = g.clamped({k: F.col(k) - 100 for k in g.SIDES}, F.lit(500), F.lit(700))
    return b.select("page_id", "box_id", *[x.alias(k) for k, x in c.items()]).where("x2 > x1 and y2 > y1")


def _json(s, d):
    e = table(s, d, "events").select("event_id", F.from_json("props", "k int").alias("p"))
    return e.select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("p.k").alias("k"))).alias("json"))


def _alpha(s, d):
    px = boxes(s, d).select(F.col("page_id").alias("page"), "box_id", (F.col("score") % 256).cast("int").alias("alpha"))
    out = n.alpha_restored(px.where("box_id % 2 = 0"), px.where("box_id % 2 = 1"))
    return out.select("page", "box_id", "alpha")


def _components(s, d):
    return n.component_boxes(boxes(s, d).select(F.col("page_id").alias("page"), (F.col("x1") % 40).alias("x"), (F.col("y1") % 40).alias("y")))


QUERIES = {
    "node_text_projection": lambda s, d: n.of_kind(talk(s, d), "user").select("page", "ord", "position"),
    "node_first_by_role": lambda s, d: n.first_of_role(talk(s, d), "assistant"),
    "node_required_source": lambda s, d: n.required(talk(s, d).where("role = 'user'").select("page").distinct(), talk(s, d), "user").select("page", "name"),
    "node_targets": _targets,
    "node_prediction_index": _predictions,
    "id_set_equality": _same_ids,
    "model_status": _status,
    "config_patch": _patched,
    "colour_snap": _snapped,
    "size_rules": _sizes,
    "region_clip": _clip,
    "event_json": _json,
    "alpha_restore": _alpha,
    "raster_component_boxes": _components,
}

ORACLES = {
    "node_text_projection": f"with {TALK} select page, ord, cast(row_number() over (partition by page order by ord) - 1 as int) as position from t where kind = 'user'",
    "node_first_by_role": f"with {TALK} select page, ord, name from t where role = 'assistant' qualify row_number() over (partition by page order by ord) = 1",
    "node_required_source": f"with {TALK} select page, name from t where role = 'user' qualify row_number() over (partition by page order by ord) = 1",
    "node_targets": f"with {TALK} select page, ord from t where trim(text) <> '' and page % 2 = 0",
    "node_prediction_index": f"with {TALK}, q as (select page, ord, row_number() over (partition by page order by ord) - 1 as k from t) select event_id, q.page, ord from events join q on q.page = event_id % 120 and q.k = user_id % 10",
    "id_set_equality": "with a as (select o_custkey as k, o_orderkey % 3 as i, count(*) as x from orders group by 1, 2), b as (select o_custkey as k, o_orderkey % 3 + case when o_custkey % 50 = 0 then 1 else 0 end as i, count(*) as y from orders group by 1, 2) select coalesce(a.k, b.k) as k, bool_and(coalesce(x = y, false)) as same from a full join b on a.k = b.k and a.i = b.i group by 1",
    "model_status": "select user_id, (['empty', 'loading', 'ready', 'failed'])[max(event_id) % 4 + 1] as status from events group by 1",
    "config_patch": "select s_suppkey, case when s_suppkey % 4 = 0 then s_name else 'new' end as secret from supplier where s_suppkey % 2 = 0",
    "colour_snap": f"with {BOXES_SQL}, c as (select page_id, box_id, x1 % 256 as a, y1 % 256 as b, score % 256 as c, x2 % 256 as e, y2 % 256 as f from boxes), k as (select *, case when greatest(a, b, c) - least(a, b, c) <= 10 then 60 else 12 end as l from c) select page_id, box_id, cast(case when greatest(a, b, c) <= l then 0 when least(a, b, c) >= 255 - l then 255 else a end as int) as r, cast(case when greatest(a, b, c) <= l then 0 when least(a, b, c) >= 255 - l then 255 else b end as int) as g, cast(case when greatest(a, b, c) <= l then 0 when least(a, b, c) >= 255 - l then 255 else c end as int) as b, abs(a - e) <= 60 and abs(b - f) <= 60 as similar from k",
    "size_rules": f"""with {BOXES_SQL}, k as (select *, greatest(x2, y2) as longer, (x1 + x2) // 2 - (x2 - x1 + 80) // 2 as a, (x1 + x2) // 2 + (x2 - x1 + 80) // 2 as z from boxes),
l as (select *, least(greatest(greatest(a, 0) - greatest(z - 1010, 0), 0), 1010) as c1, least(least(z, 1010) + greatest(-a, 0), 1010) as c2 from k)
select page_id, box_id, cast(case when longer <= 512 then x2 else greatest(round(x2 * (512 / longer)), 1) end as int) as w, cast(case when longer <= 512 then y2 else greatest(round(y2 * (512 / longer)), 1) end as int) as h, cast((x2 + 7) // 8 * 8 as int) as m, cast(c1 as int) as crop_from, cast(least(greatest(c2, c1 + 1), 1010) as int) as crop_to,
cast(greatest(2, least(12, round(case when box_id % 2 = 0 then score / 10 else greatest(least(x2 - x1, y2 - y1), 1) end * cast(0.25 as double)))) as int) as radius, round(coalesce(score / nullif(x1 / 1000, 0), 0), 6) as rate from l""",
    "region_clip": f"with {BOXES_SQL} select * from (select page_id, box_id, greatest(0, least(x1 - 100, 500)) as x1, greatest(0, least(y1 - 100, 700)) as y1, greatest(0, least(x2 - 100, 500)) as x2, greatest(0, least(y2 - 100, 700)) as y2 from boxes) where x2 > x1 and y2 > y1",
    "event_json": """select event_id, coalesce(cast(json_extract_string(props, '$.k') as int), -1) as k, '{"seq":' || event_id || coalesce(',"k":' || json_extract_string(props, '$.k'), '') || '}' as json from events""",
    "alpha_restore": f"with {BOXES_SQL}, m as (select page_id, cast(floor(median(score % 256)) as int) as m from boxes where box_id % 2 = 1 group by 1) select page_id as page, box_id, cast(case when m < 128 then m else score % 256 end as int) as alpha from boxes left join m using (page_id) where box_id % 2 = 0",
    "raster_component_boxes": f"""with recursive {BOXES_SQL}, p as (select distinct page_id as page, x1 % 40 as x, y1 % 40 as y from boxes), e as (select a.page, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from p a join p b on a.page = b.page and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
r as (select page, x as sx, y as sy, x, y from p union select r.page, sx, sy, bx, by_ from r join e on e.page = r.page and e.ax = r.x and e.ay = r.y),
c as (select page, sx, sy, min(y * 1048576 + x) as c from r group by all) select page, min(sx) as x1, min(sy) as y1, max(sx) + 1 as x2, max(sy) + 1 as y2, count(*) as n from c group by page, c""",
}

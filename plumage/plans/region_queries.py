"""Registered queries on painted labels: distances, safe boxes, filled regions, holes, outlines; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.operators import raster as r
from plumage.operators import regions as g
from plumage.plans.misc_queries import PAGE, PIXELS_SQL, above, mask_labels, pixels
from plumage.sources.fixtures import BOXES_SQL, boxes

#: Areas of 52 x 44 pages that are painted over each other; the boxes of 32 pages share one.
WIDTH, HEIGHT = 52, 44
BUBBLE = "cast(floor(page_id / 32) as bigint)"
BUBBLES = [f"{BUBBLE} as page_id", "page_id * 100 + box_id as box_id", "x1 % 36 as x1", "y1 % 28 as y1", "x1 % 36 + 6 + score % 10 as x2", "y1 % 28 + 5 + x1 % 9 as y2"]
SEEDS = [f"{BUBBLE} as page", "page_id * 100 + box_id as seed", "case when score % 3 = 0 then 'vertical' else 'horizontal' end as mode", "cast(x1 % 47 - 2 as int) as x1", "cast(y1 % 40 - 1 as int) as y1", "cast(x1 % 47 + 4 as int) as x2", "cast(y1 % 40 + 3 as int) as y2"]


def labels(s, d):
    return g.painted(boxes(s, d).selectExpr(*BUBBLES), WIDTH, HEIGHT).withColumnRenamed("page_id", "page")


def paint(s, d):
    """What ``labels`` paints."""
    return g.paint(boxes(s, d).selectExpr(*BUBBLES), WIDTH, HEIGHT).withColumnRenamed("page_id", "page")


def _layout(s, d):
    return g.painted_layout_boxes(paint(s, d), boxes(s, d).selectExpr(*SEEDS), WIDTH, HEIGHT)


#: Text blocks of which a detector is sure.
BLOCKS = [f"{PAGE} as page", "page_id * 100 + box_id as area", "x1 % 22 as x1", "y1 % 25 as y1", "x1 % 22 + 7 as x2", "y1 % 25 + 4 as y2", "1 + cast(score % 2 as int) as r"]


def _regions(s, d):
    blocks = boxes(s, d).where("score >= 990").selectExpr(*BLOCKS)
    return g.filled_regions(above(s, d, 235), blocks, mask_labels(s, d), 32, 32, 0.45, 1, 3)


def _holes(s, d):
    grown = r.dilated(r.binarized(pixels(s, d), 60), 1, 32, 32, diamond=True).select("page", "x", "y")
    whole = grown.withColumns({k: F.lit(v) for k, v in (("wx1", 0), ("wy1", 0), ("wx2", 32), ("wy2", 32))})
    return g.enclosed_here(whole, ["page"]).select("page", "x", "y")


def _outlines(s, d):
    return g.painted_largest_outlines(paint(s, d), WIDTH, HEIGHT)


#: Boxes with broken edges on pages three times the size of their mask.
MASKED = [f"{PAGE} as page", "page_id * 100 + box_id as label", "x1 % 60 + cast(0.25 as double) as x1", "y1 % 60 + cast(0.75 as double) as y1", "x1 % 60 + cast(8 + score % 20 as double) as x2", "y1 % 60 + cast(7 + score % 13 as double) as y2"]


def _box_outlines(s, d):
    """Boxes of a page three times the size of its mask; the mask's pixels in each box, stretched to it, and their outline."""
    b = boxes(s, d).selectExpr(*MASKED)
    return g.box_outlines(pixels(s, d).where("v > 90"), b, 32, 32, 1 / 3)


QUERIES = {
    "raster_paint_labels": labels,
    "raster_edge_distance": lambda s, d: g.distances(paint(s, d), ["page"]),
    "raster_safe_boxes": lambda s, d: g.painted_safe_boxes(paint(s, d)),
    "raster_layout_boxes": _layout,
    "raster_region_fill": _regions,
    "raster_enclosed": _holes,
    "raster_outline": _outlines,
    "raster_box_outline": _box_outlines,
}

_LABELS = f"""{BOXES_SQL}, bb as (select {', '.join(BUBBLES)} from boxes), lb as (select *, row_number() over (partition by page_id order by (x2 - x1) * (y2 - y1) desc, box_id) as k from bb qualify k <= 255),
lab as (select page_id as page, cast(x as int) as x, cast(y as int) as y, cast(max(k) as int) as label from lb, unnest(range(x1, least(x2, {WIDTH}))) a(x), unnest(range(y1, least(y2, {HEIGHT}))) b(y) group by all)"""
_DISTANCE = f"""{_LABELS}, d1 as (select *, x - row_number() over (partition by page, label, y order by x) as p, y - row_number() over (partition by page, label, x order by y) as q from lab),
d2 as (select *, least(x - min(x) over u, max(x) over u - x) + 1 as g, least(y - min(y) over v, max(y) over v - y) + 1 as h from d1 window u as (partition by page, label, y, p), v as (partition by page, label, x, q)),
di as (select a.page, a.label, a.x, a.y, cast(least(255, ceil(sqrt(least(any_value(a.h) * any_value(a.h), min(b.g * b.g + (b.y - a.y) * (b.y - a.y)))))) as int) as dist from d2 a join d2 b on a.page = b.page and a.label = b.label and a.x = b.x and a.q = b.q group by all)"""
_SAFE = f"""{_DISTANCE}, e1 as (select page, label, min(x) as lx, min(y) as ly, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h, max(dist) as most from di group by all),
e2 as (select e1.*, mode, least(255, greatest(1, (2 * least(w, h) * share + 100) // 200)) as asked from e1, (values ('horizontal', 12), ('vertical', 20)) m(mode, share)),
e3 as (select *, list_filter([asked, greatest(1, least(255, 3 * asked) // 4), greatest(1, asked // 2), greatest(1, asked // 4), 1], lambda t: t <= most)[1] as threshold from e2),
sp as (select e3.*, x - lx as x, y - ly as y, dist from e3 join di using (page, label) where dist >= threshold),
ce as (select page, label, mode, any_value(lx) as lx, any_value(ly) as ly, any_value(most) as most, any_value(threshold) as threshold, (2 * sum(x) + count(*)) // (2 * count(*)) as cx, (2 * sum(y) + count(*)) // (2 * count(*)) as cy from sp group by all),
mp as (select page, label, arg_min(x, y * 4096 + x) as mx, min(y) as my from di join (select page, label, max(dist) as dist from di group by all) using (page, label, dist) group by all),
ca as (select ce.*, 10 * coalesce(dist, 0) < 7 * most as off, case when off then mx - lx else cx end as ax, case when off then my - ly else cy end as ay from ce join mp using (page, label) left join di on di.page = ce.page and di.label = ce.label and di.x = cx + lx and di.y = cy + ly),
an as (select sp.page, sp.label, sp.mode, arg_min({{'x': sp.x, 'y': sp.y}}, ((sp.x - ax) * (sp.x - ax) + (sp.y - ay) * (sp.y - ay)) * 16777216 + sp.y * 4096 + sp.x) as a from sp join ca using (page, label, mode) group by all),
hh as (select page, label, mode, x, y, x - row_number() over (partition by page, label, mode, y order by x) as run, row_number() over (partition by page, label, mode, x, col order by y) as h
  from (select *, y - row_number() over (partition by page, label, mode, x order by y) as col from sp)),
re as (select a.page, a.label, a.mode, a.x as l, b.x + 1 as r, a.y + 1 as z, min(b.h) over (partition by a.page, a.label, a.mode, a.y, a.x order by b.x) as h from hh a join hh b on a.page = b.page and a.label = b.label and a.mode = b.mode and a.y = b.y and a.run = b.run and b.x >= a.x),
sb as (select page, label, mode, cast(l + lx as int) as x, cast(z - re.h + ly as int) as y, cast(r - l as int) as w, cast(re.h as int) as h, cast(threshold as int) as threshold from re join an using (page, label, mode) join ca using (page, label, mode)
  qualify row_number() over (partition by page, label, mode order by (r - l) * re.h desc, pow(l + r - 2 * a.x - 1, 2) + pow(2 * z - re.h - 2 * a.y - 1, 2), z, r, re.h desc) = 1)"""
_PLACES = "lab as (select page, cast(x as int) as x, cast(y as int) as y, cast(floor(x / 8) + 3 * floor(y / 16) as int) as label from (select distinct page from px), unnest(range(24)) a(x), unnest(range(32)) b(y))"
_SHUT = """select page, {area}x, y from {zero} where (page, {area}x, y) not in (select (page, {area}x, y) from {open})"""
#: Walks along the edges around each area of lab, from the left side of its first pixel; then the polygons of the pixels it leaves.
_WALK = """k(side, ax, ay, sx, sy) as (values (0, -1, 1, 0, 1), (1, 1, 1, 1, 0), (2, 1, -1, 0, -1), (3, -1, -1, -1, 0)),
st as (select * from lab a where not exists (select 1 from lab b where b.page = a.page and b.label = a.label and (b.y = a.y - 1 and b.x between a.x - 1 and a.x + 1 or b.y = a.y and b.x = a.x - 1))),
w as (select page, label, x as hx, y as hy, x, y, 0 as side, 0 as i from st
  union all select page, label, hx, hy, nx, ny, ns, i + 1 from (select w.page, w.label, hx, hy, i, case when a.x is not null then w.x + ax when s.x is not null then w.x + sx else w.x end as nx,
      case when a.x is not null then w.y + ay when s.x is not null then w.y + sy else w.y end as ny, case when a.x is not null then (w.side + 3) % 4 when s.x is not null then w.side else (w.side + 1) % 4 end as ns
    from w join k using (side) left join lab a on a.page = w.page and a.label = w.label and a.x = w.x + ax and a.y = w.y + ay left join lab s on s.page = w.page and s.label = w.label and s.x = w.x + sx and s.y = w.y + sy)
  where not (nx = hx and ny = hy and ns = 0)),
mv as (select page, label, hx, hy, x, y, i, coalesce(lead(x) over u, hx) as nx, coalesce(lead(y) over u, hy) as ny, min(y * 1048576 + x) over (partition by page, label, hx, hy) as low from w window u as (partition by page, label, hx, hy order by i)),
po as (select *, row_number() over (partition by page, label, hx, hy order by i) - 1 as k from mv where low = hy * 1048576 + hx and (x <> nx or y <> ny)),
sz as (select page, label, hx, hy, abs(sum(x * ny - nx * y)) as area, count(*) as n from po group by all), be as (select * from sz where area > 0 qualify row_number() over (partition by page, label order by area desc, hy, hx) = 1)
select po.page, po.label, cast(k as int) as i, po.x, po.y from po join be using (page, label, hx, hy) where n >= 4"""
ORACLES = {
    "raster_outline": f"with recursive {_LABELS}, {_WALK}",
    "raster_box_outline": f"""with recursive {PIXELS_SQL}, b as (select {', '.join(MASKED)} from boxes),
c as (select *, least(greatest(round(x1 * cast(1 / 3.0 as double)), 0), 32)::int as mx1, least(greatest(round(y1 * cast(1 / 3.0 as double)), 0), 32)::int as my1, least(greatest(round(x2 * cast(1 / 3.0 as double)), 0), 32)::int as mx2, least(greatest(round(y2 * cast(1 / 3.0 as double)), 0), 32)::int as my2, greatest(round(x2) - round(x1), 1)::int as w, greatest(round(y2) - round(y1), 1)::int as h from b),
lab as (select c.page, label, cast(sx as int) as x, cast(sy as int) as y from c, unnest(range(w)) e(sx), unnest(range(h)) f(sy), px where mx2 > mx1 and my2 > my1 and px.page = c.page and px.v > 90 and px.x = mx1 + floor((sx + 0.5::double) * (mx2 - mx1) / w) and px.y = my1 + floor((sy + 0.5::double) * (my2 - my1) / h)), {_WALK}""",
    "raster_paint_labels": f"with {_LABELS} select * from lab",
    "raster_edge_distance": f"with {_DISTANCE} select * from di",
    "raster_safe_boxes": f"with {_SAFE} select * from sb",
    "raster_layout_boxes": f"""with {_SAFE}, se as (select {', '.join(SEEDS)} from boxes), sc as (select page, seed, mode, greatest(x1, 0) as x1, greatest(y1, 0) as y1, least(x2, {WIDTH}) as x2, least(y2, {HEIGHT}) as y2 from se),
sv as (select page, seed, mode, label, count(*) as n from sc join lab using (page) where lab.x >= x1 and lab.x < x2 and lab.y >= y1 and lab.y < y2 group by all), sw as (select * from sv qualify row_number() over (partition by page, seed order by n desc, label desc) = 1)
select page, seed, label, x, y, w, h from sw join sb using (page, label, mode)""",
    "raster_enclosed": f"""with recursive {PIXELS_SQL}, gr as (select distinct page, cast(x + dx as int) as x, cast(y + dy as int) as y from px, (values (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) v(dx, dy) where v > 60 and x + dx between 0 and 31 and y + dy between 0 and 31),
ze as (select page, cast(x as int) as x, cast(y as int) as y from (select distinct page from gr), unnest(range(32)) a(x), unnest(range(32)) b(y) where (page, cast(x as int), cast(y as int)) not in (select (page, x, y) from gr)),
op as (select page, x, y from ze where x in (0, 31) or y in (0, 31) union select ze.page, ze.x, ze.y from op join ze on ze.page = op.page and abs(ze.x - op.x) <= 1 and abs(ze.y - op.y) <= 1)
{_SHUT.format(area="", zero="ze", open="op")}""",
    "raster_region_fill": f"""with recursive {PIXELS_SQL}, base as (select page, x, y from px where v > 235), {_PLACES}, bl as (select {', '.join(BLOCKS)} from boxes where score >= 990),
o as (select a.page, area, greatest(x1 - r, 0) as wx1, greatest(y1 - r, 0) as wy1, least(x2 + r, 32) as wx2, least(y2 + r, 32) as wy2, p.x, p.y from bl a join base p on a.page = p.page and p.x >= x1 - r and p.x < x2 + r and p.y >= y1 - r and p.y < y2 + r),
v as (select page, area, label from (select page, area, label, count(*) as n from o join lab using (page, x, y) where label > 0 group by all) qualify row_number() over (partition by page, area order by n desc, label desc) = 1),
cp as (select w.page, v.label as bound, cast(x as int) as x, cast(y as int) as y from (select distinct page, area, wx1, wy1, wx2, wy2 from o) w left join v using (page, area), unnest(range(wx1, wx2)) a(x), unnest(range(wy1, wy2)) b(y)),
cov as (select distinct cp.page, cp.x, cp.y from cp left join lab on lab.page = cp.page and lab.x = cp.x and lab.y = cp.y where bound is null or coalesce(label, 0) = bound),
rest as (select * from base where (page, x, y) not in (select (page, x, y) from cov)),
e as (select a.page, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from rest a join rest b on a.page = b.page and abs(a.x - b.x) <= 1 and abs(a.y - b.y) <= 1),
q as (select page, x as sx, y as sy, x, y from rest union select q.page, sx, sy, bx, by_ from q join e on e.page = q.page and e.ax = q.x and e.ay = q.y),
cc as (select page, sx, sy, min(y * 1048576 + x) as area from q group by all),
cb as (select page, area, min(sx) as x1, min(sy) as y1, max(sx) + 1 as x2, max(sy) + 1 as y2, greatest(1, least(3, cast(round(least(max(sx) - min(sx) + 1, max(sy) - min(sy) + 1) * cast(0.45 as double)) as int))) as r from cc group by page, area),
ar as (select page, area, greatest(x1 - r, 0) as x1, greatest(y1 - r, 0) as y1, least(x2 + r, 32) as x2, least(y2 + r, 32) as y2, r from cb),
wi as (select *, greatest(x1 - r, 0) as wx1, greatest(y1 - r, 0) as wy1, least(x2 + r, 32) as wx2, least(y2 + r, 32) as wy2 from ar),
n as (select wi.*, p.x, p.y from wi join rest p on p.page = wi.page and p.x >= wx1 and p.x < wx2 and p.y >= wy1 and p.y < wy2),
nv as (select page, area, label from (select page, area, label, count(*) as k from n join lab using (page, x, y) where label > 0 and n.x >= x1 and n.x < x2 and n.y >= y1 and n.y < y2 group by all) qualify row_number() over (partition by page, area order by k desc, label desc) = 1),
gr as (select distinct page, area, cast(x + dx as int) as x, cast(y + dy as int) as y from n, unnest(range(-3, 4)) a(dx), unnest(range(-3, 4)) b(dy) where abs(dx) <= r and abs(dy) <= r and x + dx >= wx1 and x + dx < wx2 and y + dy >= wy1 and y + dy < wy2),
ze as (select page, area, cast(x as int) as x, cast(y as int) as y, x in (wx1, wx2 - 1) or y in (wy1, wy2 - 1) as rim from wi, unnest(range(wx1, wx2)) a(x), unnest(range(wy1, wy2)) b(y) where (page, area, cast(x as int), cast(y as int)) not in (select (page, area, x, y) from gr)),
op as (select page, area, x, y from ze where rim union select ze.page, ze.area, ze.x, ze.y from op join ze on ze.page = op.page and ze.area = op.area and abs(ze.x - op.x) <= 1 and abs(ze.y - op.y) <= 1),
fi as (select * from gr union all {_SHUT.format(area="area, ", zero="ze", open="op")}),
ke as (select fi.page, fi.x, fi.y, nv.label as bound from fi join ar using (page, area) left join nv using (page, area) where fi.x >= x1 and fi.x < x2 and fi.y >= y1 and fi.y < y2)
select page, x, y from base union select page, x, y from cov union select ke.page, ke.x, ke.y from ke left join lab on lab.page = ke.page and lab.x = ke.x and lab.y = ke.y where bound is null or coalesce(label, 0) = bound""",
}

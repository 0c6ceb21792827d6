"""Registered queries on hard strings and on rules for colours, sizes and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumage.functions import text as t
from plumage.operators import aggregate as a
from plumage.operators import nodes as n
from plumage.plans import registry
from plumage.plans.log_queries import EVENTS, events
from plumage.sources import store
from plumage.sources.fixtures import BOXES_SQL, boxes, table
from plumage.streaming import jobs as j

#: Strings that hold what the text rules turn on; a document has the one of its number's rest.
HARD = [
    "", " \t\n", "　", "\xa0 ", "plain", "　「はい」\xa0…\n・・・ok!", ' "quoted "　', "'", "''", "\"unlike'",
    "a<think>x</think>　\n rest", "</think>a<think>b", "<think>never ends", "x<think>1</think>y<think>2</think>", "a b\xa0c__d-- E FK", "--Ünï Çode 9--",
    "ㄅㄆ Bopomofo", "한국어", "ｶﾀｶﾅ漢字、ok", "ߒߞߏ then עברית", "𞤀𞤣 and العربية", "ܣܘܪܝܝܐ", "ދިވެހި", "ไทย ລາວ", "ខ្មែរ မြန်မာ", "mixed العربية 漢 ไทย！",
]
VARIANTS = ["Comic Neue:700i", "Anton", "F:i700", "F:", "F:i", "A:B:1i2", "Noto Sans:70000", ":5", "F:٣", "X:000400 italic", "Y:99999999999"]
EFFECTS = ["", "none", "Normal", " italic ", "Bold|italic", "bold+bold,none", "bold　italic", "glow", "italic;bold", "normal bold", "|,+"]
NUMBERS = ["p2", "p10", "p002", "p" + "1" * 24, "p" + "1" * 25, "p" + "0" * 30 + "7", "p" + "9" * 20, "p1" + "0" * 20, "x", "2", "p2a10", "p2a9"]
DOWNLOAD = ["started", "downloading", "completed", "failed"]
NAMES = ["zh", "zh-Hans", "Simplified Chinese", " tl　", "fil-PH", "EN", "en", "English", "yue", "bo", "Klingon", "", "pt-BR", "Brazilian Portuguese", "zh-TW", "zh-Hant"]


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def listed(xs: list[str]) -> str:
    return "[" + ", ".join(map(quoted, xs)) + f"][cast(doc_id % {len(xs)} as int) + 1]"


def hard(s, d, xs: list[str]):
    return table(s, d, "documents").select("doc_id", F.get(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs)).cast("int")).alias("t"))


def _white_space(s, d):
    c = F.col("t")
    return hard(s, d, HARD).select(
        "doc_id", t.nonblank(c).alias("nonblank"), t.trimmed(c).alias("trimmed"), t.without_quotes(c).alias("unquoted"), t.without_thinking(c).alias("said"), t.clean_ocr(c).alias("ocr"), t.slug(c).alias("slug")
    )


def _scripts(s, d):
    c = F.col("t")
    flags = t.script_flags(c)
    return hard(s, d, HARD).select("doc_id", flags["cjk"].alias("cjk"), c.rlike(t.CJK_LAYOUT).alias("layout"), t.rtl_script(c).alias("rtl"), flags["dictionary"].alias("dictionary"), c.rlike(t.FULLWIDTH_PUNCTUATION).alias("fullwidth"))


def _variants(s, d):
    family, weight, italic = t.font_variant(F.col("t"))
    return hard(s, d, VARIANTS).select("doc_id", family.alias("family"), weight.alias("weight"), italic.alias("italic"))


def _effects(s, d):
    names, ok = t.effects(F.col("t"), ["italic", "bold"])
    return hard(s, d, EFFECTS).select("doc_id", F.array_join(names, ",").alias("names"), ok.alias("valid"))


def _natural(s, d):
    return a.global_position(hard(s, d, NUMBERS).withColumn("key", t.natural_key(F.col("t"))), "key", "doc_id").select("doc_id", "position")


def _languages(s, d):
    return t.parsed_languages(hard(s, d, NAMES), "t").select("doc_id", "name", "tag", "code")


def _renderable(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), F.when(F.col("turn") % 4 == 1, "　\n").when(F.col("turn") % 4 != 2, F.concat(F.lit("　"), "text", F.lit("\n"))).alias("translation"))
    return n.renderable(c).select("page", "ord", F.sha2("translation", 256).alias("translation"))


def _selected(s, d):
    c = table(s, d, "conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("ord"), (F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return n.selected(c, c.where("(page + ord) % 3 <> 1")).select("page", "ord", "position")


def _running(s, d):
    return j.job_state(events(s, d)).where("status = 'running'").select("job_id", "last_seq")


def _overlapping(s, d):
    b = boxes(s, d)
    return a.overlapping_labels(b.selectExpr("page_id as page", "x1 % 40 as x", "y1 % 40 as y", "score % 3 as v"), b.selectExpr("page_id as page", "x2 % 40 as x", "y2 % 40 as y", "box_id % 4 as label"))


def _quads(s, d):
    c = F.col
    q = [(c("x1") - c("score") % 7, c("y1")), (c("x2"), c("y1") - c("score") % 5), (c("x2") + 3, c("y2")), (c("x1"), c("y2") + c("box_id"))]
    box, axes = n.quad_box(q), n.quad_axes(q)
    return boxes(s, d).select("page_id", "box_id", *[x.cast("int").alias(k) for k, x in zip(("left", "top", "right", "bottom"), box)], *[F.round(x, 4).alias(k) for k, x in zip(("down", "across"), axes)])


def _font(s, d):
    least, most = n.font_bounds(F.col("x2") * 3, F.col("y2"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return boxes(s, d).select("page_id", "box_id", F.round(least, 4).alias("least"), F.round(most, 4).alias("most"))


def _stroke(s, d):
    c = F.col
    style = lambda on, enabled, colour, width: F.when(on, F.struct(enabled.alias("enabled"), F.lit(colour).alias("colour"), width.cast("double").alias("width")))
    block = style(c("box_id") % 4 == 0, c("score") % 2 == 0, "block", F.when(c("score") % 3 == 0, c("score") % 9))
    whole = style(c("box_id") % 4 == 1, c("score") % 5 > 0, "whole", F.when(c("score") % 3 == 1, c("score") % 8))
    font = (c("score") / 8).cast("double")
    out = n.stroke(block, whole, (c("score") % 4).cast("double"), font, a.contrast(c("x1") % 256, c("y1") % 256, c("score") % 256))
    ink = n.text_colour(c("box_id") % 3 == 0, F.lit("own"), F.when(c("score") % 2 == 1, F.lit("predicted")), F.lit("black"))
    return boxes(s, d).select("page_id", "box_id", out["colour"].alias("colour"), F.round(out["width"], 4).alias("width"), ink.alias("ink"))


def _crops(s, d):
    c = F.col
    b = {"x": c("x1") - 0.5, "y": c("y1") - 20.25, "w": c("x2") - c("x1") + 0.0, "h": c("y2") - c("y1") + 0.75}
    lines = c("box_id") % 2 == 0
    b |= {f"lines_{k}": F.when(lines, c(k) + by).cast("double") for k, by in (("x1", -9), ("y1", -30), ("x2", 5), ("y2", 4))}
    out = n.crop_bounds(F.lit(900), F.lit(1100), b, lines | (c("label") == "R"), F.when(c("score") % 3 == 0, c("score") / 10).cast("double"), c("y2") - c("y1") > c("x2") - c("x1"))
    x, y = n.centred(b, c("score") % 100, c("score") % 31)
    return boxes(s, d).select("page_id", "box_id", *[v.alias(k) for k, v in out.items()], x.cast("int").alias("at_x"), y.cast("int").alias("at_y"))


def _millis(s, d):
    return table(s, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))


#: Turns as nodes of a page: kinds and roles by number, texts and translations that are blank now and then.
NODE_COLUMNS = [
    "conv_id as page", "case when turn % 3 < 2 then 'text' when conv_id % 2 = 0 then 'image' else 'mask' end as kind",
    "case (conv_id + turn) % 6 when 0 then 'source' when 1 then 'inpainted' when 2 then 'segment' when 3 then 'bubble' when 4 then 'brush' else 'rendered' end as role",
    "case when (conv_id + turn) % 7 = 0 then '  ' else text end as text", "case when (conv_id + turn) % 5 > 0 then text end as translation", "(conv_id + turn) % 4 > 0 as predicted", "conv_id % 3 > 0 as sprite",
]


def _artifacts(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("page")).unionAll(table(s, d, "conversations").select("conv_id")).distinct()
    return registry.artifacts(pages, table(s, d, "conversations").selectExpr(*NODE_COLUMNS))


def _catalogue(s, d):
    return registry.catalogue(table(s, d, "nation").selectExpr("n_name as id", "n_regionkey as place", "n_nationkey % 2 = 0 as bootstrap", "n_nationkey % 3 > 0 as enabled"))


def _downloads(s, d):
    e = events(s, d).select(F.col("job_id").alias("id"), "seq", F.get(F.array(*map(F.lit, DOWNLOAD)), (F.col("seq") % 4).cast("int")).alias("status"))
    return n.latest_status(e, "id").where("status <> 'completed'")


def _roles_to_blobs(s, d):
    """Each page's first node of a role with its content: the role's reference joined to the store, null where it isn't kept."""
    c = table(s, d, "conversations").select(F.col("conv_id").alias("page"), "role", "turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), "text")
    first = c.groupBy("page", "role").agg(F.min_by("hash", "turn").alias("hash"))
    kept = store.put(None, c.where("turn % 2 = 0").select("hash", F.coalesce("text", F.lit("")).alias("content")))
    return store.get(kept, first).select("page", "role", F.length("content").alias("n"))


QUERIES = {
    "artifacts_by_page": _artifacts,
    "package_catalogue": _catalogue,
    "download_state": _downloads,
    "role_blobs": _roles_to_blobs,
    "text_white_space": _white_space,
    "text_scripts": _scripts,
    "font_variant_hard": _variants,
    "effect_parse_hard": _effects,
    "natural_sort_long_numbers": _natural,
    "language_parse": _languages,
    "node_renderable": _renderable,
    "node_selected": _selected,
    "event_jobs_running": _running,
    "raster_overlapping_labels": _overlapping,
    "quad_geometry": _quads,
    "font_size_bounds": _font,
    "stroke_precedence": _stroke,
    "crop_bounds": _crops,
    "epoch_millis": _millis,
}

_W = quoted(t.WHITE)
_H = f"h as (select doc_id, {listed(HARD)} as t from documents)"
_HALF = "(select string_agg(chr(cast(i as int)), '' order by i) from range(33, 127) r(i))"
_FULL = "(select string_agg(chr(cast(i + 65248 as int)), '' order by i) from range(33, 127) r(i))"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RTL = "[" + "".join(f"\\p{{{x}}}" for x in t.RTL_SCRIPTS) + "]"
_KNOWN = ", ".join(f"({quoted(g)}, {quoted(name)}, {quoted(tag)}, {quoted(code)})" for name, tag, more, code in t.LANGUAGES for g in [name, tag, *more.split()])

_ARTIFACTS = [("TextBoxes", "bool_or(kind = 'text')", "false"), *[(k, f"bool_or(kind = '{a}' and role = '{b}')", "false") for k, (a, b) in registry.BY_ROLE.items()],
    ("OcrText", f"bool_and(trim(text, {_W}) <> '') filter (kind = 'text')", "true"), ("FontPredictions", "bool_and(predicted) filter (kind = 'text')", "true"),
    ("Translations", f"bool_and(trim(text, {_W}) = '' or coalesce(trim(translation, {_W}) <> '', false)) filter (kind = 'text')", "true"), ("RenderedSprites", "bool_and(sprite) filter (kind = 'text')", "true")]
ORACLES = {
    "artifacts_by_page": f"with n as (select {', '.join(NODE_COLUMNS)} from conversations), p as (select page_id as page from pages union select conv_id from conversations), " + ", ".join(f"a{k} as (select page, {x} as ready from n group by 1)" for k, (_, x, _) in enumerate(_ARTIFACTS)) + " " + " union all ".join(f"select page, '{name}' as artifact, coalesce(ready, {default}) as ready from p left join a{k} using (page)" for k, (name, _, default) in enumerate(_ARTIFACTS)),
    "package_catalogue": "select n_name as id, cast(row_number() over (order by n_regionkey, n_name) as int) as position, n_nationkey % 2 = 0 and n_nationkey % 3 > 0 as prepared from nation",
    "download_state": f"with {EVENTS} select job_id as id, ({DOWNLOAD})[max(seq) % 4 + 1] as status from e group by 1 having max(seq) % 4 <> 2",
    "role_blobs": "with f as (select conv_id as page, role, coalesce(text, '') as t from conversations qualify row_number() over (partition by conv_id, role order by turn) = 1) select page, role, case when t in (select coalesce(text, '') from conversations where turn % 2 = 0) then cast(length(t) as int) end as n from f",
    "text_white_space": f"""with {_H}, k as (select *, trim(t, {_W}) as m, strpos(t, '<think>') as p from h), r as (select *, case when p > 0 then substr(t, p) end as rest from k)
select doc_id, m <> '' as nonblank, m as trimmed, case when length(m) >= 2 and left(m, 1) = right(m, 1) and left(m, 1) in ('"', '''') then substr(m, 2, length(m) - 2) else m end as unquoted,
case when strpos(rest, '</think>') > 0 then ltrim(substr(rest, strpos(rest, '</think>') + 8), {_W}) else t end as said,
translate(replace(translate(t, {_W}, ''), '…', '...'), '・' || {_HALF}, '．' || {_FULL}) as ocr,
trim(regexp_replace(regexp_replace(translate(t, {_W} || '_' || '{_UPPER}', repeat('-', {len(t.WHITE) + 1}) || '{_UPPER.lower()}'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '-') as slug from r""",
    "text_scripts": f"""with {_H}, k as (select *, regexp_extract(t, '{_RTL}') as x from h) select doc_id, regexp_matches(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}\\p{{Bopomofo}}]') as cjk, regexp_matches(t, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Bopomofo}}]') as layout,
case {" ".join(f"when regexp_matches(x, '\\p{{{y}}}') then '{y}'" for y in t.RTL_SCRIPTS)} end as rtl, regexp_matches(t, '[\\p{{Thai}}\\p{{Lao}}\\p{{Khmer}}\\p{{Myanmar}}]') as dictionary,
regexp_matches(t, '[\\x{{3001}}\\x{{3002}}\\x{{3008}}-\\x{{3011}}\\x{{3014}}-\\x{{301f}}\\x{{3030}}\\x{{30fb}}\\x{{ff01}}-\\x{{ff0f}}\\x{{ff1a}}-\\x{{ff20}}\\x{{ff3b}}-\\x{{ff40}}\\x{{ff5b}}-\\x{{ff65}}]') as fullwidth from k""",
    "font_variant_hard": f"""with h as (select doc_id, {listed(VARIANTS)} as t from documents), k as (select *, strpos(t, ':') as p, case when strpos(t, ':') > 0 then substr(t, strpos(t, ':') + 1) else '' end as v from h), w as (select *, try_cast(regexp_replace(v, '[^0-9]', '', 'g') as int) as n from k)
select doc_id, case when p > 0 then left(t, p - 1) else t end as family, case when n <= 65535 then n else 400 end as weight, contains(v, 'i') as italic from w""",
    "effect_parse_hard": f"""with h as (select doc_id, {listed(EFFECTS)} as t from documents), k as (select doc_id, list_filter(regexp_split_to_array(translate(lower(t), {_W}, repeat(' ', {len(t.WHITE)})), '[,|+ ]+'), lambda x: x not in ('', 'none', 'normal')) as xs from h)
select doc_id, case when xs = ['bold', 'bold'] then 'bold' else array_to_string(xs, ',') end as names, len(list_filter(xs, lambda x: x not in ('italic', 'bold'))) = 0 as valid from k""",
    "natural_sort_long_numbers": f"""with h as (select doc_id, {listed(NUMBERS)} as t from documents), k as (select doc_id, list_transform(regexp_extract_all(t, '(\\d+|\\D+)'), lambda p: case when regexp_matches(p, '^\\d') then 'n' || lpad(cast(length(ltrim(p, '0')) as varchar), 4, '0') || ltrim(p, '0') else p end) as parts from h)
select doc_id, row_number() over (order by case when parts[1] like 'n%' then 0 else 1 end, encode(array_to_string(list_transform(parts, lambda x: x), '')), doc_id) as position from k""",
    "language_parse": f"with h as (select doc_id, {listed(NAMES)} as t from documents) select doc_id, name, tag, code from h left join (values {_KNOWN}) k(given, name, tag, code) on trim(t, {_W}) = given",
    "node_renderable": f"select conv_id as page, turn as ord, sha256(trim(text, {_W})) as translation from conversations where turn % 4 not in (1, 2) and trim(text, {_W}) <> ''",
    "node_selected": "select conv_id as page, turn as ord, cast(row_number() over (partition by conv_id order by turn) - 1 as int) as position from conversations where (conv_id + turn) % 3 <> 1",
    "event_jobs_running": f"with {EVENTS} select job_id, max(seq) as last_seq from (select *, max(seq) filter (tag = 'started') over (partition by job_id) as start from e) where start is null or seq >= start group by 1 having count(*) filter (tag = 'finished') = 0",
    "raster_overlapping_labels": f"with {BOXES_SQL}, m as (select distinct page_id as page, x1 % 40 as x, y1 % 40 as y from boxes where score % 3 > 0), l as (select page_id as page, x2 % 40 as x, y2 % 40 as y, box_id % 4 as label from boxes where box_id % 4 > 0) select page, string_agg(distinct cast(label as varchar), ',' order by cast(label as varchar)) as labels from m join l using (page, x, y) group by 1",
    "quad_geometry": f"""with {BOXES_SQL}, q as (select *, x1 - score % 7 as ax, y1 as ay, x2 as bx, y1 - score % 5 as b_y, x2 + 3 as cx, y2 as cy, x1 as dx, y2 + box_id as dy from boxes)
select page_id, box_id, cast(least(ax, bx, cx, dx) as int) as "left", cast(least(ay, b_y, cy, dy) as int) as top, cast(greatest(ax, bx, cx, dx) as int) as "right", cast(greatest(ay, b_y, cy, dy) as int) as bottom,
round(sqrt(pow((cx + dx) / 2 - (ax + bx) / 2, 2) + pow((cy + dy) / 2 - (ay + b_y) / 2, 2)), 4) as down, round(sqrt(pow((bx + cx) / 2 - (dx + ax) / 2, 2) + pow((b_y + cy) / 2 - (dy + ay) / 2, 2)), 4) as across from q""",
    "font_size_bounds": f"with {BOXES_SQL}, k as (select *, greatest(least(greatest(x2 * 3, y2) / cast(90 as double), 28), 12) as l from boxes) select page_id, box_id, round(l, 4) as least, round(greatest(least(least((y2 - y1) * cast(0.45 as double), (x2 - x1) * cast(0.9 as double)), 72), l + 1), 4) as most from k",
    "stroke_precedence": f"""with {BOXES_SQL}, k as (select *, greatest(least(score / 8 * cast(0.1 as double), 8), cast(1.2 as double)) as w from boxes) select page_id, box_id,
case box_id % 4 when 0 then case when score % 2 = 0 then 'block' end when 1 then case when score % 5 > 0 then 'whole' end else case when 0.299 * (x1 % 256) + 0.587 * (y1 % 256) + 0.114 * (score % 256) > 128 then 'black' else 'white' end end as colour,
round(case box_id % 4 when 0 then case when score % 2 = 0 then case when score % 3 = 0 then score % 9 else w end end when 1 then case when score % 5 > 0 then case when score % 3 = 1 then score % 8 else w end end else case when score % 4 > 0 then score % 4 else w end end, 4) as width,
case when box_id % 3 = 0 then 'own' when score % 2 = 1 then 'predicted' else 'black' end as ink from k""",
    "crop_bounds": f"""with {BOXES_SQL}, a as (select *, x1 - cast(0.5 as double) as x, y1 - cast(20.25 as double) as y, cast(x2 - x1 as double) as w, y2 - y1 + cast(0.75 as double) as h, box_id % 2 = 0 as l, y2 - y1 > x2 - x1 as v from boxes),
f as (select *, l or label = 'R' as e, case when score % 3 = 0 then score / 10 else greatest(least(w, h), 1) end as s from a), p as (select *, greatest(s * cast(0.08 as double), 2) as m from f),
q as (select *, greatest(s * case when v then cast(0.18 as double) else cast(0.12 as double) end, m) as px, greatest(s * case when v then cast(0.12 as double) else cast(0.18 as double) end, m) as py from p),
r as (select *, cast(case when e then greatest(least(floor(case when l then least(x, x1 - 9) else x end - px), 899), 0) else floor(greatest(x, 0)) end as int) as a1, cast(case when e then greatest(least(floor(case when l then least(y, y1 - 30) else y end - py), 1099), 0) else floor(greatest(y, 0)) end as int) as b1 from q)
select page_id, box_id, a1 as x1, b1 as y1, cast(greatest(least(case when e then ceil(case when l then greatest(x + w, x2 + 5) else x + w end + px) else ceil(x + w) end, 900), a1 + 1) as int) as x2,
cast(greatest(least(case when e then ceil(case when l then greatest(y + h, y2 + 4) else y + h end + py) else ceil(y + h) end, 1100), b1 + 1) as int) as y2,
cast(round(x + w * cast(0.5 as double) - (score % 100) * cast(0.5 as double)) as int) as at_x, cast(round(y + h * cast(0.5 as double) - (score % 31) * cast(0.5 as double)) as int) as at_y from r""",
    "epoch_millis": "select event_id, epoch_us(ts) // 1000 as ms from events",
}

"""Registered queries on text operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.functions import text as t
from plumage.operators.aggregate import global_position
from plumage.sources.fixtures import table

#: The languages that the library knows, as SQL values.
LANG_VALUES = ", ".join(f"('{g}', '{n}', '{c}')" for n, tag, more, c in t.LANGUAGES for g in [n, tag, *more.split()])


def docs(s, d):
    return table(s, d, "documents")


def talk(s, d):
    return table(s, d, "conversations")


def _block_text(s, d):
    c = talk(s, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))).alias("ts"))
    return c.select("conv_id", t.tagged(F.transform("ts", lambda x: x["text"])).alias("block_text"), F.size("ts").cast("long").alias("blocks"))


def _targets(s, d):
    allowed = table(s, d, "labels").where("quality = 1").select("doc_id")
    return docs(s, d).where(t.nonblank(F.col("text"))).join(allowed, "doc_id", "left_semi").select("doc_id", "lang")


def _tag_parse(s, d):
    b = _block_text(s, d)
    return b.select("conv_id", t.tag_parser(8)("block_text").alias("blocks"))


def _slug_collision(s, d):
    p = table(s, d, "part").select("p_partkey", F.coalesce(F.nullif(t.slug(F.regexp_extract("p_name", "^[^ ]+ ", 0)), F.lit("")), F.lit("untitled")).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("p_partkey")) - 1
    return p.select("p_partkey", F.when(n == 0, F.col("base")).otherwise(F.concat("base", F.lit("-"), n.cast("string"))).alias("name"))


def _languages(s, d):
    known = t.parsed_languages(docs(s, d).select("lang"), "lang")
    return known.groupBy("lang", F.coalesce("name", F.lit("unknown")).alias("name"), F.coalesce("code", F.lit("")).alias("vendor")).agg(F.count("*").alias("n"))


def _natural(s, d):
    return global_position(table(s, d, "pages").select("page_id", t.natural_key(F.col("url")).alias("key")), "key", "page_id")


def _writing(s, d):
    c = docs(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" 日本"))).otherwise(F.col("text")).alias("t"), F.when(F.col("doc_id") % 2 == 0, F.lit("vertical")).alias("dir"), "n_chars")
    return c.select("doc_id", t.writing_mode(F.col("t"), F.col("dir"), F.lit(500), F.col("n_chars")).alias("mode"), *[x.alias(n) for n, x in t.script_flags(F.col("t")).items()], F.col("t").rlike(t.FULLWIDTH_PUNCTUATION).alias("fullwidth"))


def _variants(s, d):
    p = table(s, d, "part").select("p_partkey", F.concat("p_brand", F.lit(":"), (F.col("p_size") * 100 % 900).cast("string"), F.when(F.col("p_partkey") % 2 == 0, "i").otherwise("")).alias("v"))
    family, weight, italic = t.font_variant(F.col("v"))
    return p.select("p_partkey", family.alias("family"), weight.alias("weight"), italic.alias("italic"), t.family_dir(family).alias("dir"))


def _variant_choice(s, d):
    p = table(s, d, "part").select("p_brand", "p_partkey", (F.col("p_size") % 9 * 100).alias("weight"), (F.col("p_partkey") % 2 == 0).alias("italic"))
    rank = F.when((F.col("weight") == 700) & F.col("italic"), 0).when((F.col("weight") == 400) & ~F.col("italic"), 1).otherwise(2)
    best = p.groupBy("p_brand").agg(F.min(F.struct(rank.alias("r"), "p_partkey", "weight", "italic")).alias("b"))
    return best.select("p_brand", "b.p_partkey", "b.weight", "b.italic")


KNOWN = ["bold", "italic", "shadow"]


def _effects(s, d):
    p = table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "Bold|italic").when(F.col("p_partkey") % 3 == 1, "shadow + bold, bold").otherwise("glow").alias("e"))
    names, ok = t.effects(F.col("e"), KNOWN)
    return p.select("p_partkey", F.array_join(names, ",").alias("names"), ok.alias("valid"))


def _prompt(s, d):
    custom = F.when(F.col("doc_id") % 4 == 0, F.lit("  ")).when(F.col("doc_id") % 4 == 1, F.lit("Keep names."))
    return docs(s, d).select("doc_id", F.when(t.nonblank(custom), F.concat(custom, F.lit("\nAnswer with the same numbered blocks."))).otherwise(F.lit("Translate each numbered block.")).alias("prompt"))


QUERIES = {
    "conversation_block_text": _block_text,
    "text_targets": _targets,
    "text_tag_parse": _tag_parse,
    "text_strip_thinking": lambda s, d: docs(s, d).select("doc_id", F.sha2(t.without_thinking(F.concat(F.lit("a<think>x</think>  "), "text")), 256).alias("h"), F.sha2(t.without_quotes(F.concat(F.lit(' "'), "text", F.lit('" '))), 256).alias("q")),
    "text_clean_ocr": lambda s, d: docs(s, d).select("doc_id", F.sha2(t.clean_ocr(F.col("text")), 256).alias("clean"), F.length(t.without_line_ends(F.col("text"))).alias("n")),
    "text_legacy_lines": lambda s, d: docs(s, d).select("doc_id", F.sha2(F.array_join(t.lines_padded(F.col("text"), 6), "|"), 256).alias("lines")),
    "slug_names": lambda s, d: table(s, d, "part").select("p_partkey", t.slug(F.concat(F.lit("-_ "), "p_name", F.lit(" (v2)  "))).alias("slug")),
    "slug_collision": _slug_collision,
    "language_lookup": _languages,
    "page_natural_sort": _natural,
    "text_writing_mode": _writing,
    "font_variant_parse": _variants,
    "font_variant_choice": _variant_choice,
    "effect_parse": _effects,
    "system_prompt": _prompt,
    "text_repetition_guard": lambda s, d: docs(s, d).select("doc_id", t.repetition_start("text").alias("start")),
    "text_emphasis_pairs": lambda s, d: docs(s, d).select("doc_id", F.sha2(t.emphasis_pairs(F.translate("text", ".,", "!?")), 256).alias("paired")),
    "text_line_breaks": lambda s, d: docs(s, d).select("doc_id", t.line_breaker(60.0)("text").alias("ends")),
    "text_visual_order": lambda s, d: table(s, d, "part").select("p_partkey", t.visual_orders(F.transform(F.split("p_name", ""), lambda c: F.ascii(c) % 4)).alias("order")),
    "text_utf16_chunks": lambda s, d: docs(s, d).select("doc_id", F.size(t.utf16_chunker(1000)("text")).alias("parts")),
}

ORACLES = {
    "conversation_block_text": "select conv_id, string_agg('[' || rn || ']' || txt, chr(10) order by rn) as block_text, count(*) as blocks from (select conv_id, coalesce(text, '') as txt, row_number() over (partition by conv_id order by turn) as rn from conversations) group by 1",
    "text_targets": "select doc_id, lang from documents where trim(text) <> '' and doc_id in (select doc_id from labels where quality = 1)",
    "text_strip_thinking": "select doc_id, sha256(regexp_replace(text, '^\\s+', '')) as h, sha256(text) as q from documents",
    "text_clean_ocr": "select doc_id, sha256(translate(replace(regexp_replace(text, '\\s+', '', 'g'), '…', '...'), '・' || (select string_agg(chr(cast(i as int)), '' order by i) from range(33, 127) r(i)), '．' || (select string_agg(chr(cast(i + 65248 as int)), '' order by i) from range(33, 127) r(i)))) as clean, cast(length(replace(replace(text, chr(10), ''), chr(13), '')) as int) as n from documents",
    "text_legacy_lines": "select doc_id, sha256(array_to_string(list_concat(case when text = '' then [] else string_split(regexp_replace(text, chr(10) || '$', ''), chr(10)) end, ['', '', '', '', '', ''])[1:6], '|')) as lines from documents",
    "slug_names": "select p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(p_name || ' v2'), '[^a-z0-9_\\-\\s]', '', 'g'), '[_\\-\\s]+', '-', 'g'), '^-|-$', '', 'g') as slug from part",
    "slug_collision": "select p_partkey, case when n = 0 then base else base || '-' || n end as name from (select *, row_number() over (partition by base order by p_partkey) - 1 as n from (select p_partkey, coalesce(nullif(trim(regexp_replace(regexp_replace(lower(regexp_extract(p_name, '^[^ ]+ ')), '[^a-z0-9_\\-\\s]', '', 'g'), '[_\\-\\s]+', '-', 'g'), '-'), ''), 'untitled') as base from part))",
    "language_lookup": f"select lang, coalesce(name, 'unknown') as name, coalesce(code, '') as vendor, count(*) as n from documents left join (values {LANG_VALUES}) v(given, name, code) on trim(lang) = given group by 1, 2, 3",
    "page_natural_sort": "select page_id, key, row_number() over (order by encode(key), page_id) as position from (select page_id, array_to_string(list_transform(regexp_extract_all(url, '(\\d+|\\D+)'), lambda p: case when regexp_matches(p, '^\\d') then lpad(coalesce(nullif(ltrim(p, '0'), ''), '0'), 20, '0') else p end), '') as key from pages)",
    "text_writing_mode": "select doc_id, case when doc_id % 3 <> 0 then 'horizontal' when doc_id % 2 = 0 then 'vertical' when n_chars > 500 then 'vertical' else 'horizontal' end as mode, doc_id % 3 = 0 as cjk, false as rtl, false as dictionary, false as fullwidth from documents",
    "font_variant_parse": "select p_partkey, p_brand as family, cast(p_size * 100 % 900 as int) as weight, p_partkey % 2 = 0 as italic, lower(replace(p_brand, ' ', '')) as dir from part",
    "font_variant_choice": "select p_brand, p_partkey, weight, italic from (select p_brand, p_partkey, p_size % 9 * 100 as weight, p_partkey % 2 = 0 as italic from part) qualify row_number() over (partition by p_brand order by case when weight = 700 and italic then 0 when weight = 400 and not italic then 1 else 2 end, p_partkey) = 1",
    "effect_parse": "select p_partkey, case p_partkey % 3 when 0 then 'bold,italic' when 1 then 'shadow,bold' else 'glow' end as names, p_partkey % 3 <> 2 as valid from part",
    "system_prompt": "select doc_id, case when doc_id % 4 = 1 then 'Keep names.' || chr(10) || 'Answer with the same numbered blocks.' else 'Translate each numbered block.' end as prompt from documents",
}

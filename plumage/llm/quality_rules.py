"""Quality rules: a threshold table compiled into one projection, in DataFrame expressions only.

Counts of a text are plain column expressions, the ratios are quotients of counts, and each row of RULES becomes one
comparison of that projection. There is no shuffle, no join and no user function; a document never leaves its task.

The share of function words tells prose from lists of words only in languages whose function words are known. STOP_WORDS has
eleven languages in Latin letters, so the rule holds for texts of which half the words or more are in Latin letters; texts in other
scripts are judged by the other rules alone. A corpus with other languages in Latin letters needs their words in the table,
or RULES without that row: such texts would go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import SEPARATORS, pick, table, whole_row, words

#: Frequent function words by language.
STOP_WORDS = {
    "en": "the of and to in that is was for on with as by at or an be this a",
    "de": "der die das und ist von den mit ein eine zu auf nicht im dem des sich",
    "fr": "le la les de des et est un une du pour que dans par au pas ce en",
    "es": "el la los las de y que un una del por con para es se no en",
    "it": "il lo la gli le di e che un una per con non si del della",
    "pt": "o a os as de e que um uma do da para com em se",
    "nl": "de het een en van in is dat op te niet met voor aan",
    "sv": "och att det som en ett den av för med till inte",
    "da": "og det at en den til er som på med af ikke",
    "pl": "i w na z się nie do jest że to o jak",
    "fi": "ja on ei se että oli hän mutta niin kun myös",
}

#: (rule, numerator, denominator or None, least, most, where it holds: None or numerator, denominator, least). A ratio without its denominator is 0.
RULES = [
    ("mean_word_chars", "word_chars", "n_words", 2.0, 16.0, None),
    ("symbols_per_word", "n_symbols", "n_words", None, 0.2, None),
    ("stop_words_per_word", "n_stop_words", "n_words", 0.02, None, ("n_latin_words", "n_words", 0.5)),
    ("letter_words_per_word", "n_letter_words", "n_words", 0.6, None, None),
    ("duplicate_lines_per_line", "n_dup_lines", "n_lines", None, 0.5, None),
    ("bullet_lines_per_line", "n_bullet_lines", "n_lines", None, 0.9, None),
    ("ellipsis_lines_per_line", "n_ellipsis_lines", "n_lines", None, 0.4, None),
]

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_letter_words", "n_latin_words", "n_bullet_lines", "n_ellipsis_lines"]


def _with_repeats(df: DataFrame) -> DataFrame:
    """Adds ``_n``, the words of ``_w`` inside 3-word windows that occur twice or more. ``_g``: the windows' (hash, start), sorted.

    Neighbours in that order are repeats if their hashes and their words agree. What an expression uses more than once is a
    column of a projection of its own, as Spark would compute it anew for each use inside a higher-order function.
    """

    def again(x: Column, j: Column) -> Column:
        """Whether the next window is the same as window j."""
        y = F.get(F.col("_g"), j + 1)
        agree = x["h"] == y["h"]
        for k in range(3):
            agree = agree & (F.get(F.col("_w"), x["i"] + k) == F.get(F.col("_w"), y["i"] + k))
        return agree

    df = df.withColumn("_f", F.filter(F.transform("_g", lambda x, j: F.when(again(x, j), j)), lambda j: j.isNotNull()))
    both = F.array_distinct(F.concat("_f", F.transform("_f", lambda j: j + 1)))
    df = df.withColumn("_s", F.sort_array(F.transform(both, lambda j: F.get(F.col("_g"), j)["i"]))).drop("_f", "_g")
    # A window adds three words less those that the next window has as well.
    steps = F.zip_with("_s", F.slice("_s", F.lit(2), F.greatest(F.size("_s"), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    return df.withColumn("_n", F.aggregate(steps, F.lit(0), lambda total, s: total + s)).drop("_s")


def stop_words() -> list[str]:
    return sorted({x for xs in STOP_WORDS.values() for x in xs.split()})


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` as column ``_doc`` beside the counts of COUNTS, all bigint."""
    text = F.coalesce(pick(docs, text_col).cast("string"), F.lit(""))
    df = docs.select(whole_row(docs).alias("_doc"), text.alias("_t"), words(text).alias("_w"))
    lines = F.filter(F.split(F.col("_t"), "\n"), lambda x: F.btrim(x, F.lit(SEPARATORS)) != "")
    grams = F.transform(
        F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.struct(F.xxhash64(F.get(F.col("_w"), i), F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2)).alias("h"), i.alias("i"))
    )
    df = df.select("_doc", "_t", "_w", lines.alias("_l"), F.when(F.size("_w") >= 3, F.sort_array(grams)).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")).alias("_g"))
    df = _with_repeats(df)
    stop = stop_words()
    count = lambda c: F.size(c).cast("long")
    return df.select(
        "_doc",
        count("_w").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_n").cast("long").alias("n_repeat_words"),
        count("_l").alias("n_lines"),
        count(F.filter("_w", lambda x: F.lower(x).isin(*stop))).alias("n_stop_words"),
        count(F.filter("_w", lambda x: x.rlike(r"\p{L}"))).alias("n_letter_words"),
        count(F.filter("_w", lambda x: x.rlike(r"[A-Za-z\u00c0-\u024f]"))).alias("n_latin_words"),
        count(F.filter("_l", lambda x: F.substr(F.btrim(x, F.lit(SEPARATORS)), F.lit(1), F.lit(1)).isin("-", "*", "•", "·"))).alias("n_bullet_lines"),
        count(F.filter("_l", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).alias("n_ellipsis_lines"),
    )


def verdict(rules=RULES) -> Column:
    """The threshold table as one boolean expression over the counts."""
    ratio = lambda top, bottom: F.col(top).cast("double") if bottom is None else F.coalesce(F.try_divide(F.col(top), F.col(bottom)), F.lit(0.0))
    ok = F.lit(True)
    for _, top, bottom, least, most, where in rules:
        held = F.lit(True)
        if least is not None:
            held = held & (ratio(top, bottom) >= least)
        if most is not None:
            held = held & (ratio(top, bottom) <= most)
        ok = ok & (held if where is None else held | (ratio(*where[:2]) < where[2]))
    return ok


def base_failed() -> Column:
    """Under 50 words, or over half of the words in repeated 3-word windows."""
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def quality_rules(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """A row for each row of ``docs``: ``_doc`` (its columns, so that no name can clash), COUNTS, base_failed, kept.

    Null, empty and wordless texts have counts of 0, fail the base rule and aren't kept. Repeated rows are judged each
    on its own; an empty table gives no rows.
    """
    df = with_counts(docs, text_col).withColumn("base_failed", base_failed())
    return df.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep_good(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns.

    The row number is no part of the result. It keeps the optimizer from moving the filter below the projection, where every
    count would be computed anew for each place that uses it.
    """
    judged = quality_rules(docs, text_col, rules).select("_doc", "kept", F.monotonically_increasing_id().alias("_row"))
    return judged.where(F.col("kept") & (F.col("_row") >= 0)).select("_doc.*")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    df = quality_rules(table(spark, sf_dir, "documents"))
    return df.select(F.col("_doc.doc_id").alias("doc_id"), *COUNTS, "base_failed", "kept")


def _oracle() -> str:
    stop = ", ".join(f"'{x}'" for x in stop_words())
    ratio = lambda top, bottom: f"coalesce({top} / nullif(cast({bottom} as double), 0), 0)"
    tests = []
    for _, top, bottom, least, most, where in RULES:
        bounds = ([f"{ratio(top, bottom)} >= {least}"] if least is not None else []) + ([f"{ratio(top, bottom)} <= {most}"] if most is not None else [])
        tests.append(f"({' and '.join(bounds)}" + (f" or {ratio(*where[:2])} < {where[2]})" if where else ")"))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as gram from w, unnest(range(1, len(w) - 1)) as r(i)),
h as (select doc_id, i from g qualify count(*) over (partition by doc_id, gram) > 1),
c as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from h) group by doc_id),
n as (select w.doc_id, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(c.n, 0) as bigint) as n_repeat_words,
    cast(len(l) as bigint) as n_lines,
    cast(len(list_filter(w, lambda x: lower(x) in ({stop}))) as bigint) as n_stop_words,
    cast(len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) as bigint) as n_letter_words,
    cast(len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z\\x{{c0}}-\\x{{24f}}]'))) as bigint) as n_latin_words,
    cast(len(list_filter(l, lambda x: regexp_extract(x, '[^\\x20\\x09-\\x0D]') in ('-', '*', '•', '·'))) as bigint) as n_bullet_lines,
    cast(len(list_filter(l, lambda x: rtrim(x, ' ') like '%...' or rtrim(x, ' ') like '%…')) as bigint) as n_ellipsis_lines
  from w left join c using (doc_id)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from n)
select {", ".join(["doc_id", *COUNTS])}, base_failed, not base_failed and {" and ".join(tests)} as kept from b
"""


ORACLE = _oracle()

"""Text operators as column expressions; the few that scan with state are pandas functions over batches."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# The characters with Unicode's White_Space property.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def trimmed(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(c, F.lit(WHITE))


def nonblank(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def tagged(texts: Column) -> Column:
    """[1]first, [2]second, ... joined by line feeds."""
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), x)), "\n")


def without_thinking(c: Column) -> Column:
    """What follows the first <think> block, left-trimmed; all of it if there is no whole block."""
    start = F.instr(c, "<think>")
    rest = F.substr(c, start)
    end = F.instr(rest, "</think>")
    return F.when((start > 0) & (end > 0), F.ltrim(F.substr(rest, end + 8), F.lit(WHITE))).otherwise(c)


def without_quotes(c: Column) -> Column:
    """Trimmed, less one pair of equal quotes around it."""
    t = trimmed(c)
    first, last = F.left(t, F.lit(1)), F.right(t, F.lit(1))
    return F.when((F.length(t) >= 2) & (first == last) & first.isin('"', "'"), F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def clean_ocr(c: Column) -> Column:
    """No white space, dots for an ellipsis and for middle dots, ASCII as full-width forms."""
    half = "".join(map(chr, range(0x21, 0x7F)))
    full = "".join(chr(x + 0xFEE0) for x in range(0x21, 0x7F))
    plain = F.translate(F.replace(F.translate(c, WHITE, ""), F.lit("…"), F.lit("...")), "・", ".")
    return F.translate(plain, half, full)


def without_line_ends(c: Column) -> Column:
    return F.translate(c, "\r\n", "")


def lines_padded(c: Column, n: int) -> Column:
    """The first n lines without carriage returns, filled up with empty ones. A line feed at the end begins no line."""
    parts = F.transform(F.split(F.regexp_replace(c, r"\n$", ""), "\n"), lambda x: F.regexp_replace(x, r"\r+$", ""))
    parts = F.when(F.coalesce(c, F.lit("")) == "", F.array().cast("array<string>")).otherwise(parts)
    return padded(parts, n)


def padded(items: Column, n: int) -> Column:
    return F.slice(F.concat(items, F.array_repeat(F.lit(""), n)), 1, n)


def slug(c: Column) -> Column:
    """ASCII letters (lower-cased) and digits; dashes, underscores and white space become single dashes; the rest goes."""
    upper = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
    plain = F.translate(c, WHITE + "_" + upper, "-" * (len(WHITE) + 1) + upper.lower())
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9-]", ""), "-+", "-"), F.lit("-"))


def natural_key(c: Column, width: int = 20) -> Column:
    """A sort key in which runs of digits count by value: digits are left-padded with zeros to ``width``.

    Longer runs come after all others (a colon sorts behind the digits), by their number of digits first.
    """

    def number(p: Column) -> Column:
        own = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.when(F.length(own) <= width, F.lpad(own, width, "0")).otherwise(F.concat(F.lit(":"), F.lpad(F.length(own).cast("string"), 10, "0"), own))

    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(p)), "")


def font_variant(c: Column) -> tuple[Column, Column, Column]:
    """family, weight, italic of ``Family:700i``: behind the first colon, all digits are the weight and any i means italic.

    The weight is 400 where there is none or it exceeds 16 bits.
    """
    at = F.instr(c, ":")
    spec = F.when(at > 0, F.substr(c, at + 1)).otherwise("")
    weight = F.regexp_replace(spec, "[^0-9]", "").try_cast("int")
    return F.when(at > 0, F.substr(c, F.lit(1), at - 1)).otherwise(c), F.when(weight <= 65_535, weight).otherwise(400), spec.contains("i")


def family_dir(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


# Unicode scripts and ranges that the layout rules name.
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsBopomofo}]"
CJK_LAYOUT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsBopomofo}]"
RTL_SCRIPTS = ("Arabic", "Hebrew", "Syriac", "Thaana", "Nko", "Adlam")
RTL = "[" + "".join(rf"\p{{Is{x}}}" for x in RTL_SCRIPTS) + "]"
DICTIONARY_BREAKS = r"[\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
FULLWIDTH_PUNCTUATION = "[、。〈-】〔-〟〰・！-／：-＠［-｀｛-･]"


def script_flags(c: Column) -> dict[str, Column]:
    return {"cjk": c.rlike(CJK), "rtl": c.rlike(RTL), "dictionary": c.rlike(DICTIONARY_BREAKS)}


def rtl_script(c: Column) -> Column:
    """The script of the first character that is written from right to left; null without one."""
    first = F.regexp_extract(c, f"({RTL})", 1)
    return F.coalesce(*[F.when(first.rlike(rf"\p{{Is{x}}}"), F.lit(x)) for x in RTL_SCRIPTS])


def writing_mode(c: Column, direction: Column, width: Column, height: Column) -> Column:
    """Horizontal unless the text is CJK (without Hangul); then as the direction says, or by the box's shape."""
    asian = nonblank(c) & c.rlike(CJK_LAYOUT)
    return F.when(~asian, F.lit("horizontal")).when(direction.isNotNull(), direction).when(height > width, F.lit("vertical")).otherwise("horizontal")


def effects(c: Column, known: list[str]) -> tuple[Column, Column]:
    """The effect names in a text separated by commas, bars, pluses or white space, and whether all are known.

    "none" and "normal" are allowed and name nothing, like an empty text.
    """
    names = F.filter(F.split(F.translate(F.lower(F.coalesce(c, F.lit(""))), WHITE, " " * len(WHITE)), r"[,|+ ]+"), lambda x: ~x.isin("", "none", "normal"))
    return F.array_distinct(names), F.forall(names, lambda x: x.isin(*known))


# Zero is no number of a tag; a plus sign is allowed.
_TAG = re.compile(r"[ \t]*\[\+?0*([1-9]\d*)\]")
_LINE_TAG = re.compile(r"\n[ \t]*\[\+?0*([1-9]\d*)\]")


# Languages with their tags, aliases and a translation service's code, which isn't always the language's own.
LANGUAGES = [
    ("Simplified Chinese", "zh-CN", "zh zh-Hans", "ZH-HANS"), ("English", "en-US", "en", "EN-US"), ("French", "fr-FR", "fr", "FR"),
    ("Portuguese", "pt-PT", "pt", "PT-PT"), ("Brazilian Portuguese", "pt-BR", "", "PT-BR"), ("Spanish", "es-ES", "es", "ES"),
    ("Japanese", "ja-JP", "ja", "JA"), ("Turkish", "tr-TR", "tr", "TR"), ("Russian", "ru-RU", "ru", "RU"), ("Arabic", "ar-SA", "ar", "AR"),
    ("Korean", "ko-KR", "ko", "KO"), ("Thai", "th-TH", "th", "TH"), ("Italian", "it-IT", "it", "IT"), ("German", "de-DE", "de", "DE"),
    ("Vietnamese", "vi-VN", "vi", "VI"), ("Malay", "ms-MY", "ms", "MS"), ("Indonesian", "id-ID", "id", "ID"), ("Filipino", "fil-PH", "fil tl", "EN-US"),
    ("Hindi", "hi-IN", "hi", "HI"), ("Traditional Chinese", "zh-TW", "zh-Hant", "ZH-HANT"), ("Polish", "pl-PL", "pl", "PL"), ("Czech", "cs-CZ", "cs", "CS"),
    ("Dutch", "nl-NL", "nl", "NL"), ("Khmer", "km-KH", "km", "EN-US"), ("Burmese", "my-MM", "my", "EN-US"), ("Persian", "fa-IR", "fa", "EN-US"),
    ("Gujarati", "gu-IN", "gu", "GU"), ("Urdu", "ur-PK", "ur", "UR"), ("Telugu", "te-IN", "te", "TE"), ("Marathi", "mr-IN", "mr", "MR"),
    ("Hebrew", "he-IL", "he", "HE"), ("Bengali", "bn-BD", "bn", "BN"), ("Bulgarian", "bg-BG", "bg", "BG"), ("Tamil", "ta-IN", "ta", "TA"),
    ("Ukrainian", "uk-UA", "uk", "UK"), ("Tibetan", "bo-CN", "bo", "ZH"), ("Kazakh", "kk-KZ", "kk", "KK"), ("Mongolian", "mn-MN", "mn", "EN-US"),
    ("Uyghur", "ug-CN", "ug", "ZH"), ("Cantonese", "yue-HK", "yue", "ZH"), ("Belarusian", "be-BY", "be", "BE"), ("Hungarian", "hu-HU", "hu", "HU"),
]


def languages(spark: SparkSession) -> DataFrame:
    """(given, name, tag, code): each language under its name, its tag and its aliases."""
    rows = [(given, name, tag, code) for name, tag, aliases, code in LANGUAGES for given in [name, tag, *aliases.split()]]
    return spark.createDataFrame(rows, "given string, name string, tag string, code string")


def parsed_languages(rows: DataFrame, given: str) -> DataFrame:
    """Adds name, tag and code of the language that the column names, white space around it aside; null where none is meant."""
    known = F.broadcast(languages(rows.sparkSession)).withColumnRenamed("given", "_given")  # a fixed list
    return rows.join(known, trimmed(F.col(given)) == F.col("_given"), "left").drop("_given")


def _next_tag(text: str, at: int):
    """The next tag, which stands at ``at`` (a start, or where a tag has ended) or at the start of a later line."""
    return _TAG.match(text, at) or _LINE_TAG.search(text, at)


def parse_tags(text: str | None, n: int) -> list[str] | None:
    """The trimmed blocks of a tagged text: n of them, the last block of a number wins; None if there is no tag."""
    text = text or ""
    found = _next_tag(text, 0)
    if not found:
        return None
    out = [""] * n
    while found:
        after = _next_tag(text, found.end())
        if int(found[1]) <= n:
            out[int(found[1]) - 1] = text[found.end() : after.start() if after else len(text)].strip()
        found = after
    return out


def tag_parser(n: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parse_tags(t, n))

    return parse


def repeated_suffix_start(text: str | None, unit: int = 12, times: int = 4, least: int = 12) -> int | None:
    """Where (in UTF-8 bytes) a suffix begins that repeats one unit of 1 to ``unit`` characters, white space aside.

    The smallest unit counts that gives ``times`` repeats and ``least`` characters.
    """
    places, chars, at = [], [], 0
    for c in text or "":
        if not c.isspace():
            places.append(at)
            chars.append(c)
        at += len(c.encode())
    for size in range(1, min(unit, len(chars) // times) + 1):
        start = len(chars) - size
        while start >= size and chars[start - size : start] == chars[-size:]:
            start -= size
        if len(chars) - start >= max(times * size, least):
            return places[start]
    return None


@F.pandas_udf(T.IntegerType())
def repetition_start(texts: pd.Series) -> pd.Series:
    return texts.map(repeated_suffix_start).astype("Int32")


# Marks of emphasis and their vertical pairs.
MARKS = {"!": "!", "！": "!", "?": "?", "？": "?"}
PAIRS = {"!!": "‼", "??": "⁇", "?!": "⁈", "!?": "⁉"}


def pair_emphasis(text: str) -> str:
    """Pairs of marks as one symbol, from left to right; unequal ones aren't paired if the second begins an equal pair."""

    def run(m: re.Match) -> str:
        kinds, out, i = [MARKS[c] for c in m[0]], "", 0
        while i < len(kinds):
            two = kinds[i : i + 2]
            if len(two) < 2 or (two[0] != two[1] and kinds[i + 2 : i + 3] == two[1:]):
                out, i = out + m[0][i], i + 1
            else:
                out, i = out + PAIRS["".join(two)], i + 2
        return out

    return re.sub("[" + "".join(MARKS) + "]+", run, text)


@F.pandas_udf(T.StringType())
def emphasis_pairs(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else pair_emphasis(t))


def line_breaks(widths: list[float], width: float, suffixes: list[float] | None = None, hyphen: float = 2000.0, overflow: float = 10_000.0) -> list[int]:
    """Ends of lines of least total badness (cube of the slack; overflow weighs ``overflow`` times) over segment widths.

    A break after a segment with a suffix adds the suffix's width and ``hyphen``. A segment that is too wide stands alone.
    """
    n = len(widths)
    if not n or not 0 < width < float("inf"):
        return [n] if n else []
    suffixes = suffixes or [0.0] * n
    best = [(0.0, 0)] + [(float("inf"), 0)] * n
    for a in range(n):
        total = 0.0
        for z in range(a + 1, n + 1):
            total += widths[z - 1]
            tail = suffixes[z - 1] if z < n else 0.0
            slack = width - total - tail
            if slack < 0 and z > a + 1:
                break
            cost = best[a][0] + (slack**3 if slack >= 0 else (-slack) ** 3 * overflow) + (hyphen if tail > 0 else 0)
            if cost < best[z][0]:
                best[z] = (cost, a)
    out, z = [], n
    while z:
        out.append(z)
        z = best[z][1]
    return out[::-1]


def line_breaks_many(texts: list[list[float]], width: float, overflow: float = 10_000.0, group: int = 64) -> list[list[int]]:
    """line_breaks without suffixes for many texts: texts of like length take each step together, over all starts that a line can have."""
    if not 0 < width < float("inf"):
        return [[len(w)] if w else [] for w in texts]
    out: list[list[int]] = [[] for _ in texts]
    order = sorted((k for k, w in enumerate(texts) if w), key=lambda k: len(texts[k]))
    for at in range(0, len(order), group):
        part = order[at : at + group]
        n = [len(texts[k]) for k in part]
        upto = np.zeros((len(part), max(n) + 1))  # width of the words before each place
        most = 1
        for i, k in enumerate(part):
            upto[i, 1:] = np.pad(np.cumsum(texts[k]), (0, max(n) - n[i]), "edge")
            own = upto[i, : n[i] + 1]
            most = max(most, int((np.arange(n[i] + 1) - np.searchsorted(own, own - width)).max()))
        best = np.full(upto.shape, np.inf)
        best[:, 0] = 0
        start, rows = np.zeros(upto.shape, np.int64), np.arange(len(part))
        for z in range(1, max(n) + 1):
            low = max(0, z - most)
            slack = width - (upto[:, z : z + 1] - upto[:, low:z])
            cost = np.where(slack >= 0, slack**3, np.inf)
            alone = slack[:, -1]  # a word too wide for a line has one all the same
            cost[:, -1] = np.where(alone >= 0, cost[:, -1], (-alone) ** 3 * overflow)
            cost += best[:, low:z]
            first = cost.argmin(1)
            best[:, z], start[:, z] = cost[rows, first], low + first
        for i, k in enumerate(part):
            z = n[i]
            while z:
                out[k].append(z)
                z = int(start[i, z])
            out[k].reverse()
    return out


def line_breaker(width: float):
    """Line ends for a text's words by code points, each word but the last with a space."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def breaks(texts: pd.Series) -> pd.Series:
        return pd.Series(line_breaks_many([[len(w) + 1.0 for w in (t or "").split()] for t in texts], width))

    return breaks


def visual_order(levels: list[int]) -> list[int]:
    """Positions in display order for embedding levels: from the highest level to the lowest odd one, runs are reversed."""
    order = list(range(len(levels)))
    for level in range(max(levels, default=0), min((x for x in levels if x % 2), default=1) - 1, -1):
        i = 0
        while i < len(levels):
            j = i
            while j < len(levels) and levels[j] >= level:
                j += 1
            order[i:j] = order[i:j][::-1]
            i = max(j, i + 1)
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def visual_orders(levels: pd.Series) -> pd.Series:
    return levels.map(lambda x: None if x is None else visual_order(list(x)))


def utf16_chunks(text: str, units: int) -> list[str]:
    """Cut so that no part has more than ``units`` UTF-16 units and no character is split (one alone may exceed it)."""
    out, size = [], units
    for c in text:
        own = 2 if ord(c) > 0xFFFF else 1
        if size + own > units:
            out.append("")
            size = 0
        out[-1] += c
        size += own
    return out


def utf16_chunker(units: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: utf16_chunks(t or "", units))

    return cut

import re
from collections import Counter

from plumage.llm.quality_rules import keep_good, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed


PROSE = " ".join(f"the word{chr(97 + i % 26)}{chr(97 + i // 26)}." + ("\n" if i % 9 == 0 else "") for i in range(80))
TEXTS = [None, "", " \n\t", "one", "a b c a b c a b", "x\x0by\x0cz x y z x y z\r\nx y z", "ä ö\n ä ö\nä ö\n\n#*$ |<", "a a a a a", PROSE, PROSE, "spam $$$ ### " * 40,
         "la la " * 9, "hot line\n" * 40, PROSE.replace(".", " ###"), "q" * 100_000, "the end of it " * 3]


def test_counts_and_verdicts(spark):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, kept string, n_words int")
    got = {r["_doc"].doc_id: r for r in quality_rules(df).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        assert not (r.kept and r.base_failed)
    assert got[8].kept and got[9].kept and not got[13].kept and not got[10].kept
    kept = keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {8, 9}
    assert keep_good(df.limit(0)).count() == 0


def test_scripts_without_function_words_and_names_with_dots(spark):
    letters = {"ru": "абвгдежзиклмнопрст", "ar": "ابتثجحخدذرزسشصض", "zh": "一二三四五六七八九十百千", "el": "αβγδεζηθικλμνξο"}
    rows = [(k, " ".join(x[i % len(x)] + x[(i * 7 + i // 9) % len(x)] + x[(i * 5 + 3) % len(x)] for i in range(120)), 1) for k, x in letters.items()]
    rows += [("latin", " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}qrx" for i in range(120)), 1), ("it", PROSE.replace("the", "della"), 1), ("long", PROSE + " " + " ".join(f"the w{i}" for i in range(60_000)), 1)]
    df = spark.createDataFrame(rows, "`my.id` string, text string, `a.b` int")
    kept = keep_good(df)
    assert kept.columns == df.columns
    assert {r["my.id"] for r in kept.collect()} == {*letters, "it", "long"}

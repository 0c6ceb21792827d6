import random
from collections import defaultdict

from plumage.llm.chat_format import BUDGET, HISTORY, PROBE, chat_windows, read_back, with_probe

SCHEMA = "conv_id long, turn long, role string, text string, window string, p int"
NASTY = ["<|end|>", "\\", "\\<|", "<\\|role|>", "<", "|>", "<|", "\\\\", "### Assistant:", "</turn>", "\n", "ä", ""]


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(40):
        n = rng.randint(1, 14)
        for t in range(n):
            role = "system" if t == 0 and c % 3 else rng.choice(["user", "assistant", "tool<|text|>", None])
            text = None if rng.random() < 0.05 else "".join(rng.choice(NASTY) for _ in range(rng.randint(0, 12))) + "w " * rng.choice([3, 30, 150, 800 if c == 5 else 90])
            rows.append((c, t, role, text, "clash", 1))
    rows += [(100, 0, "system", "alone", "", 1), (101, 0, "assistant", "twice", "", 1), (101, 0, "assistant", "twice", "", 1), (None, None, "user", "no id", "", 1)]
    return rows


def size(text):
    return -(-len(text) // 4) + 4


def test_round_trip_and_budget(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    windows = chat_windows(df).collect()
    back = {r.conv_id: r for r in read_back(chat_windows(df)).collect()}
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert back.keys() == by.keys()
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, r, x in turns]
        assert back[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")
        own = sorted((w for w in windows if w.conv_id == c), key=lambda w: w.window)
        assert [w.window for w in own] == list(range(len(own)))
        assert back[c].formatted_chars == sum(len(w.formatted) for w in own)
        for w in own:
            pieces = w.formatted.split("<|end|>")[:-1]
            new = [p for p in pieces if p.startswith("<|role|>")]
            again = [p for p in pieces if p.startswith("<|again|>")]
            assert len(new) + len(again) == len(pieces) and len(again) <= HISTORY + 1
            assert w.n_tokens <= BUDGET or len(new) <= 1 or (w.window == 0 and len(new) == 2 and turns[0][1] == "system")
            if turns[0][1] == "system":
                assert pieces[0].startswith(("<|role|>" if w.window == 0 else "<|again|>") + "system<|text|>")
            for s in w.loss:
                assert w.formatted[: s.start].endswith("<|role|>assistant<|text|>") and w.formatted[s.start + s.length :].startswith("<|end|>")


def test_probe_and_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat_windows(df).count() == 0
    r = read_back(chat_windows(with_probe(spark, df))).collect()
    assert len(r) == 1 and r[0].conv_id == -7 and [t.text for t in r[0].turns] == [PROBE, PROBE] and r[0].loss_text == PROBE


def test_a_conversation_of_thousands_of_turns_and_a_long_text(spark):
    turns = [(1, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(1500)] + [(2, 0, "user", "ä<|" * 200_000), (2, 1, "assistant", "\\" * 300_000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    back = {r.conv_id: r for r in read_back(chat_windows(df)).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for c, _, r, t in turns if c == 1]
    assert back[1].loss_text == "".join(t for c, _, r, t in turns if c == 1 and r == "assistant")
    assert [t.text for t in back[2].turns] == [turns[-2][3], turns[-1][3]] and back[2].loss_text == turns[-1][3]

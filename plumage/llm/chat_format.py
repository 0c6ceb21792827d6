"""Chat formatting with budgeted windows, in DataFrame operations only.

A conversation's turns are packed into windows of at most ``budget`` tokens. Prefix sums of the turns' tokens choose the
spans: a window takes new turns while their sum fits what the budget leaves beside the system turn and the repeated
history, and never cuts a turn, so a single turn above the budget has a window of its own. Every window starts with the
conversation's system turn (if its first turn is one), then repeats up to ``history`` of the turns just before its span, so
long as they fit, then has its new turns. Loss is on the assistant turns among the new ones only, so each target counts
once.

A window is one string. A turn is ``<|role|>`` + role + ``<|text|>`` + text + ``<|end|>``; a repeated one has
``<|again|>`` in place of ``<|role|>``. In roles and texts a backslash is doubled and ``<|`` becomes ``<\\|``, so no mark can
occur inside and unescaping is exact. The loss mask is an array of (start, length) in code points of the string.

A conversation is the unit of output (its digest covers all of it), so its turns meet in one row; the shuffle is by
conversation, and nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.llm.common import pick, table

BUDGET = 256
HISTORY = 2
NEW, AGAIN, TEXT, END = "<|role|>", "<|again|>", "<|text|>", "<|end|>"
BACKSLASH = "\\"
PROBE = "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit(BACKSLASH), F.lit(BACKSLASH * 2)), F.lit("<|"), F.lit("<" + BACKSLASH + "|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<" + BACKSLASH + "|"), F.lit("<|")), F.lit(BACKSLASH * 2), F.lit(BACKSLASH))


def tokens(text: Column) -> Column:
    """A turn's size: a token for every four characters or part of it, and four for its marks."""
    return F.ceil(F.length(text) / 4).cast("long") + 4


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda s, x: s + x)


def chat_windows(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row for each window: conv_id, window (from 0), formatted, loss (array of start, length), n_tokens.

    Rows are ordered by turn, equal turns by role and text; a null turn comes first. A null role or text is empty. Rows with
    null conv_id form one conversation. Repeated rows are turns of their own. An empty table gives no windows; other
    columns of ``turns`` play no part.
    """
    t = turns.select(
        pick(turns, conv).alias("conv_id"),
        F.struct(pick(turns, turn).alias("turn"), F.coalesce(pick(turns, role), F.lit("")).alias("role"), F.coalesce(pick(turns, text), F.lit("")).alias("text")).alias("t"),
    )
    convs = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("size", F.transform("ts", lambda x: tokens(x["text"])))
    first = F.get("ts", F.lit(0))
    convs = convs.withColumn("sys", F.when(first["role"] == "system", 1).otherwise(0))
    # ends[i]: tokens of turns 0 to i. left: what the budget leaves to history and new turns.
    convs = convs.withColumn("left", F.lit(budget) - F.when(F.col("sys") == 1, F.get("size", F.lit(0))).otherwise(0))
    none = F.array().cast("array<struct<from:int,at:int,to:int>>")
    convs = convs.withColumn(
        "ends", F.aggregate("size", F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("bigint")) + x)))
    )
    before = lambda i: F.coalesce(F.get(F.col("ends"), i - 1), F.lit(0).cast("bigint"))  # noqa: E731  tokens of the turns before i

    def grow(acc: Column, i: Column) -> Column:
        """Turn i joins the open window (from..to, new turns at..to) if all of it fits, else opens the next one."""
        last = F.get(acc, F.size(acc) - 1)
        fits = (F.size(acc) > 0) & (before(i + 1) - before(last["from"]) <= F.col("left"))
        # history of a new window: the most turns before i that leave room for turn i
        lows = F.filter(F.sequence(F.greatest(F.col("sys"), i - history), i), lambda j: (j == i) | (before(i + 1) - before(j) <= F.col("left")))
        opened = F.struct(F.array_min(lows).alias("from"), i.alias("at"), i.alias("to"))
        longer = F.struct(last["from"].alias("from"), last["at"].alias("at"), i.alias("to"))
        return F.when(fits, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(opened)))

    # A conversation of nothing but a system turn has one window without new turns.
    only = F.array(F.struct(F.lit(1).alias("from"), F.lit(1).alias("at"), F.lit(0).alias("to")))
    spans = F.when(F.size("ts") > F.col("sys"), F.aggregate(F.sequence(F.col("sys"), F.size("ts") - 1), none, grow)).otherwise(only)
    convs = convs.withColumn("spans", spans)

    def piece(x: Column, again: Column, loss: Column) -> Column:
        head = F.concat(F.when(again, AGAIN).otherwise(NEW), escape(x["role"]), F.lit(TEXT))
        return F.struct(head.alias("head"), escape(x["text"]).alias("body"), loss.alias("loss"))

    def window(w: Column, k: Column) -> Column:
        system = F.transform(F.slice("ts", F.lit(1), F.col("sys")), lambda x: piece(x, k > 0, F.lit(False)))
        old = F.transform(F.slice("ts", w["from"] + 1, w["at"] - w["from"]), lambda x: piece(x, F.lit(True), F.lit(False)))
        new = F.transform(F.slice("ts", w["at"] + 1, w["to"] - w["at"] + 1), lambda x: piece(x, F.lit(False), x["role"] == "assistant"))
        used = F.lit(budget) - F.col("left") + before(w["to"] + 1) - before(w["from"])
        return F.struct(k.alias("window"), F.concat(system, old, new).alias("p"), used.alias("n_tokens"))

    # Windows are made before they become rows, so that no row holds more than its own turns.
    w = convs.select("conv_id", F.explode(F.transform("spans", window)).alias("w")).select("conv_id", "w.*")
    whole = F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END)))
    w = w.withColumn("whole", whole)
    start = lambda i: F.aggregate(F.slice("whole", F.lit(1), i), F.lit(0), lambda s, x: s + F.length(x)) + F.length(F.get("p", i)["head"])
    spots = F.transform("p", lambda x, i: F.struct(start(i).alias("start"), F.length(x["body"]).alias("length"), x["loss"].alias("loss")))
    loss = F.transform(F.filter(spots, lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))
    return w.select("conv_id", "window", F.array_join("whole", "").alias("formatted"), loss.alias("loss"), "n_tokens")


def read_back(windows: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, turns (array of role, text: each turn once, in order), loss_text, formatted_chars."""

    def parse(x: Column) -> Column:
        role_text = F.split_part(x, F.lit(NEW), F.lit(2))
        return F.struct(unescape(F.split_part(role_text, F.lit(TEXT), F.lit(1))).alias("role"), unescape(F.split_part(role_text, F.lit(TEXT), F.lit(2))).alias("text"))

    parts = F.filter(F.split("formatted", "<\\|end\\|>"), lambda x: x.startswith(NEW))
    masked = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    one = windows.select("conv_id", F.struct("window", F.transform(parts, parse).alias("turns"), masked.alias("loss"), F.length("formatted").cast("long").alias("n")).alias("w"))
    # as many windows as the conversation has; they were one row before
    ws = one.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return ws.select(
        "conv_id",
        F.flatten(F.transform("ws", lambda w: w["turns"])).alias("turns"),
        F.array_join(F.transform("ws", lambda w: w["loss"]), "").alias("loss_text"),
        _sum(F.transform("ws", lambda w: w["n"])).alias("formatted_chars"),
    )


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """``turns`` and conversation -7, whose texts hold control strings of common templates."""
    probe = spark.sql("select cast(-7 as bigint) as conv_id, stack(2, 0L, 'user', 1L, 'assistant') as (turn, role)").withColumn("text", F.lit(PROBE))
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe.select("conv_id", "turn", "role", "text"))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    back = read_back(chat_windows(with_probe(spark, table(spark, sf_dir, "conversations"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLE = f"""
with recursive c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, turn, role, '{PROBE}' from (values (0, 'user'), (1, 'assistant')) v(turn, role)),
t as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i from c),
s as (select *, cast(ceil(length(text) / 4) as bigint) + 4 as size, {len(TEXT + END)} + {" + ".join(f"length(replace(replace({x}, '{BACKSLASH}', '{BACKSLASH * 2}'), '<|', '<{BACKSLASH}|'))" for x in ("role", "text"))} as chars from t),
b as (select *, sum(size) over w as e, first_value(size) over w as size0, first_value(chars) over w as chars0, first_value(role) over w = 'system' as sys from s window w as (partition by conv_id order by i)),
m as (select *, e - size as before, sys::int as low, {BUDGET} - case when sys then size0 else 0 end as room from b),
o as (select m.conv_id, m.i, min(h.before) as start, coalesce(sum(h.chars + {len(AGAIN)}) filter (h.i < m.i), 0) as history from m join m h on h.conv_id = m.conv_id and h.i between greatest(m.low, m.i - {HISTORY}) and m.i
  where h.i = m.i or m.e - h.before <= m.room group by all),
r as (select conv_id, i, before as start, cast(case when sys then chars0 + {len(NEW)} else 0 end + chars + {len(NEW)} as bigint) as total from m where i = low
  union all select m.conv_id, m.i, case when m.e - r.start <= room then r.start else o.start end,
    cast(total + chars + {len(NEW)} + case when m.e - r.start <= room then 0 else history + case when sys then chars0 + {len(AGAIN)} else 0 end end as bigint)
  from r join m on m.conv_id = r.conv_id and m.i = r.i + 1 join o on o.conv_id = m.conv_id and o.i = m.i),
f as (select conv_id, max(total) as total from r group by 1)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  coalesce(length(string_agg(text, '' order by i) filter (role = 'assistant')), 0) as loss_chars, sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(any_value(total), any_value(chars0) + {len(NEW)}) as formatted_chars
from m left join f using (conv_id) group by conv_id
"""

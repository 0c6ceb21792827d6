"""Event operators in batch form, and their streaming twins.

Events are (seq, job_id, tag, value, ts); tags are started, progress, warning, finished. A job's state is a fold
by key of which only last values and counts matter, so the batch form is one aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATE = "job_id long, status string, warnings long, last_seq long"


def retained(events: DataFrame, ring: int = 256) -> DataFrame:
    """The newest ``ring`` events, what a bounded buffer can replay."""
    top = events.agg(F.max("seq").alias("top"))
    return events.join(F.broadcast(top), F.col("seq") > F.col("top") - ring).drop("top")  # one row


def replay_since(events: DataFrame, seq: int, ring: int = 256) -> DataFrame:
    """Retained events after ``seq``."""
    return retained(events, ring).where(F.col("seq") > seq)


def gaps(events: DataFrame, key: str = "job_id") -> DataFrame:
    """Holes in the sequence numbers that a subscriber of one key alone sees (from, to). See resumed for what a replay misses."""
    before = F.lag("seq").over(Window.partitionBy(key).orderBy("seq"))
    return events.select(key, "seq", before.alias("before")).where("seq > before + 1").select(key, (F.col("before") + 1).alias("missing_from"), (F.col("seq") - 1).alias("missing_to"))


def resumed(clients: DataFrame, events: DataFrame, ring: int = 256) -> DataFrame:
    """clients (client, last_seq) with n_replayed and snapshot: what each gets on reconnecting.

    It gets the retained events after the last one that it saw. Where the first of them isn't the very next one, events are lost
    and a snapshot comes first; so it does for a client that has seen nothing (null). The ring, at most ``ring`` numbers, is
    one row that all clients are held against.
    """
    kept = retained(events, ring).agg(F.array_sort(F.collect_list("seq")).alias("_ring"))
    rows = clients.crossJoin(F.broadcast(kept))  # one row
    missed = F.filter("_ring", lambda x: x > F.col("last_seq"))
    lost = F.get(missed, F.lit(0)) > F.col("last_seq") + 1
    fresh = F.col("last_seq").isNull()
    return rows.select("client", "last_seq", F.when(fresh, 0).otherwise(F.size(missed)).alias("n_replayed"), (fresh | F.coalesce(lost, F.lit(False))).alias("snapshot"))


def job_state(events: DataFrame) -> DataFrame:
    """job_id, status, warnings, last_seq. A start forgets what was before; a job that was never started is running."""
    last_start = events.where("tag = 'started'").groupBy("job_id").agg(F.max("seq").alias("start"))
    live = events.join(last_start, "job_id", "left").where("start is null or seq >= start")
    out = live.groupBy("job_id").agg(F.count_if(F.col("tag") == "warning").alias("warnings"), F.max("seq").alias("last_seq"), F.count_if(F.col("tag") == "finished").alias("ends"))
    status = F.when(F.col("ends") == 0, "running").when(F.col("warnings") == 0, "completed").otherwise("completed_with_errors")
    return out.select("job_id", status.alias("status"), "warnings", "last_seq")


def change_points(events: DataFrame, key: str, value: str) -> DataFrame:
    """Events at which a key's value differs from its event before; the first one counts."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy("seq"))
    return events.withColumn("_b", before).where(~F.col(value).eqNullSafe(F.col("_b"))).drop("_b")


def debounced(events: DataFrame, key: str, quiet: str) -> DataFrame:
    """One row for each burst of a key (session_start, n): events at most ``quiet`` apart."""
    s = events.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), "n")


def isolated_failures(steps: DataFrame) -> DataFrame:
    """Steps (page, step, failed) that ran: none after a page's first failure; other pages go on."""
    failed = F.max(F.col("failed").cast("int")).over(Window.partitionBy("page").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    return steps.withColumn("_f", F.coalesce(failed, F.lit(0))).where("_f = 0").drop("_f")


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    started, warnings, ends, last = state.get if state.exists else (False, 0, 0, -1)
    for pdf in batches:
        for seq, tag in sorted(zip(pdf["seq"], pdf["tag"])):
            if tag == "started":
                started, warnings, ends = True, 0, 0
            warnings += tag == "warning"
            ends += tag == "finished"
            last = max(last, int(seq))
    state.update((started, int(warnings), int(ends), last))
    status = "running" if not ends else "completed_with_errors" if warnings else "completed"
    yield pd.DataFrame([(int(key[0]), status, int(warnings), last)], columns=["job_id", "status", "warnings", "last_seq"])


def job_state_stream(events: DataFrame) -> DataFrame:
    """The streaming twin of job_state: an update of a job's row for each micro-batch with events of it.

    Events of a job must come in order of seq between micro-batches, as a log gives them. The state is four numbers a job.
    """
    return events.groupBy("job_id").applyInPandasWithState(_update, STATE, "started boolean, warnings long, ends long, last long", "update", "NoTimeout")


def debounced_stream(events: DataFrame, key: str, quiet: str, late: str) -> DataFrame:
    """The streaming twin of debounced; bursts come out once the watermark has passed them."""
    return debounced(events.withWatermark("ts", late), key, quiet)


def deduplicated_stream(events: DataFrame, late: str) -> DataFrame:
    """Each seq once, though a subscriber that replays while it listens may see it twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["seq"])

"""A subscriber's frames from buses of events, with snapshots where it has fallen behind; as a stream and in batch form.

Events are (bus, seq, job_id, tag), seq counting from 1 on each bus without gaps. A bus keeps its newest ``ring`` events. A
subscriber that reads more than that at once, or finds that the next event isn't the one after its last, has lost some: it
gets a reset, the state of all jobs at that point, and the retained events after it. So it does on its first read.

Frames are (bus, frame, seq, job_id, tag, status, warnings, last_seq): "reset" (seq: what the snapshot covers), one "job" for each
job of the snapshot, "event", and "alive" after a time without any.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from plumage.streaming.jobs import job_state

FRAMES = "bus long, frame string, seq long, job_id long, tag string, status string, warnings long, last_seq long"
_COLUMNS = [c.split()[0] for c in FRAMES.split(", ")]
#: Milliseconds after which a silent bus gets a sign of life.
QUIET_MS = 15_000


class Recovery(StatefulProcessor):
    """State: the last seq read, and for each job of the bus (started, warnings, ends, last_seq), from which a snapshot is made.

    Both may start from a snapshot: rows (bus, seq, job_id, status, warnings, last_seq), with a null job_id for a bus without jobs. A bus
    that starts from one resumes after its seq and isn't reset.
    """

    def __init__(self, ring: int, quiet_ms: int | None):
        self.ring, self.quiet_ms = ring, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "seq long")
        self.alarm = handle.getValueState("alarm", "at long")
        self.jobs = handle.getMapState("jobs", "job_id long", "warnings long, ends long, last_seq long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.seen.update((int(initialState["seq"].max()),))
        for r in initialState.dropna(subset=["job_id"]).itertuples():
            self.jobs.updateValue((int(r.job_id),), (int(r.warnings), int(r.status != "running"), int(r.last_seq)))

    def _fold(self, events: pd.DataFrame) -> None:
        now: dict[int, tuple[int, int, int]] = {}
        for seq, job, tag in zip(events["seq"], events["job_id"], events["tag"], strict=True):
            key = (int(job),)
            if key[0] not in now:
                now[key[0]] = tuple(self.jobs.getValue(key)) if self.jobs.containsKey(key) else (0, 0, 0)
            warnings, ends, _ = (0, 0, 0) if tag == "started" else now[key[0]]
            now[key[0]] = (warnings + (tag == "warning"), ends + (tag == "finished"), int(seq))
        for job, state in now.items():
            self.jobs.updateValue((job,), state)

    def _snapshot(self, bus: int, seq: int) -> list[tuple]:
        out = [(bus, "reset", seq, None, None, None, None, None)]
        for (job,), (warnings, ends, last) in self.jobs.iterator():
            status = "running" if not ends else "completed_with_errors" if warnings else "completed"
            out.append((bus, "job", seq, job, None, status, warnings, last))
        return out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bus, fresh = int(key[0]), not self.seen.exists()
        seen = 0 if fresh else int(self.seen.get()[0])
        events = pd.concat(list(rows)).drop_duplicates("seq").sort_values("seq")  # a micro-batch of one bus; the trigger bounds it
        events = events[events["seq"] > seen]
        if len(events):
            first, last = int(events["seq"].iloc[0]), int(events["seq"].iloc[-1])
            kept = events[events["seq"] > last - self.ring]
            behind = fresh or first > seen + 1 or len(kept) < len(events)
            self._fold(events[: len(events) - len(kept)])
            if behind:
                yield pd.DataFrame(self._snapshot(bus, int(kept["seq"].iloc[0]) - 1), columns=_COLUMNS)
            self._fold(kept)
            self.seen.update((last,))
            out = [(bus, "event", int(s), int(j), t, None, None, None) for s, j, t in zip(kept["seq"], kept["job_id"], kept["tag"], strict=True)]
            yield pd.DataFrame(out, columns=_COLUMNS)
        self._rearm(timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._rearm(timerValues)
        yield pd.DataFrame([(int(key[0]), "alive", int(self.seen.get()[0]), None, None, None, None, None)], columns=_COLUMNS)

    def _rearm(self, timers) -> None:
        if self.quiet_ms is None:
            return
        if self.alarm.exists():
            self.handle.deleteTimer(int(self.alarm.get()[0]))
        at = timers.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.alarm.update((at,))
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def recovered_stream(events: DataFrame, ring: int = 256, snapshot: DataFrame | None = None, quiet_ms: int | None = QUIET_MS) -> DataFrame:
    """The frames of a stream of events. Needs a state store that keeps several states a key (RocksDB).

    What a micro-batch brings is one read. ``snapshot`` (bus, seq, job_id, status, warnings, last_seq) is where buses resume. Without
    ``quiet_ms`` there are no signs of life, which otherwise keep a query busy that should stop after what is available now.
    """
    start = None if snapshot is None else snapshot.groupBy("bus")
    return events.groupBy("bus").transformWithStateInPandas(Recovery(ring, quiet_ms), FRAMES, "Append", "None" if quiet_ms is None else "ProcessingTime", start)


def reads(events: DataFrame, read: str, ring: int = 256) -> DataFrame:
    """The batch form of what each read of a bus brings: (bus, read, from_seq, n_events, lost, snapshot). Later reads have later seqs."""
    r = events.groupBy("bus", read).agg(F.count("*").alias("n"), F.max("seq").alias("top"))
    first = F.row_number().over(Window.partitionBy("bus").orderBy("top")) == 1
    kept = F.least(F.col("n"), F.lit(ring))
    lost = F.col("n") - kept
    return r.select("bus", read, (F.col("top") - kept + 1).alias("from_seq"), kept.alias("n_events"), lost.alias("lost"), (first | (lost > 0)).alias("snapshot"))


def frames(events: DataFrame, read: str, ring: int = 256) -> DataFrame:
    """The batch form of the frames from each bus's last reset on; those before it make no difference to anyone."""
    got = reads(events, read, ring)
    reset = got.where("snapshot").groupBy("bus").agg((F.max("from_seq") - 1).alias("reset"))
    e = events.join(reset, "bus")
    jobs = job_state(e.where("seq <= reset")).join(e.groupBy("job_id").agg(F.max("bus").alias("bus"), F.max("reset").alias("seq")), "job_id")
    null = lambda c: F.lit(None).cast(dict(x.split() for x in FRAMES.split(", "))[c]).alias(c)
    out = reset.select("bus", F.lit("reset").alias("frame"), F.col("reset").alias("seq"), *map(null, _COLUMNS[3:]))
    out = out.unionByName(jobs.select("bus", F.lit("job").alias("frame"), "seq", "job_id", null("tag"), "status", "warnings", "last_seq"))
    return out.unionByName(e.where("seq > reset").select("bus", F.lit("event").alias("frame"), "seq", "job_id", "tag", *map(null, _COLUMNS[5:])))


def mirrored(frames: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """What a subscriber knows from its frames alone: (bus, job_id, status, warnings, last_seq). ``snapshot``: where it resumed."""
    jobs = frames.where("frame = 'job'").select("bus", "seq", "job_id", "status", "warnings", "last_seq")
    resets = frames.where("frame = 'reset'").select("bus", "seq")
    if snapshot is not None:
        jobs, resets = jobs.unionByName(snapshot.where("job_id is not null")), resets.unionByName(snapshot.select("bus", "seq"))
    last = resets.groupBy("bus").agg(F.max("seq").alias("reset"))
    base = jobs.join(last, "bus").where("seq = reset").select("bus", "job_id", "status", "warnings", "last_seq").distinct()
    news = frames.where("frame = 'event'").join(last, "bus").where("seq > reset").select("bus", "seq", "job_id", "tag").distinct()
    starts = news.where("tag = 'started'").groupBy("bus", "job_id").agg(F.max("seq").alias("start"))
    news = news.join(starts, ["bus", "job_id"], "left").where("start is null or seq >= start")
    sums = news.groupBy("bus", "job_id").agg(F.count_if(F.col("tag") == "warning").alias("w"), F.count_if(F.col("tag") == "finished").alias("ends"), F.max("seq").alias("top"), F.max("start").alias("start"))
    both = base.join(sums, ["bus", "job_id"], "full_outer")
    old = F.col("start").isNull() & F.col("status").isNotNull()  # nothing has started anew since the snapshot
    warnings = F.coalesce("w", F.lit(0)) + F.when(old, F.col("warnings")).otherwise(0)
    ended = (F.coalesce("ends", F.lit(0)) > 0) | (old & (F.col("status") != "running"))
    status = F.when(~ended, "running").when(warnings == 0, "completed").otherwise("completed_with_errors")
    return both.select("bus", "job_id", status.alias("status"), warnings.alias("warnings"), F.coalesce("top", "last_seq").alias("last_seq"))

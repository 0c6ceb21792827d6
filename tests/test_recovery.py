"""A subscriber that falls behind ends with what the batch form gives, from a snapshot or from nothing."""

import random
import time

import pytest
from pyspark.sql import functions as F

from plumage.streaming import jobs, recovery

SCHEMA = "bus long, seq long, job_id long, tag string, read int"


def events(buses=7, seed=2):
    rng, out = random.Random(seed), []
    for bus in range(buses):
        seq = 0
        for read in range(4):
            for _ in range(rng.choice([0, 3, 10, 40])):
                seq += 1
                out.append((bus, seq, bus * 10 + rng.randrange(4), rng.choice(["started", "progress", "progress", "warning", "finished"]), read))
    return out


def stream(spark, rows, path):
    for k in sorted({r[4] for r in rows}):
        spark.createDataFrame([r for r in rows if r[4] == k], SCHEMA).coalesce(1).write.parquet(f"{path}/in/b{k}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{path}/in")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def drain(df, name, path, **trigger):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/cp").trigger(**(trigger or {"availableNow": True})).start()
    if not trigger:
        q.awaitTermination(180)
        assert q.exception() is None
    return q


def frames_of(spark, name):
    return spark.createDataFrame(spark.table(name).collect(), recovery.FRAMES)


def rows_of(df):
    return sorted(map(tuple, df.select("job_id", "status", "warnings", "last_seq").collect()))


def test_lagging_stream_equals_batch(spark, tmp_path, rocks):
    rows = events()
    drain(recovery.recovered_stream(stream(spark, rows, tmp_path), ring=12, quiet_ms=None), "lagging", tmp_path)
    frames, e = frames_of(spark, "lagging"), spark.createDataFrame(rows, SCHEMA)
    assert rows_of(recovery.mirrored(frames)) == rows_of(jobs.job_state(e)) == rows_of(recovery.mirrored(recovery.frames(e, "read", 12)))
    got = {(r.bus, r.seq) for r in frames.where("frame = 'event'").collect()}
    assert len(got) == frames.where("frame = 'event'").count() < len(rows)
    reads = recovery.reads(e, "read", 12).collect()
    assert sum(r.n_events for r in reads) == len(got) and sum(r.lost for r in reads) == len(rows) - len(got) > 30
    assert {(r.bus, r.seq) for r in frames.where("frame = 'reset'").collect()} == {(r.bus, r.from_seq - 1) for r in reads if r.snapshot}


def test_resumes_from_a_snapshot(spark, tmp_path, rocks):
    rows = events(seed=3)
    old = spark.createDataFrame([r for r in rows if r[4] == 0 and r[0] < 5], SCHEMA)
    snapshot = jobs.job_state(old).join(old.select("job_id", "bus").distinct(), "job_id").join(old.groupBy("bus").agg(F.max("seq").alias("seq")), "bus")
    snapshot = snapshot.select("bus", "seq", "job_id", "status", "warnings", "last_seq")
    late = [r for r in rows if r[4] > 0 or r[0] >= 5]
    late += [r[:4] + (2,) for r in rows if r[4] == 1]  # read twice
    drain(recovery.recovered_stream(stream(spark, late, tmp_path), ring=15, snapshot=snapshot, quiet_ms=None), "resumed", tmp_path)
    frames = frames_of(spark, "resumed")
    assert rows_of(recovery.mirrored(frames, snapshot)) == rows_of(jobs.job_state(spark.createDataFrame(rows, SCHEMA)))
    assert frames.where("frame = 'event'").count() == frames.where("frame = 'event'").select("bus", "seq").distinct().count()


def test_gap_makes_a_reset_and_silence_a_sign_of_life(spark, tmp_path, rocks):
    rows = [(1, s, 5, "progress", 0) for s in (1, 2, 3)] + [(1, s, 5, "warning", 1) for s in (6, 7)]
    q = drain(recovery.recovered_stream(stream(spark, rows, tmp_path), quiet_ms=300), "silent", tmp_path, processingTime="200 milliseconds")
    until = time.time() + 90
    while time.time() < until and not spark.table("silent").where("frame = 'alive' and seq = 7").count():
        time.sleep(1)
    q.stop()
    frames = frames_of(spark, "silent")
    assert {r.seq for r in frames.where("frame = 'reset'").collect()} == {0, 5}
    assert {r.seq for r in frames.where("frame = 'alive'").collect()} >= {7}

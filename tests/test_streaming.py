"""Streams give what the batch forms give on the same events."""

from pyspark.sql import functions as F

from plumage.plans.log_queries import events
from plumage.streaming import jobs

DIR = "/root/testdata/sf0.001"


def source(spark, tmp_path, batches=3):
    e = events(spark, DIR)
    n = e.count()
    for k in range(batches):
        e.where((F.col("seq") * batches / n).cast("int") == k).coalesce(1).write.parquet(f"{tmp_path}/in/b{k}")
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def drain(df, mode, name, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


def test_job_state(spark, tmp_path):
    out = drain(jobs.job_state_stream(source(spark, tmp_path)), "update", "states", tmp_path)
    last = out.groupBy("job_id").agg(F.max_by(F.struct("status", "warnings", "last_seq"), "last_seq").alias("s")).select("job_id", "s.*")
    batch = jobs.job_state(events(spark, DIR)).select("job_id", "status", "warnings", "last_seq")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, batch.collect()))


def test_debounce_closed_windows(spark, tmp_path):
    out = drain(jobs.debounced_stream(source(spark, tmp_path), "job_id", "30 minutes", "1 hour"), "append", "bursts", tmp_path)
    batch = {tuple(r) for r in jobs.debounced(events(spark, DIR), "job_id", "30 minutes").collect()}
    got = {tuple(r) for r in out.collect()}
    assert got <= batch and len(got) > 0.9 * len(batch)

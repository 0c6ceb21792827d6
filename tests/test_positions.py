"""Global positions on more rows than a range partition's sample, with columns besides the keys."""

from pyspark.sql import functions as F

from plumage.operators.aggregate import global_position


def test_positions_of_wide_rows(spark):
    rows = spark.range(300_000).select(F.xxhash64("id").alias("k"), F.col("id").alias("extra"), F.sha2(F.col("id").cast("string"), 256).alias("more"))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = global_position(rows, "k", "extra").select("position", "k", "extra").toPandas()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    want = got.sort_values(["k", "extra"])
    assert len(got) == 300_000 and want["position"].tolist() == list(range(1, 300_001))


def test_positions_of_few_rows(spark):
    df = spark.createDataFrame([(2, "b", 1), (1, "a", 2), (2, "a", 3)], "k int, s string, x int")
    assert sorted((r.position, r.x) for r in global_position(df, F.desc("k"), "s").collect()) == [(1, 3), (2, 1), (3, 2)]
    assert global_position(df.limit(0), "k").count() == 0

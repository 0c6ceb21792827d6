"""Tables derived from the driver's tables by plain expressions, each with the same rows in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOX_COLUMNS = [
    "l_orderkey as page_id",
    "cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as int) as box_id",
    "cast((l_partkey * 37) % 800 as int) as x1",
    "cast((l_suppkey * 53) % 1200 as int) as y1",
    "cast((l_partkey * 37) % 800 + floor(l_quantity) * 4 + 1 as int) as x2",
    "cast((l_suppkey * 53) % 1200 + (l_partkey * l_linenumber) % 160 + 6 as int) as y2",
    "cast(floor(l_extendedprice * 100) % 1000 as int) as score",
    "l_returnflag as label",
]
#: Boxes of a detector: page, number on the page, corners in whole pixels, score in thousandths, label.
BOXES_SQL = f"boxes as (select {', '.join(BOX_COLUMNS)} from lineitem)"

CHANGE_COLUMNS = ["event_id as epoch", "user_id as entity", "event_type as field", "cast(get_json_object(props, '$.k') as int) as v"]
#: Field updates: epoch, entity, field, value.
CHANGES_SQL = "changes as (select event_id as epoch, user_id as entity, event_type as field, cast(json_extract_string(props, '$.k') as int) as v from events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Boxes that a task numbers and ranks, about, where there are more than the session's partitions would hold of them.
ROWS = 200_000


def _boxes(lineitem: DataFrame) -> DataFrame:
    """The columns above, numbered by page_id itself: by an alias of it, rows wouldn't count as lying by page, and be shuffled again."""
    return lineitem.selectExpr("page_id", *[c.replace("l_orderkey", "page_id") for c in BOX_COLUMNS[1:]])


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id"))


def spread_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``boxes`` in partitions by page whose number grows with the table, so that no task's part does. For what needs their numbers; others shuffle less without."""
    t = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page_id")
    parts = -(-t.count() // ROWS)
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        t = t.repartition(parts, "page_id")
    return _boxes(t)


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*CHANGE_COLUMNS)

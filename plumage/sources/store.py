"""Sources and sinks: files as pages, a content-addressed store, a change log with snapshots, exports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumage.functions.text import natural_key
from plumage.operators.aggregate import global_position


def import_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, hash, length, content) of each file; names sort naturally by ``key``. No file is read on the driver."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "[^/]+$", 0)
    return f.select(name.alias("name"), natural_key(name).alias("key"), F.sha2("content", 256).alias("hash"), "length", "content")


def put(store: DataFrame | None, blobs: DataFrame) -> DataFrame:
    """The blobs (hash, content) that the store doesn't have yet, each once."""
    new = blobs.select("hash", "content").dropDuplicates(["hash"])
    return new if store is None else new.join(store.select("hash"), "hash", "left_anti")


def get(store: DataFrame, refs: DataFrame) -> DataFrame:
    """Each reference with its content; null content where it is missing."""
    return refs.join(store, "hash", "left")


def write_snapshot(state: DataFrame, root: str, epoch: int) -> None:
    state.write.mode("overwrite").parquet(f"{root}/snapshot/epoch={epoch}")


def read_snapshot(spark: SparkSession, root: str, schema: str) -> tuple[DataFrame, int]:
    """The newest snapshot under ``root`` and its epoch; no rows and -1 where there is none."""
    found = spark.read.schema(f"{schema}, epoch long").parquet(f"{root}/snapshot") if exists(spark, f"{root}/snapshot") else None
    top = None if found is None else found.agg(F.max("epoch")).first()[0]
    if top is None:
        return spark.createDataFrame([], schema), -1
    return found.where(F.col("epoch") == top).drop("epoch"), top


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file source finds anything under ``path``."""
    try:
        return bool(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").limit(1).count())
    except AnalysisException:
        return False


def truncated_log(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What has to stay of the log: the changes after the newest snapshot. Written beside the old one, it takes its place."""
    return read_log(spark, root, read_snapshot(spark, root, schema)[1], schema)


def append_log(changes: DataFrame, root: str) -> None:
    changes.write.mode("append").json(f"{root}/log")


def read_log(spark: SparkSession, root: str, after: int, schema: str) -> DataFrame:
    """Logged changes after an epoch. A record that can't be read ends the log: only those before it count."""
    raw = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(f"{root}/log").withColumn("_k", F.coalesce("epoch", F.expr("try_cast(regexp_extract(_bad, '\"epoch\":([0-9]+)', 1) as bigint)")))
    first_bad = raw.where("_bad is not null").agg(F.coalesce(F.min("_k"), F.lit((1 << 63) - 1)).alias("stop"))
    return raw.crossJoin(F.broadcast(first_bad)).where((F.col("_bad").isNull()) & (F.col("epoch") < F.col("stop")) & (F.col("epoch") > after)).drop("_bad", "_k", "stop")  # one row


def as_json(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("json"))


def download_ranges(files: DataFrame, part: int) -> DataFrame:
    """(id, first, last) byte ranges of ``part`` bytes for files (id, total)."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("total") - 1, F.lit(0)), F.lit(part).cast("long")))
    r = files.where("total > 0").select("id", "total", starts.alias("first"))
    return r.select("id", "first", F.least(F.col("first") + part - 1, F.col("total") - 1).alias("last"))


def raw_header(content: Column) -> tuple[Column, Column]:
    """Width and height of a raw image: 'RGBA', then both as little-endian 32-bit numbers."""
    word = lambda at: F.conv(F.hex(F.reverse(F.substr(content, F.lit(at), F.lit(4)))), 16, 10).cast("int")
    return word(5), word(9)


def thumbnail_size(w: Column, h: Column, longest: int = 320) -> tuple[Column, Column]:
    """Scaled so that the longer side is at most ``longest``; never enlarged, never 0."""
    k = F.least(F.lit(1.0), F.lit(longest) / F.greatest(w, h))
    return tuple(F.greatest(F.round(x * k), F.lit(1.0)).cast("int") for x in (w, h))


def export_pages(blobs: DataFrame, path: str, role: str, pages: DataFrame | None = None) -> None:
    """Content of a role, one folder for each page; only the given pages if any are."""
    rows = blobs.where(F.col("role") == role)
    (rows if pages is None else rows.join(pages.select("page"), "page", "left_semi")).write.mode("overwrite").partitionBy("page").parquet(path)


def newest(listing: DataFrame, key: str, time: str) -> DataFrame:
    """A listing from the newest down, equal times by name."""
    return global_position(listing, F.desc(time), key)

"""Cutting a plan's lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_roots: dict[str, str] = {}


def _root(spark: SparkSession) -> str:
    """A folder of this session's own under spark.checkpoint.dir, deleted at exit."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="plumage-")
        _roots[app] = f"{shared}/plumage-cut-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _roots[app])
    return _roots[app]


def _drop(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone by then
        sc = spark.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """``df``, written to the session's shared folder, spark.checkpoint.dir, and read again.

    A table, not a checkpoint: a checkpoint keeps the estimates of the plan that it cuts, and joins multiply those in every round
    of a loop. A session of local mode that names no folder gets a local one, as in tests; on a cluster that is an error,
    as executors would each write to their own disk.
    """
    path = f"{_root(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""What the operators of this folder share: reading, scratch tables, row selection and work measures."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Characters between words: space, tab, line feed, vertical tab, form feed and carriage return.
SEPARATORS = " \t\n\x0b\x0c\r"
SEPARATOR_RUN = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that an Arrow function works on at a time.
SLICE_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    A session of local mode that names none gets a local one, as in tests; on a cluster that is an error, as executors
    would each write to their own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="plumage-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def pick(df: DataFrame, name: str) -> Column:
    """The column of that name, which may hold dots and backticks."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that no name can clash with those an operator adds."""
    return F.struct(*[pick(df, c) for c in df.columns])


def slices(batches: Iterator[pa.RecordBatch], text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of column number ``text`` have about ``most`` bytes, or are one longer text.

    The batches themselves are bounded by the session (10,000 rows and 64 MB unless it says otherwise, or one longer row);
    what an operator derives from texts, often many times their size, is bounded by these slices without touching it.
    """
    for b in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        at, size = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if size and size + n > most:
                yield b.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < b.num_rows:
            yield b.slice(at)


class Scratch:
    """Parquet tables in the shared folder that cut lineage. A lost executor costs a reread, not a recomputation.

    ``save`` writes and rereads, ``drop`` deletes a table that nothing reads any more; what is left goes at exit.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumage-{uuid.uuid4().hex}"
        atexit.register(self._at_exit)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            self._drop_path(f"{self.root}/{name}")

    def _at_exit(self) -> None:
        with contextlib.suppress(Exception):  # the session may be gone by then
            self._drop_path(self.root)

    def _drop_path(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def words(text: Column) -> Column:
    """The array of maximal runs of characters outside SEPARATORS; empty for null or wordless texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SEPARATORS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_RUN))


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id written as text, mod n. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def join_split(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join of ``left`` with one row for each key, whose hot keys Spark may split at run time.

    A right side that was aggregated by the same keys would be joined as it lies, and Spark splits hot partitions only
    where both sides are shuffled for the join. So the first key is joined in another form, which asks for that shuffle of
    the small side. Whole numbers are negated bitwise, other types wrapped.
    """
    form = F.bitwise_not if dict(left.dtypes)[keys[0]] in ("int", "bigint") else F.struct
    own, other = left.withColumn("_split", form(keys[0])), right.withColumn("_split", form(keys[0])).drop(keys[0])
    return own.join(other, ["_split", *keys[1:]], how).drop("_split")


def text_digest(text: Column) -> Column:
    """SHA-256 of the text in hex; a null text counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def keep_rows(docs: DataFrame, id_col: str, text_col: str, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is in ``kept`` (columns ``_id`` and, if given, ``_sha``), one for each id and text.

    The text's digest is part of the key so that rows that share an id but not a text are told apart.
    """
    tagged = docs.select(whole_row(docs).alias("_doc"), pick(docs, id_col).alias("_did"), text_digest(pick(docs, text_col)).alias("_dsha"))
    same = tagged["_did"].eqNullSafe(kept["_id"])
    found = tagged.join(kept, same & (tagged["_dsha"] == kept["_sha"]) if "_sha" in kept.columns else same, "left_semi")
    one = Window.partitionBy("_did", "_dsha").orderBy("_did")  # with the filter below Spark keeps one row of each task before it shuffles
    return found.withColumn("_n", F.row_number().over(one)).where("_n = 1").select("_doc.*")

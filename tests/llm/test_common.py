import pyarrow as pa
import pytest

from plumage.llm.common import pick, shared_dir, slices, whole_row


def test_slices_bound_texts_and_lose_nothing():
    texts = ["a" * 10, None, "b" * 25, "", "c" * 3, "d" * 100, "e", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["i", "t"])
    got = list(slices(iter([batch, batch.slice(0, 0), batch.slice(3)]), 1, 30))
    assert [x for b in got for x in b.column(1).to_pylist()] == texts + texts[3:]
    assert all(b.num_rows and (sum(len(x or "") for x in b.column(1).to_pylist()) <= 30 or sum(bool(x) for x in b.column(1).to_pylist()) == 1) for b in got)


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1, 2)], "`a.b` int, `c``d` int")
    assert tuple(df.select(pick(df, "a.b"), pick(df, "c`d")).first()) == (1, 2)
    assert df.select(whole_row(df).alias("r")).select("r.*").columns == df.columns


def test_no_local_folder_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    Session.conf = Conf({"spark.master": "spark://host:7077", "spark.checkpoint.dir": "hdfs://x/y"})
    assert shared_dir(Session()) == "hdfs://x/y"

"""The queries of this folder against their SQL, on the driver's smallest table and on one with hard rows."""

import duckdb
import pytest

from plumage.llm.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hard_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("hard"))
    block = "\n".join(f"line number {i} of the block" for i in range(9))
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [None, "", "\n\n", block, f"x\n{block}\ny", "a\n\n\n\nb", "z\na\n\n\n\nb", "q\nr\nq\nr", "s\ns\ns", passage, f"the {passage} and", passage.upper(), "日本 " * 60, "word " * 3000, "ä b\x0bc\x1cd"] * 2
    spark.createDataFrame([(i * 7 % 1009, t, None, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    say = ["", None, "short", "\\ <| <\\| <|end|>", "w " * 300, "äöü " * 70, "x" * 1100]
    turns = [(c, t, ["system", "user", "assistant", None][(c + t * (1 + c % 2)) % 4 if t else c % 3], say[(c * t + t) % 7]) for c in range(30) for t in range(c % 9 + 1)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, passage), (4, "Line NUMBER 5, of_the-block ä")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    odd = [None, [], [0.0, 0.0], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [2.0], [-1.0], [1.0, 0.0], [0.0, 1.0], [3.0, 4.0], [3.0, 4.0], [1e-30, 2e-30]]
    spark.createDataFrame([(i * 25, v) for i, v in enumerate(odd * 3)], "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", sorted(ORACLES))
@pytest.mark.parametrize("kind", ["driver's", "hard"])
def test_query(spark, hard_dir, name, kind):
    path, files = (DIR, "") if kind == "driver's" else (hard_dir, "/*.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{path}/{t}.parquet{files}'")
    got = QUERIES[name](spark, path)
    columns = sorted(got.columns)
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted(map(tuple, got.select(*columns).collect()), key=repr)
    assert rows == sorted(want.select(*columns).fetchall(), key=repr) and rows

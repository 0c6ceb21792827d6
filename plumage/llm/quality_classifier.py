"""Quality from compression: two zstandard dictionaries, of good and of bad labelled text, and their size difference.

A text is cut into pieces of ``piece`` bytes, all of it, and each piece is compressed with either dictionary, so that a
long text's own repetitions don't hide what the dictionaries know. (bytes with the bad one - bytes with the good one) /
bytes of the text is the difference; a logistic curve, fitted on differences by dictionaries that
haven't seen the row, makes it a score.

The fit uses at most SAMPLE_ROWS labelled rows of each class, those with the smallest hash of their id, of at most
SAMPLE_CHARS characters each; its cost is thus bounded, whatever the size of the tables. Only (id, label) rows are sorted
for it, and the ids found (at most twice SAMPLE_ROWS) are broadcast to fetch their texts. Scoring maps batches: no shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import crc_mod, pick, slices, table

SAMPLE_ROWS = 2000
SAMPLE_CHARS = 50_000
DICT_BYTES = 32_768
PIECE = 1000
LEVEL = 3
THRESHOLD = 0.3


def _pieces(raw: bytes, size: int) -> list[bytes]:
    return [raw[i : i + size] for i in range(0, len(raw), size)]


class Scorer:
    """Dictionaries and curve; ``model`` is plain data, so that it can be broadcast or kept."""

    def __init__(self, model: dict):
        self.model = model
        self.by = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) if d else None for d in model["dicts"]]

    def difference(self, text: str) -> float:
        raw = text.encode()
        if not raw or None in self.by:
            return 0.0
        bad, good = (sum(len(c.compress(p)) for p in _pieces(raw, PIECE)) for c in self.by)
        return (bad - good) / len(raw)

    def score(self, text: str) -> float:
        z = self.model["slope"] * self.difference(text) + self.model["start"]
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _dictionary(texts: list[str]) -> bytes:
    """Trained on the texts' pieces; too few of them serve as they are; none gives no dictionary."""
    parts = [p for t in texts for p in _pieces(t.encode(), PIECE)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[:DICT_BYTES]


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one number by Newton's method, with a small ridge."""
    scale = float(np.abs(x).max()) or 1.0
    a = np.stack([x / scale, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), a.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]) / scale, float(w[1])


def _dictionaries(rows: list[tuple[str, int]]) -> list[bytes]:
    return [_dictionary([t for t, y in rows if y == q]) for q in (0, 1)]


def fit(rows: list[tuple[str, int]]) -> dict:
    """From (text, label) rows: the curve from each half's differences by the other half's dictionaries, then those of all."""
    halves = [rows[::2], rows[1::2]]
    if any(len({y for _, y in h}) < 2 for h in halves):  # too few to tell: the score is the share of good ones
        share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
        return {"dicts": [b"", b""], "slope": 0.0, "start": math.log(share / (1 - share))}
    x: list[float] = []
    for own, other in (halves, halves[::-1]):
        scorer = Scorer({"dicts": _dictionaries(other)})
        x += [scorer.difference(t) for t, _ in own]
    slope, start = _curve(np.array(x), np.array([y for h in halves for _, y in h], float))
    return {"dicts": _dictionaries(rows), "slope": slope, "start": start}


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int, chars: int) -> list[tuple[str, int]]:
    """Labelled texts of both classes, at most ``rows`` each, in an order by hash of the id."""
    h = F.xxhash64(pick(labels, id_col))
    chosen = None
    for q in (0, 1):
        part = labels.where(pick(labels, label_col) == q).select(pick(labels, id_col).alias("id"), F.lit(q).alias("q"), h.alias("h")).orderBy("h", "id").limit(rows)
        chosen = part if chosen is None else chosen.unionAll(part)
    found = docs.select(pick(docs, id_col).alias("id"), pick(docs, text_col).alias("t")).where(F.length("t").between(1, chars)).join(F.broadcast(chosen), "id")
    return [(r.t, r.q) for r in sorted(found.collect(), key=lambda r: (r.h, str(r.id), r.t))]


def score_quality(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher for label 1) of each row's whole text.

    Null and empty texts have no difference and get the curve's value at 0. Rows are independent, so repeated rows and ids
    repeat; an empty table gives no rows; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(sent.value)
        for b in slices(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(t.as_py() or "") for t in b.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, score double")


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict:
    return fit(sample(docs, labels, id_col, text_col, label_col, rows, chars))


def op9_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    scored = score_quality(docs, model)
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

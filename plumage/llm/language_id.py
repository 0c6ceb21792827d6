"""Language identification: first the family, then one-versus-one linear support vector machines inside it.

Features are hashed 2-, 3- and 4-grams of the text's bytes (ASCII letters folded to lower case, other ASCII to a space, all other bytes as they are). A
machine's margin is the mean weight of all grams of the whole text, so long and short texts are on one scale. Families
are told apart in the same way, by machines between each two families; a family's languages by machines between each two
of them, and only those of the chosen family count.

The fit uses about SAMPLE_ROWS rows of each language, picked by the hash of their id, of at most SAMPLE_CHARS characters
each, so it is bounded at any table size. Prediction maps batches: no shuffle, and nothing goes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import crc_mod, pick, slices, table

SAMPLE_ROWS = 600
SAMPLE_CHARS = 20_000
#: Training pieces of a machine's side, and their bytes.
PIECES = 8000
PIECE_BYTES = (16, 200)
EPOCHS = 4
SCALE = 12.0
UNKNOWN = "und"

#: Families of languages by ISO 639-1 code. Languages that aren't listed are families of their own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "is", "af"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl"],
    "slavic": ["ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"],
    "uralic": ["fi", "et", "hu"],
}

_FOLD = np.full(256, 0x20, np.uint32)
_FOLD[ord("a") : ord("z") + 1] = _FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_BITS = 17
_SIZE = 65_536 + 2 * (1 << _BITS)
_LETTER = regex.compile(r"\p{L}")


def grams(raw: bytes) -> np.ndarray:
    """Indices of the text's grams, all orders together; a space stands before and after the text."""
    b = _FOLD[np.frombuffer(b" " + raw + b"  ", np.uint8)]
    two = b[:-1] | (b[1:] << 8)
    three = two[:-1] | (b[2:] << 16)
    four = three[:-1] | (b[3:] << 24)
    mix = lambda x: (x * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
    return np.concatenate([two, mix(three) + np.uint32(65_536), mix(four) + np.uint32(65_536 + (1 << _BITS))])


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def train_machine(plus: list[np.ndarray], minus: list[np.ndarray], seed: int) -> tuple[np.ndarray, float]:
    """Averaged stochastic subgradient descent on the hinge loss with an L2 term."""
    rng = np.random.default_rng(seed)
    rows = [(x, 1.0) for x in plus] + [(x, -1.0) for x in minus]
    w, total, bias, bias_total, n = np.zeros(_SIZE), np.zeros(_SIZE), 0.0, 0.0, 0
    decay, rate = 1.0, 0.5  # w is kept divided by decay
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            n += 1
            eta = rate / (1 + n / (2 * len(rows)))
            decay *= 1 - 1e-5
            if y * (SCALE * decay * w[x].mean() + bias) < 1:
                step = eta * y * SCALE / len(x) / decay
                np.add.at(w, x, step)
                np.add.at(total, x, step * n)
                bias += 0.01 * eta * y
                bias_total += 0.01 * eta * y * n
    return ((w - total / (n + 1)) * decay * SCALE).astype(np.float32), float(bias - bias_total / (n + 1))


def fit(rows: list[tuple[str, str]]) -> dict:
    """From (text, lang) rows: languages, families, and a weight column and bias for each pair (first one wins if positive)."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(7)
    pieces: dict[str, list[np.ndarray]] = {}
    for lang in langs:
        cut = []
        for text, own in rows:
            raw, i = text.encode(), 0
            while own == lang and i < len(raw):
                size = int(rng.integers(*PIECE_BYTES))
                cut.append(raw[i : i + size])
                i += size
        pieces[lang] = [grams(cut[i]) for i in rng.permutation(len(cut))[:PIECES]]
    families: dict[str, list[str]] = {}
    for lang in langs:
        families.setdefault(family_of(lang), []).append(lang)
    pairs, columns, bias = [], [], []
    for kind, sides in [("family", families), *[(f, {x: [x] for x in xs}) for f, xs in families.items()]]:
        for a, b in combinations(sorted(sides), 2):
            each = lambda s: [p for lang in sides[s] for p in pieces[lang][: max(1, PIECES // len(sides[s]))]]
            w, c = train_machine(each(a), each(b), len(pairs))
            pairs.append((kind, a, b))
            columns.append(w)
            bias.append(c)
    weights = np.stack(columns, 1) if columns else np.zeros((_SIZE, 0), np.float32)
    return {"families": families, "pairs": pairs, "weights": weights, "bias": np.array(bias)}


class Predictor:
    def __init__(self, model: dict):
        self.model = model
        self.families = model["families"]

    def margins(self, text: str) -> np.ndarray:
        raw = text.encode()
        total, n = np.zeros(len(self.model["pairs"])), 0
        for i in range(0, len(raw), 1 << 18):  # all of a long text, a part at a time
            x = grams(raw[max(0, i - 3) : i + (1 << 18)])
            for k in range(0, len(x), 1 << 16):
                total += self.model["weights"][x[k : k + (1 << 16)]].sum(0, dtype=np.float64)
            n += len(x)
        return total / max(1, n) + self.model["bias"]

    def _best(self, kind: str, names: list[str], margins: np.ndarray) -> tuple[str, float]:
        """Most votes, then the larger share; a name's share is the mean of its pairs' logistic margins."""
        votes, share = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for (k, a, b), m in zip(self.model["pairs"], margins):
            if k == kind:
                p = 1 / (1 + np.exp(-np.clip(3 * m, -40, 40)))
                votes[a if m >= 0 else b] += 1
                share[a] += p
                share[b] += 1 - p
        best = max(names, key=lambda x: (votes[x], share[x]))
        return best, float(share[best]) / (len(names) - 1) if len(names) > 1 else 1.0

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.families or not _LETTER.search(text):
            return UNKNOWN, 0.0
        m = self.margins(text)
        family, p = self._best("family", sorted(self.families), m)
        lang, q = self._best(family, self.families[family], m)
        return lang, p * q


def sample(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, chars: int) -> list[tuple[str, str]]:
    """(text, lang) of about ``rows`` rows of each language, at most a tenth more over all, by hash of the id."""
    df = labelled.select(pick(labelled, id_col).alias("id"), pick(labelled, text_col).alias("t"), pick(labelled, lang_col).alias("g")).where("g is not null and t is not null and g <> 'und'")
    df = df.where(F.length("t").between(1, chars))
    counts = {r.g: r.n for r in df.groupBy("g").agg(F.count("*").alias("n")).collect()}  # one row for each language
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, rows / n))])
    h = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    picked = df.where(h < share[F.col("g")] * F.lit(float(1 << 30))).withColumn("h", h)
    found = picked.orderBy("h", "id", "g", "t").limit(int(rows * len(counts) * 1.1) + 1).collect()
    return [(r.t, r.g) for r in found]


def language_model(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict:
    return fit(sample(labelled, id_col, text_col, lang_col, rows, chars))


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) of each row's whole text.

    ``und`` with score 0 where the text is null, empty or has no letter, or where no language was learned. Rows are
    independent, so repeated rows and ids repeat; an empty table gives no rows; other columns play no part.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Predictor(sent.value)
        for b in slices(batches, 1):
            found = [p.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_model(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")

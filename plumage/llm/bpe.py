"""BPE encoding and decoding by speculation and verification.

A word's tokens are first guessed by greedy longest match. A sequence of tokens is what merging would give if and only
if no merge crosses a boundary between neighbours, so every adjacent pair of a batch of words is tested at once, in
arrays: both tokens are taken apart merge by merge, latest first, and at each step the merge across the boundary, if the
vocabulary has one, must come later than the merges that closed the two sides. Only words with a failing pair are merged
step by step. What was learned about words is kept in a bounded cache of the task.

Spark maps batches of rows; nothing is shuffled. The vocabulary file, a fixed size, is read on the driver and broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumage.llm.common import pick, slices, table

#: Words that a task remembers; beyond, it forgets all and goes on.
CACHE_WORDS = 400_000
#: Characters of text encoded at a time.
CHUNK_CHARS = 2_000_000
#: Texts of these characters only need no library call to be normalised: NFC keeps them, and white space is plain.
PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-įı-ž]")
END = "</w>"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the rest follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary in the JSON form of the tokenizers library, and the checks on it."""

    def __init__(self, raw: bytes):
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        self.check(spec)
        model = spec["model"]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.ids: dict[str, int] = model["vocab"]
        self.longest = max(len(t) - len(END) for t in self.ids if t.endswith(END))
        self.reach: dict[str, int] = {}  # length of the longest inner token that begins with four letters
        for t in self.ids:
            if not t.endswith(END):
                self.reach[t[:4]] = max(len(t), self.reach.get(t[:4], 3))
        self.strings = {i: t for t, i in self.ids.items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_rx = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.word_rx = regex.compile(split)
        self.letters = byte_letters()
        self.library = Tokenizer.from_str(raw.decode())
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank_of = {self.ids[a] << 32 | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made, self.never = [self.ids[a + b] for a, b in pairs], len(pairs)
        n = max(self.strings) + 1
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single letter
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys, ranks = np.array(list(self.rank_of), np.int64), np.arange(len(pairs))
        self.rank[self.made], self.left[self.made], self.right[self.made] = ranks, keys >> 32, keys & 0xFFFFFFFF
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        self.cache: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    @staticmethod
    def check(spec: dict) -> None:
        """Raises where the file asks for anything that this class doesn't do; its ids would be wrong without a sign."""
        model = spec.get("model", {})
        steps = [(x.get("type"), x.get("pattern"), x.get("content")) for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        found = {
            "a BPE model": model.get("type") == "BPE",
            f"words that end in {END}": model.get("end_of_word_suffix") == END,
            "no other model options": not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")),
            "NFC, white space to a space, lower case": steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)],
            "a pattern whose matches are words, then bytes": [x.get("type") for x in split] == ["Split", "ByteLevel"]
            and (split[0].get("behavior"), split[0].get("invert"), split[1].get("add_prefix_space"), split[1].get("use_regex")) == ("Removed", True, False, False),
            "special tokens matched as they stand": not any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")),
            "no decoder": spec.get("decoder") is None,
            "every letter of bytes, inside and at the end of words": all(c in model.get("vocab", {}) and c + END in model["vocab"] for c in byte_letters()),
        }
        if missing := [k for k, ok in found.items() if not ok]:
            raise ValueError(f"this vocabulary file doesn't have: {'; '.join(missing)}")

    def letters_of(self, word: str) -> str:
        return word if word.isascii() else "".join(map(self.letters.__getitem__, word.encode()))

    def guess(self, s: str) -> list[int]:
        """Greedy longest match over a word's byte letters."""
        ids, reach, longest, out, i, n = self.ids, self.reach, self.longest, [], 0, len(s)
        while True:
            found = ids.get(s[i:] + END) if n - i <= longest else None
            if found is not None:
                out.append(found)
                return out
            for j in range(min(n - 1, i + reach.get(s[i : i + 4], 3)), i, -1):
                found = ids.get(s[i:j])
                if found is not None:
                    out.append(found)
                    i = j
                    break

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a large number where there is none."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of neighbours (a, b) as it is."""
        a, b, ok = a.copy(), b.copy(), np.ones(len(a), bool)
        never = np.iinfo(np.int64).max
        a_closed, b_closed = np.full(len(a), never), np.full(len(b), never)  # ranks of the merges that took them in
        todo = np.arange(len(a))
        while len(todo):
            x, y = a[todo], b[todo]
            across = self.merge_rank(x, y)
            crossed = (across != never) & (across < a_closed[todo]) & (across <= b_closed[todo])
            ok[todo[crossed]] = False
            rx, ry = self.rank[x], self.rank[y]
            more = ~crossed & ((rx >= 0) | (ry >= 0))
            todo, x, y, rx, ry = todo[more], x[more], y[more], rx[more], ry[more]
            left = rx > ry  # of equal merges the right one came later
            a_closed[todo[left]], a[todo[left]] = rx[left], self.right[x[left]]
            b_closed[todo[~left]], b[todo[~left]] = ry[~left], self.left[y[~left]]
        return ok

    def merged(self, s: str) -> list[int]:
        """Exact merging of one word: the lowest rank first, the leftmost of equals first."""
        get, never, made = self.rank_of.get, self.never, self.made
        parts = [self.ids[c] for c in s[:-1]] + [self.ids[s[-1] + END]]
        ranks = [get(a << 32 | b, never) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) < never:
            i = ranks.index(low)
            parts[i : i + 2] = [made[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] << 32 | parts[i], never)
            if i < len(ranks):
                ranks[i] = get(parts[i] << 32 | parts[i + 1], never)
        return parts

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Token ids of words, given as their byte letters."""
        if not words:
            return []
        found = [self.guess(w) for w in words]
        sizes = np.array([len(x) for x in found])
        flat = np.fromiter((t for x in found for t in x), np.int64, int(sizes.sum()))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        at = np.nonzero(inner)[0]  # second tokens of pairs
        pairs, where = np.unique((flat[at - 1] << 32) | flat[at], return_inverse=True)
        good = np.ones(len(flat), bool)
        good[at] = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[where]
        for i in np.nonzero(~np.logical_and.reduceat(good, starts))[0]:
            found[i] = self.merged(words[i])
        return found

    def learn(self, pieces: list[str], split) -> None:
        """Fills the caches for pieces of text without white space."""
        parts = [split(p) for p in pieces]
        words = list({w for p in parts for w in p})
        ids = dict(zip(words, self.encode_words(words)))
        for piece, p in zip(pieces, parts):
            found = [i for w in p for i in ids[w]]
            self.cache[piece] = " ".join(map(str, found))
            self.decoded[piece] = " ".join(self.strings[i] for i in found)

    def split_plain(self, piece: str) -> list[str]:
        return [self.letters_of(w) for w in self.word_rx.findall(piece)]

    def split_by_library(self, piece: str) -> list[str]:
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece)]

    def pieces(self, text: str) -> list[str]:
        """Keys of the caches for a text, in order. A key that starts with a space is split by the library."""
        out: list[str] = []
        for k, part in enumerate(self.special_rx.split(text) if self.special_rx else [text]):
            if k % 2:
                if part not in self.cache:
                    self.cache[part], self.decoded[part] = str(self.special[part]), part
                out.append(part)
            elif PLAIN.search(part) is None:
                out += part.lower().split()
            elif part:
                out += [" " + x for x in self.library.normalizer.normalize_str(part).split(" ") if x]
        return out

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """(decimal ids joined by a space, decoded text) of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.decoded.clear()
        keys = [self.pieces(t) for t in texts]
        new = {w for k in keys for w in k}.difference(self.cache)
        self.learn([w for w in new if w[0] != " "], self.split_plain)
        self.learn([w for w in new if w[0] == " "], lambda w: self.split_by_library(w[1:]))
        for k in keys:  # a piece that gives no token adds nothing, not even a space
            yield " ".join(filter(None, map(self.cache.__getitem__, k))), " ".join(filter(None, map(self.decoded.__getitem__, k)))


def _chunks(texts: list[str | None], most: int) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(raw: bytes) -> Vocabulary:
    """Built once in a Python worker."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """Token ids and decoded text of each row's whole text: doc_id, n_tokens, ids (decimal, space-joined), decoded.

    With ``digest`` the last two are replaced by their SHA-256: ids_sha256, decoded_sha256. Null and empty texts have no
    tokens. Rows are independent, so repeated rows and ids repeat; an empty table gives no rows; other columns of
    ``docs`` play no part.
    """
    with open(vocab_path, "rb") as f:
        raw = f.read()
    Vocabulary.check(json.loads(raw))
    vocab = docs.sparkSession.sparkContext.broadcast(raw)
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"]
    put = (lambda s: hashlib.sha256(s.encode()).hexdigest()) if digest else (lambda s: s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(vocab.value)
        for batch in slices(batches, 1):
            n, ids, decoded = [], [], []
            for texts in _chunks(batch.column(1).to_pylist(), CHUNK_CHARS):
                for a, b in v.encode(texts):
                    n.append(a.count(" ") + 1 if a else 0)
                    ids.append(put(a))
                    decoded.append(put(b))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", *names])

    source = docs.select(pick(docs, id_col).alias("doc_id"), pick(docs, text_col).cast("string").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, {names[0]} string, {names[1]} string")


def bpe_decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids") -> DataFrame:
    """Adds ``decoded`` for decimal, space-joined ids, special tokens included. Null ids give an empty text."""
    with open(vocab_path, "rb") as f:
        vocab = encoded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(ids):
        strings = _vocabulary(vocab.value).strings
        return ids.map(lambda s: " ".join(strings[int(i)] for i in s.split()) if s else "")

    return encoded.withColumn("decoded", decode(encoded[ids_col]))


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)

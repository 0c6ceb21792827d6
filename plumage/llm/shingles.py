"""Words and shingles of raw texts as arrays of 64-bit hashes, for use inside tasks."""

from __future__ import annotations

import re

import numpy as np

_SEPARATOR = re.compile(rb"[\x20\x09-\x0d]")
_IS_SEP = np.zeros(256, bool)
_IS_SEP[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_CHUNK = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0xD1342543DE82EF95)


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _BASE, np.uint64)]))


_POWERS = _powers(64)


def _hashes(raw: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    b = np.frombuffer(raw, np.uint8)
    sep = _IS_SEP[b]
    edge = np.diff(np.concatenate([[True], sep, [True]]).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    sizes = ends - starts
    inside = np.flatnonzero(~sep)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    powers = _POWERS if sizes.max() <= len(_POWERS) else _powers(int(sizes.max()))
    value = _BYTE[(_LOWER[b] if fold else b)[inside]] * powers[place]
    return mix(np.add.reduceat(value, first) + sizes.astype(np.uint64)), starts, ends


def word_hashes(raw: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (in bytes) of each word; with ``fold``, A-Z count as a-z. Long texts go part by part."""
    if len(raw) <= _CHUNK:
        return _hashes(raw, fold)
    parts, at = [], 0
    while at < len(raw):
        cut = _SEPARATOR.search(raw, at + _CHUNK)
        end = cut.start() if cut else len(raw)
        h, s, e = _hashes(raw[at:end], fold)
        parts.append((h, s + at, e + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts))


def word_hashes_many(raws: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The same for several texts at once: hash, start and end in its own text, and number of the text, of each word."""
    h, s, e = word_hashes(b"\n".join(raws), fold)
    begin = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
    which = np.searchsorted(begin, s, "right") - 1
    return h, s - begin[which], e - begin[which], which


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for p, power in zip(range(k), _powers(k) if k > len(_POWERS) else _POWERS):
        total += h[p : p + n] * power
    return mix(total)


def shingle_set(raw: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles, folded; of the whole sequence if it is shorter."""
    h, _, _ = word_hashes(raw, True)
    return np.unique(rolled(h, min(k, len(h)) or 1) + np.uint64(min(k, len(h))))

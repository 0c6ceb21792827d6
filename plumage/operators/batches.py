"""Arrow batches of rows that lie group by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    """Where another group of equal keys begins."""
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        codes = t[k].combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(new)


def unsplit(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows, no batch ending inside a group of equal keys."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        at = starts(t, keys)
        same = held and held[-1].select(keys).slice(held[-1].num_rows - 1).equals(t.select(keys).slice(0, 1))
        last = int(at[-1])
        if last or (held and not same):  # what is held and all but the last group are whole
            yield from pa.concat_tables([*held, t.slice(0, last)]).combine_chunks().to_batches()
            held = []
        held.append(t.slice(last))
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()

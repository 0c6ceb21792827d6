"""Order-dependent operators on the boxes of a page: reading order and merging.

Each depends on the order of its own intermediate results, which no join expresses. Spark brings a page's rows together,
sorted, and a small function folds each page; a page is a detector's output, at most some hundred boxes. Rows are streamed,
so a task holds a batch of them, or one page. Reading order cuts the pages of a batch all at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumage.operators.batches import starts, unsplit

Box = tuple[float, float, float, float]


def _numbers(t: pa.RecordBatch, column: str) -> np.ndarray:
    return t[column].to_numpy(zero_copy_only=False)


def by_pages(df: DataFrame, columns: list[str]) -> DataFrame:
    """(page_id, columns): the rows of a page in one partition, next to each other, in the order of the columns.

    The page's row numbers, _k, ask for no other shuffle where rows lie by page already.
    """
    rows = df.select("page_id", *columns).withColumn("_k", F.row_number().over(Window.partitionBy("page_id").orderBy(*columns)))
    return rows.sortWithinPartitions("page_id", *columns)


def fold_batches(df: DataFrame, columns: list[str], schema: str, fold: Callable[[list[list[tuple]]], Iterator[tuple[int, list[tuple]]]]) -> DataFrame:
    """fold(rows of each page, in order of their columns) gives (number of the page, its output rows without the page), for a batch's whole pages at once."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = [{"int": pa.int32(), "string": pa.string()}[kind] for _, kind in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in unsplit(batches, ["page_id"]):
            begin = starts(pa.Table.from_batches([t]), ["page_id"]).tolist()
            rows = list(zip(*[t[c].to_pylist() if pa.types.is_string(t[c].type) else _numbers(t, c).tolist() for c in columns]))
            at, out = [], []
            for page, found in fold([rows[i:j] for i, j in zip(begin, [*begin[1:], len(rows)])]):
                at += [begin[page]] * len(found)
                out += found
            data = [t["page_id"].take(pa.array(at, pa.int64())), *[pa.array(c, kind) for c, kind in zip(zip(*out) if out else [[]] * len(kinds), kinds)]]
            yield pa.RecordBatch.from_arrays(data, ["page_id", *[name for name, _ in fields]])

    return by_pages(df, columns).mapInArrow(run, f"page_id {dict(df.dtypes)['page_id']}, {schema}")


def fold_pages(df: DataFrame, columns: list[str], schema: str, fold: Callable[[list[tuple]], list[tuple]]) -> DataFrame:
    """fold(rows of a page, in order of their columns) gives the page's output rows, without the page."""
    return fold_batches(df, columns, schema, lambda pages: ((k, fold(rows)) for k, rows in enumerate(pages)))


def area(b: Box) -> float:
    return max(0, b[2] - b[0]) * max(0, b[3] - b[1])


def shared(a: Box, b: Box) -> float:
    return max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))


def hull(a: Box, b: Box) -> Box:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def iou(a: Box, b: Box) -> float:
    union = area(a) + area(b) - shared(a, b)
    return shared(a, b) / union if union > 0 else 0.0


def widest_gap(spans: list[tuple[float, float]], least: float) -> tuple[float, float] | None:
    best, reach = None, None
    for low, high in sorted(spans):
        if reach is not None and low - reach >= least and low > reach and (best is None or low - reach > best[1] - best[0]):
            best = (reach, low)
        reach = high if reach is None else max(reach, high)
    return best


def reading_order(boxes: list[Box], rtl: bool) -> list[int]:
    """Indices in reading order, by recursive cuts along the widest free stretch.

    Sizes are judged against the page's upper medians: gaps of 15 % of a width (10 at least) or 10 % of a height (8 at
    least) count. A horizontal cut wins over a vertical one if it is wider than 12 or than 0.4 of the other. Without a cut,
    rows of four height gaps are read one by one.
    """
    if len(boxes) < 2:
        return list(range(len(boxes)))
    middle = len(boxes) // 2
    gap_x = max(0.15 * max(1, sorted(b[2] - b[0] for b in boxes)[middle]), 10)
    gap_y = max(0.10 * max(1, sorted(b[3] - b[1] for b in boxes)[middle]), 8)
    side = -1 if rtl else 1

    def visit(part: list[int]) -> list[int]:
        if len(part) < 2:
            return part
        gx = widest_gap([(boxes[i][0], boxes[i][2]) for i in part], gap_x)
        gy = widest_gap([(boxes[i][1], boxes[i][3]) for i in part], gap_y)
        if not gx and not gy:
            return sorted(part, key=lambda i: (boxes[i][1] // (gap_y * 4), side * boxes[i][0]))
        across = gy and (not gx or gy[1] - gy[0] > 12 or gy[1] - gy[0] > 0.4 * (gx[1] - gx[0]))
        at = sum(gy if across else gx) / 2
        k, sign = (1, 1) if across else (0, side)
        first = [i for i in part if sign * ((boxes[i][k] + boxes[i][k + 2]) / 2 - at) <= 0]
        second = [i for i in part if sign * ((boxes[i][k] + boxes[i][k + 2]) / 2 - at) > 0]
        if not first or not second:
            return sorted(part, key=lambda i: side * boxes[i][0])
        return visit(first) + visit(second)

    return visit(list(range(len(boxes))))


def _widest(part: np.ndarray, low: np.ndarray, high: np.ndarray, least: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(size, middle) of ``widest_gap`` in each of n parts; no size where there is none. Parts lie one after the other."""
    order = np.lexsort((high, low, part))
    low, reach = low[order], high[order]
    k, most = 1, int(np.bincount(part).max())
    while k < most:  # the highest end so far in its part
        reach[k:] = np.where(part[k:] == part[:-k], np.maximum(reach[k:], reach[:-k]), reach[k:])
        k *= 2
    at = np.flatnonzero(part[1:] == part[:-1]) + 1
    gap, here = low[at] - reach[at - 1], part[at]
    wide = (gap >= least[here]) & (gap > 0)
    at, gap, here = at[wide], gap[wide], here[wide]
    first = np.lexsort((at, -gap, here))
    first = first[np.append(True, np.diff(here[first]) != 0)[: len(first)]]
    size, middle = np.full(n, np.nan), np.zeros(n)
    size[here[first]], middle[here[first]] = gap[first], (low[at[first]] + reach[at[first] - 1]) / 2
    return size, middle


def reading_positions(page: np.ndarray, x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, rtl: bool) -> np.ndarray:
    """Each box's place in ``reading_order``, of all pages (0, 1, ..., in order) at once: every round cuts all parts that can be cut."""
    n, side = len(page), -1 if rtl else 1
    begin = np.searchsorted(page, np.arange(int(page[-1]) + 1 if n else 0))
    middle = begin + np.diff(np.append(begin, n)) // 2
    upper = lambda v: np.maximum(1, v[np.lexsort((v, page))][middle])
    gap_x, gap_y = np.maximum(0.15 * upper(x2 - x1), 10)[page], np.maximum(0.10 * upper(y2 - y1), 8)[page]
    order, place, part = np.arange(n), np.arange(n), page  # the boxes in order; of those in open parts: where they are there, and their part
    while len(place):
        new = np.append(True, np.diff(part) != 0)
        part = np.cumsum(new) - 1
        many = np.bincount(part)[part] > 1
        place, part, new = place[many], part[many], new[many]
        if not len(place):
            break
        part, b = np.cumsum(new) - 1, order[place]
        count, head = int(part[-1]) + 1, b[new]
        (wide, at_x), (tall, at_y) = _widest(part, x1[b], x2[b], gap_x[head], count), _widest(part, y1[b], y2[b], gap_y[head], count)
        none = np.isnan(wide) & np.isnan(tall)
        across = ~np.isnan(tall) & (np.isnan(wide) | (tall > 12) | (tall > 0.4 * wide))
        far = np.where(across[part], (y1[b] + y2[b]) / 2 - at_y[part], side * ((x1[b] + x2[b]) / 2 - at_x[part]))
        second = far > 0
        seconds = np.bincount(part, second, minlength=count)
        stuck = ~none & ((seconds == 0) | (seconds == np.bincount(part)))
        done = none | stuck
        band = np.where(none[part], y1[b] // (gap_y[b] * 4), 0)
        ends = done[part]
        to = np.lexsort((np.where(ends, side * x1[b], 0), np.where(ends, band, second), part))
        order[place] = b[to]
        place, part = place[~ends], (2 * part + second)[to][~ends]
    position = np.empty(n, np.int32)
    position[order] = np.arange(n) - begin[page]
    return position


def in_reading_order(boxes: DataFrame, rtl: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, box_id, position, columns to keep)."""
    columns = ["box_id", "x1", "y1", "x2", "y2"]
    more = [c for c in keep if c not in columns]
    names = ["page_id", "box_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in unsplit(batches, ["page_id"]):
            new = np.zeros(t.num_rows, np.int64)
            new[starts(pa.Table.from_batches([t]), ["page_id"])[1:]] = 1
            found = reading_positions(np.cumsum(new), *[_numbers(t, c).astype(np.float64) for c in columns[1:]], rtl)
            yield pa.RecordBatch.from_arrays([*[t[c] for c in names], pa.array(found)], [*names, "position"])

    kinds = dict(boxes.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", position int"
    return by_pages(boxes, [*columns, *more]).mapInArrow(run, schema).select("page_id", "box_id", "position", *keep)


#: What ``in_order`` gives of a page's boxes.
ORDERED = "position int, score int, x1 int, y1 int, x2 int, y2 int"


def in_order(pages: list[list[tuple[float, Box]]], rtl: bool) -> Iterator[tuple[int, list[tuple]]]:
    """(number of the page, its boxes as ORDERED) of pages of scores and boxes."""
    full = [k for k, rows in enumerate(pages) if rows]
    sides = np.array([b for k in full for _, b in pages[k]], float).reshape(-1, 4)
    places = iter(reading_positions(np.repeat(np.arange(len(full)), [len(pages[k]) for k in full]), *sides.T, rtl).tolist())
    for k in full:
        yield k, [(next(places), int(s), *map(int, b)) for s, b in pages[k]]


def united_windows(windows: list[Box]) -> list[Box]:
    """Windows that touch are united until none touch; a united window may touch new ones."""
    done: list[Box] = []
    for w in sorted(windows):
        while (hit := next((k for k, d in enumerate(done) if d[0] <= w[2] and w[0] <= d[2] and d[1] <= w[3] and w[1] <= d[3]), None)) is not None:
            w = hull(done[hit], w)
            done[hit] = done[-1]
            done.pop()
        done.append(w)
    return sorted(done)


def window_union(boxes: DataFrame) -> DataFrame:
    return fold_pages(boxes, ["x1", "y1", "x2", "y2"], "x1 int, y1 int, x2 int, y2 int", lambda rows: [tuple(map(int, b)) for b in united_windows(rows)])


def _held(outer: Box, inner: Box, share: float) -> bool:
    return 0 < area(inner) <= area(outer) and shared(outer, inner) / area(inner) >= share


def merged_regions(rows: list[tuple[float, Box]], alike: float = 0.5, inside: float = 0.3) -> list[tuple[float, Box]]:
    """Takes the last region, lets it absorb all others that overlap it as it grows, in one pass, and goes on with the rest."""
    todo, out = list(rows), []
    while todo:
        score, b = todo.pop()
        k = 0
        while k < len(todo):
            s, c = todo[k]
            if iou(b, c) >= alike or _held(b, c, inside) or _held(c, b, inside):
                score, b = max(score, s), hull(b, c)
                todo[k] = todo[-1]  # the last one takes the free place, and is looked at next
                todo.pop()
            else:
                k += 1
        out.append((score, b))
    return out


def _with_numbers(schema: str, numbered: bool) -> str:
    return f"box_id int, {schema}" if numbered else schema


def merge_regions(boxes: DataFrame, numbered: bool = False) -> DataFrame:
    """Text regions of a page merged where they overlap; regions are taken in order of their number. ``numbered`` adds the order they come out in, from 1, as box_id."""

    def fold(rows: list[tuple]) -> list[tuple]:
        return [(*[k][:numbered], int(s), *map(int, b)) for k, (s, b) in enumerate(merged_regions([(r[1], r[2:]) for r in rows]), 1)]

    return fold_pages(boxes, ["box_id", "score", "x1", "y1", "x2", "y2"], _with_numbers("score int, x1 int, y1 int, x2 int, y2 int", numbered), fold)


def merged_in_order(boxes: DataFrame, rtl: bool = True) -> DataFrame:
    """(page_id, position, score, x1, y1, x2, y2): ``merge_regions`` in reading order, boxes that it leaves open by place; a page is one fold."""

    def fold(pages: list[list[tuple]]) -> Iterator[tuple[int, list[tuple]]]:
        merged = [merged_regions([(r[1], r[2:]) for r in rows]) for rows in pages]
        return in_order([sorted(rows, key=lambda r: (r[1][1], r[1][0], r[1][2], r[1][3], r[0])) for rows in merged], rtl)

    return fold_batches(boxes, ["box_id", "score", "x1", "y1", "x2", "y2"], ORDERED, fold)


def _joined(a: Box, b: Box, height: float) -> Box | None:
    """The box that two detections of one label become, or None if they stay two."""
    if min(a[2], b[2]) <= max(a[0], b[0]):
        return None  # nothing shared, and no width in common
    small = min(area(a), area(b))
    if small > 0 and shared(a, b) / small >= 0.85:
        return a if area(a) >= area(b) else b
    if iou(a, b) >= 0.5:
        return b if area(b) > area(a) else a
    wide, tall = [max(1, x[2] - x[0]) for x in (a, b)], [max(1, x[3] - x[1]) for x in (a, b)]
    far = min(abs(a[1] - b[3]), abs(a[3] - b[1]))
    along = max(0, min(a[2], b[2]) - max(a[0], b[0])) / min(wide)
    near = far < min(0.1 * height, 0.1 * max(tall)) and along > 0.2 and small / max(area(a), area(b), 1e-9) > 0.3
    level = abs(a[0] - b[0]) < 0.5 * max(wide) and abs(a[2] - b[2]) < 0.5 * max(wide)
    whole = hull(a, b)
    return whole if near and level and area(whole) <= 3 * max(area(a), area(b)) else None


def merged_slices(rows: list[tuple[str, float, Box]], height: float) -> list[tuple[str, float, Box]]:
    """Detections of overlapping slices: each absorbs later ones of its label that contain, equal or continue it."""
    out = list(rows)
    i = 0
    while i < len(out):
        j = i + 1
        while j < len(out):
            (label, s, a), (other, t, b) = out[i], out[j]
            whole = _joined(a, b, height) if label == other else None
            if whole is None:
                j += 1
                continue
            out[i] = (label, max(s, t), whole)
            out[j] = out[-1]
            out.pop()
        i += 1
    return out


def merge_slices(boxes: DataFrame, height: int, numbered: bool = False) -> DataFrame:
    """Detections of a page's slices, in order of their number, merged label by label. ``numbered`` as for merge_regions."""

    def fold(rows: list[tuple]) -> list[tuple]:
        return [(*[k][:numbered], label, int(s), *map(int, b)) for k, (label, s, b) in enumerate(merged_slices([(r[1], r[2], r[3:]) for r in rows], height), 1)]

    return fold_pages(boxes, ["box_id", "label", "score", "x1", "y1", "x2", "y2"], _with_numbers("label string, score int, x1 int, y1 int, x2 int, y2 int", numbered), fold)

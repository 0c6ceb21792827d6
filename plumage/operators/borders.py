"""Borders of labelled areas, followed in stacks of tiles.

Every side of a place that has no neighbour of its label there is an edge, and the edge that follows it (around the outside, to the
left, or straight on, or around the corner) follows from the eight neighbours alone. Edges are ranked along their line by doubling, all
lines of a stack at once: a ring inside its tile, or the stretch of one from where it enters the tile to where it leaves it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Steps (x, y) to a place's neighbours, from the left one on, downwards.
AROUND = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]


@dataclass
class Lines:
    """Lines of a stack of h x w tiles. Places are flat numbers, an edge is its place times four plus its side (left, below, right, above)."""

    head: np.ndarray  #: each line's first edge
    to: np.ndarray  #: the edge that follows its last one, in another tile; -1 for rings
    first: np.ndarray  #: its lowest edge, where a ring's head is
    before: np.ndarray  #: moves from the head to the lowest edge
    moves: np.ndarray  #: steps from a place to another, one for each point
    start: np.ndarray  #: where its points begin
    point: np.ndarray  #: the places that lines step from, line by line
    beyond: np.ndarray  #: the places that they step to


def lines(stack: np.ndarray) -> Lines:
    """All lines but those around holes; places of the outermost rows and columns are seen, not followed."""
    _, h, w = stack.shape
    flat = stack.reshape(-1)
    steps = np.array([dy * w + dx for dx, dy in AROUND])
    own = stack > 0
    own[:, [0, -1]] = False
    own[:, :, [0, -1]] = False
    p = np.flatnonzero(own)
    v = flat[p]
    free = np.stack([flat[p + steps[2 * k]] != v for k in range(4)], 1)
    rim = free.any(1)
    p, v, free = p[rim], v[rim], free[rim]
    number = np.full(flat.size, -1, np.int32)
    number[p] = np.arange(len(p), dtype=np.int32)
    edge = (np.cumsum(free.reshape(-1), dtype=np.int32) - 1).reshape(-1, 4)
    i, side = np.nonzero(free)
    place, v = p[i], v[i]
    around, on = place + steps[2 * side + 1], place + steps[(2 * side + 2) % 8]
    bend, straight = flat[around] == v, flat[on] == v
    to = np.where(bend, around, np.where(straight, on, place))
    turn = np.where(bend, side + 3, np.where(straight, side, side + 1)) % 4
    at = number[to]
    after = np.where(at < 0, -1, edge[at, turn])

    count = len(place)
    name, rank = np.empty(count, np.int32), np.empty(count, np.int32)
    ends = after < 0
    is_open = np.zeros(count, bool)
    if ends.any():  # after k rounds an edge knows the end of its line, or the edge 2^k from it on
        jump, dist = np.where(ends, np.arange(count), after), (~ends).astype(np.int32)
        is_open = ends[jump]
        while True:
            dist, jump = dist + dist[jump], jump[jump]
            now = ends[jump]
            if now.sum() == is_open.sum():
                break
            is_open = now
        last = jump[is_open]
        name[is_open], rank[is_open] = last, np.bincount(last, minlength=count)[last] - 1 - dist[is_open]
    closed = np.flatnonzero(~is_open)
    if len(closed):  # after k rounds an edge knows the lowest of the 2^k from it on, and how far it is
        short = np.empty(count, np.int32)
        short[closed] = np.arange(len(closed), dtype=np.int32)
        jump = short[after[closed]]
        low, off, k = np.arange(len(closed), dtype=np.int32), np.zeros(len(closed), np.int32), 1
        while ((ahead := low[jump]) != low).any():
            less = ahead < low
            off, low = np.where(less, off[jump] + np.int32(k), off), np.minimum(low, ahead)
            jump, k = jump[jump], 2 * k
        length = np.bincount(low, minlength=len(closed))[low]
        name[closed], rank[closed] = closed[low], (length - off) % length

    size = np.bincount(name, minlength=count)
    at = np.cumsum(size) - size
    order = np.empty(count, np.int64)
    order[at[name] + rank] = np.arange(count)
    line = np.flatnonzero(size)
    begin = at[line]
    lowest = np.minimum.reduceat(order, begin) if len(line) else line
    tail = order[begin + size[line] - 1]
    moving = (to != place)[order]
    passed = np.append(0, np.cumsum(moving))
    moves = passed[begin + size[line]] - passed[begin]
    good = (moves > 0) & (is_open[tail] | (side[lowest] == 0))  # a ring whose lowest edge isn't a left one runs around a hole
    kept = moving & np.repeat(good, size[line])
    line, begin, lowest, tail, moves = line[good], begin[good], lowest[good], tail[good], moves[good]
    code = lambda e: place[e] * 4 + side[e]
    return Lines(
        head=code(order[begin]), to=np.where(is_open[tail], to[tail] * 4 + turn[tail], -1), first=code(lowest), before=passed[begin + rank[lowest]] - passed[begin],
        moves=moves, start=np.cumsum(moves) - moves, point=place[order[kept]], beyond=to[order[kept]],
    )


def sums(values: np.ndarray, found: Lines) -> np.ndarray:
    """The sum of each line's points' values."""
    total = np.append(0, np.cumsum(values))
    return total[found.start + found.moves] - total[found.start]


def largest(stack: np.ndarray, found: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(which rings enclose the most in their tile and label, of equal ones the first; the points of those): none under four points or without area."""
    _, h, w = stack.shape
    x, y, nx, ny = found.point % w, found.point // w, found.beyond % w, found.beyond // w
    area = np.abs(sums(x * ny - nx * y, found))
    tile, label = found.first // (4 * h * w), stack.reshape(-1)[found.first // 4]
    order = np.lexsort((found.first, -area, label, tile))
    new = np.append(True, (np.diff(tile[order]) != 0) | (np.diff(label[order]) != 0))[: len(order)]
    best = order[new]
    best = np.sort(best[(area[best] > 0) & (found.moves[best] >= 4)])
    chosen = np.zeros(len(area), bool)
    chosen[best] = True
    return best, np.flatnonzero(np.repeat(chosen, found.moves))

"""Lines, cells and tables of many pages at once, in numpy.

A page is a number here; rows of all pages lie in the same arrays, and no step
loops over pages. Steps sort, or look up places in what is sorted.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: How far lines and ends may be apart and count as one, and the least length of a stroke.
SNAP, LENGTH = 2.0, 4.0
#: Pairs looked at together, about.
PAIRS = 1 << 21


class Boxes(NamedTuple):
    page: np.ndarray
    x0: np.ndarray
    y0: np.ndarray
    x1: np.ndarray
    y1: np.ndarray


def changes(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows have other keys than the row before."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def keyed(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Numbers that are ordered by group, then by value: numpy orders complex ones so."""
    out = np.empty(len(value), complex)
    out.real, out.imag = group, value
    return out


def spread(first: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All (i, j) with first[i] <= j < end[i], about PAIRS at a time."""
    n = np.maximum(end - first, 0)
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        done = ends[at] - n[at]
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        i = np.repeat(np.arange(at, to), n[at:to])
        yield i, np.arange(done, ends[to - 1]) + (first - ends + n)[i]
        at = to


def shorter(ways: list[tuple]) -> Iterator[tuple[int, tuple[np.ndarray, np.ndarray]]]:
    """Pairs from the first or the second way, (page, first, end), by page the one that has fewer to look at."""
    pages = max(int(page.max(initial=-1)) for page, _, _ in ways) + 1
    one, two = (np.bincount(page, end - first, minlength=pages) for page, first, end in ways)
    for k, taken in enumerate((one <= two, one > two)):
        page, first, end = ways[k]
        for pairs in spread(first, np.where(taken[page], end, first)):
            yield k, pairs


def chained(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of a group that touch or overlap make a run: rows by run, whether each begins one, and how far all up to it reach."""
    by = np.lexsort((high, low, group))
    group, low = group[by], low[by]
    reach = np.maximum.accumulate(keyed(group, high[by])).imag
    new = changes(group)
    new[1:] |= low[1:] > reach[:-1] + SNAP
    return by, new, reach


def lines(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(group, at, low, high) of the lines that strokes draw, sorted; level ones are group 2 * page, uprights the next. Boxes of a width give their sides."""
    x0, y0, x1, y1 = np.minimum(x0, x1), np.minimum(y0, y1), np.maximum(x0, x1), np.maximum(y0, y1)
    wide, tall = x1 - x0 > LENGTH, y1 - y0 > LENGTH
    box, level, upright = wide & tall, wide & (y1 - y0 <= SNAP), tall & (x1 - x0 <= SNAP)
    drawn = ((0, box, y0, x0, x1), (0, box, y1, x0, x1), (0, level, (y0 + y1) / 2, x0, x1), (1, box, x0, y0, y1), (1, box, x1, y0, y1), (1, upright, (x0 + x1) / 2, y0, y1))
    group, at, low, high = (np.concatenate(c) for c in zip(*((2 * page[k] + side, a[k], s[k], e[k]) for side, k, a, s, e in drawn), strict=True))
    by = np.lexsort((at, group))
    group, at, low, high = group[by], at[by] + 0.0, low[by], high[by]
    # Lines near each other lie where the first of them does; a new one begins after a gap.
    new = changes(group)
    new[1:] |= at[1:] - at[:-1] > SNAP
    line = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    by, new, reach = chained(line, low, high)
    line, low = line[by][new], low[by][new]
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return group[first][line], at[first][line], low, reach[last[: len(low)]]


def crossings(group: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, ...]:
    """(page, x, y, flags) by page, y and x; flags tell for each crossing whether lines go on up, down, left and right of it."""
    page, low, high, far = group >> 1, low - SNAP, high + SNAP, 2 * SNAP  # a line that ends here was made longer by SNAP
    h, v = np.flatnonzero(group % 2 == 0), np.flatnonzero(group % 2)
    ways = []
    for own, other in ((h, v), (v, h)):
        places = keyed(page[other], at[other])
        ways.append((page[own], np.searchsorted(places, keyed(page[own], low[own]), "left"), np.searchsorted(places, keyed(page[own], high[own]), "right")))
    met = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros((4, 0), bool))]
    for k, (i, j) in shorter(ways):
        i, j = (h[i], v[j]) if k == 0 else (h[j], v[i])
        meet = (at[i] >= low[j]) & (at[i] <= high[j]) & (at[j] >= low[i]) & (at[j] <= high[i])
        i, j = i[meet], j[meet]
        x, y = at[j], at[i]
        met.append((page[i], x, y, np.stack([y - low[j] > far, high[j] - y > far, x - low[i] > far, high[i] - x > far])))
    page, x, y = (np.concatenate([m[k] for m in met]) for k in range(3))
    flags = np.concatenate([m[3] for m in met], axis=1)
    by = np.lexsort((x, y, page))
    first = np.flatnonzero(changes(page[by], y[by], x[by]))
    flags = np.logical_or.reduceat(flags[:, by], first, axis=1) if len(by) else flags
    by = by[first]
    return page[by], x[by], y[by], flags


def following(flag: np.ndarray, group: np.ndarray, by: np.ndarray) -> np.ndarray:
    """In the order ``by``, the next row after each of its group that has the flag; -1 if none has."""
    n = len(by)
    at = np.append(np.where(flag[by], np.arange(n), n), n)
    after = np.minimum.accumulate(at[::-1])[::-1][1:]
    out = np.full(n, -1)
    known = after < n
    known[known] = group[by[after[known]]] == group[by[known]]
    out[by[known]] = by[after[known]]
    return out


def cells(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> Boxes:
    """The cells that strokes draw.

    A cell's upper left corner has a corner to the right and one below, and those two
    have the same corner opposite: below the one, to the right of the other.
    """
    page, x, y, (up, down, left, right) = crossings(*lines(page, x0, y0, x1, y1))
    rows, by_column = np.arange(len(page)), np.lexsort((y, x, page))
    level = np.cumsum(changes(page, y))
    upright = np.empty(len(page), np.int64)
    upright[by_column] = np.cumsum(changes(page[by_column], x[by_column]))
    # From each crossing whose line goes on to the next one, of those whose other line goes to the edge's inner side.
    top, side = following(down, level, rows), following(right, upright, by_column)
    below = np.where(left & down, following(left, upright, by_column), -1)
    beside = np.where(up & right, following(up, level, rows), -1)
    box = np.flatnonzero(right & down & (top >= 0) & (side >= 0))
    box = box[(below[top[box]] >= 0) & (beside[side[box]] >= 0)]
    box = box[below[top[box]] == beside[side[box]]]
    return Boxes(page[box], x[box], y[box], x[top[box]], y[side[box]])


def ranks(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Dense ranks of the values within their group, from 0."""
    by = np.lexsort((value, group))
    group, value = group[by], value[by]
    number = np.cumsum(changes(group, value))
    out = np.empty(len(by), np.int64)
    out[by] = number - np.maximum.accumulate(np.where(changes(group), number, 0))
    return out


def tables(boxes: Boxes) -> np.ndarray:
    """Numbers of the boxes' tables, by page, from above and then from the left: tables are parted by gaps in height, in width, and in height again."""
    part = boxes.page
    for low, high in ((boxes.y0, boxes.y1), (boxes.x0, boxes.x1), (boxes.y0, boxes.y1)):
        by, new, _ = chained(part, low, high)
        part = np.empty(len(by), np.int64)
        part[by] = np.cumsum(new) - 1
    return part


def holding(boxes: Boxes, page: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(box, point) of the points in boxes; upper and left edges belong to a box.

    Boxes between the same two levels lie beside each other, and those between the same
    two uprights below each other: a point can be in one of such a strip.
    """
    ways, strips = [], []
    for low, high, begin, end, across, along in ((boxes.y0, boxes.y1, boxes.x0, boxes.x1, y, x), (boxes.x0, boxes.x1, boxes.y0, boxes.y1, x, y)):
        by, order = np.lexsort((begin, high, low, boxes.page)), np.lexsort((across, page))
        new = changes(boxes.page[by], low[by], high[by])
        strip, of = np.cumsum(new) - 1, by[new]
        places = keyed(page[order], across[order])
        ways.append((boxes.page[of], *(np.searchsorted(places, keyed(boxes.page[of], edge[of]), "left") for edge in (low, high))))
        strips.append((by, strip, keyed(strip, begin[by]), end[by], order, along))
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k, (i, j) in shorter(ways):
        by, strip, begins, end, order, along = strips[k]
        j = order[j]
        at = np.searchsorted(begins, keyed(i, along[j]), "right") - 1
        held = (at >= 0) & (strip[at] == i) & (along[j] < end[at])
        found.append((by[at[held]], j[held]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

"""Burrows-Wheeler transform and common prefixes of a collection, built column by column.

Round j puts the suffix of length j of every string into the sorted order of all
shorter suffixes: its place follows from the place of the suffix one shorter and
the rank of the symbol put before it. The transform and the common prefixes of
neighbours live in two files that each round reads once and writes once, front
to back. Where a suffix ended up is read off the finished transform.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Smallest of values[lo:hi] for each pair, lo < hi."""
    out = np.empty(len(lo), values.dtype)
    if not len(lo):
        return out
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1  # floor of the logarithm
    lv, by = values, np.argsort(level, kind="stable")
    edges = np.searchsorted(level[by], np.arange(int(level.max()) + 2))
    for k in range(len(edges) - 1):
        at = by[edges[k] : edges[k + 1]]
        if len(at):
            out[at] = np.minimum(lv[lo[at]], lv[hi[at] - (1 << k)])
        if k + 2 < len(edges):
            lv = np.minimum(lv[: len(lv) - (1 << k)], lv[1 << k :])
    return out


class _File:
    """Values on disk that are read and overwritten from front to back."""

    def __init__(self, folder: str, name: str, values: np.ndarray):
        self.handle, self.kind = os.open(os.path.join(folder, name), os.O_RDWR | os.O_CREAT), values.dtype
        self.write(values)

    def read(self) -> np.ndarray:
        return np.frombuffer(bytearray(os.pread(self.handle, self.size, 0)), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.size = values.nbytes
        done, data = 0, memoryview(values).cast("B")
        while done < self.size:
            done += os.pwrite(self.handle, data[done:], done)


def _coded(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols by column (the last of each string first) as ranks from 1, 0 where a string has none; sizes; symbol of each rank."""
    sizes = np.array([len(s) for s in strings], np.int64)
    every = np.concatenate([*strings, np.zeros(0, np.uint16)]).astype(np.int64)
    alphabet, codes = np.unique(every, return_inverse=True)
    kind = np.uint8 if len(alphabet) < 256 else np.uint16
    columns = np.zeros((int(sizes.max(initial=0)), len(strings)), kind)
    owner = np.repeat(np.arange(len(strings)), sizes)
    from_end = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(every))
    columns[from_end, owner] = codes + 1
    return columns, sizes, np.concatenate(([0], alphabet + 1))


def build(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Transform and common prefixes (of each suffix and the one before it) of all suffixes, the empty ones first.

    Strings are arrays of symbols, of up to 254 of them. The transform holds
    symbols + 1; 0 stands before a whole string. Suffixes alike in all their
    symbols keep the order of their strings.
    """
    columns, sizes, alphabet = _coded(strings)
    m, kind = len(strings), columns.dtype
    with tempfile.TemporaryDirectory() as folder:
        transform, prefixes = _File(folder, "bwt", np.zeros(m, kind)), _File(folder, "lcp", np.zeros(m, np.uint8))
        place, active = np.arange(m), np.arange(m)
        for j in range(len(columns)):
            bwt, lcp = transform.read(), prefixes.read()
            going = sizes[active] > j
            active, place = active[going], place[going]
            c = columns[j, active]
            bwt[place] = c
            n = len(bwt)
            order = np.argsort(bwt, kind="stable")
            rank = np.empty(n, np.int32)
            rank[order] = np.arange(n, dtype=np.int32)
            r = rank[place].astype(np.int64)
            new = m + r - (n - np.count_nonzero(bwt))
            # Neighbours among the suffixes that start with the same symbol.
            before, after = order[np.maximum(r - 1, 0)], order[np.minimum(r + 1, n - 1)]
            has_before = (r > 0) & (bwt[before] == c)
            has_after = (r + 1 < n) & (bwt[after] == c)
            up = np.zeros(len(new), np.uint8)
            up[has_before] = 1 + _range_min(lcp, before[has_before] + 1, place[has_before] + 1)
            down = 1 + _range_min(lcp, place[has_after] + 1, after[has_after] + 1)
            kept = np.ones(n + len(new), bool)
            kept[new] = False
            out = np.zeros(n + len(new), kind)
            out[kept] = bwt
            transform.write(out)
            out = np.zeros(n + len(new), np.uint8)
            out[kept] = lcp
            out[new] = up
            out[new[has_after] + 1] = down  # as it is for a neighbour that is new itself
            prefixes.write(out)
            place = new
        bwt, lcp = transform.read(), prefixes.read()
        os.close(transform.handle)
        os.close(prefixes.handle)
    return alphabet[bwt], lcp


def equal_windows(strings: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """String, start and class of every window of ``width`` symbols; windows of one class are equal."""
    bwt, lcp = build(strings)
    m, sizes = len(strings), np.array([len(s) for s in strings], np.int64)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    shift = m - (len(bwt) - np.count_nonzero(bwt))
    classes = np.cumsum(lcp < width)
    place, active, out = np.arange(m), np.arange(m), []
    for length in range(1, int(sizes.max(initial=0)) + 1):
        going = sizes[active] >= length
        active, place = active[going], rank[place[going]] + shift
        if length >= width:
            out.append((active, sizes[active] - length, classes[place]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))

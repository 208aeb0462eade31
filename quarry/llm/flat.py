"""Columnar text helpers for work inside Arrow tasks.

A batch of texts is seen as one byte buffer plus document offsets, so that
splitting and hashing run over whole batches in numpy. Spark decides which rows
a task sees; nothing here keeps state between tasks.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that are worked on at a time: temporary arrays don't grow with a text.
BLOCK = 1 << 18
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def give_back() -> None:
    """Returns freed memory to the system: workers live on, and an executor's share is small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column`` at most.

    A single longer text makes a batch of its own; texts are never cut.
    """
    yield from _slices(batches, column, limit)
    give_back()


def _slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values of a string or binary column, and n + 1 offsets; null: empty."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    if pa.types.is_string(col.type) or pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary())
    elif pa.types.is_large_string(col.type):
        col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def strings(buf: np.ndarray, off: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """Contiguous spans of ``buf`` as an Arrow array, without a copy."""
    return pa.Array.from_buffers(
        kind or pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(buf))]
    )


def blocks(n: int, size: int = 0) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches that ``n`` bytes are worked on in."""
    size = size or BLOCK
    for a in range(0, n, size):
        yield a, min(n, a + size)


def spans(buf: np.ndarray, off: np.ndarray, break_at: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without breaking bytes, and n + 1 bounds by document.

    Runs never cross documents.
    """
    starts, ends, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], len(buf)
    for a, b in blocks(n):
        gap = np.ones(b - a + 2, bool)  # with a byte on either side
        lo, hi = max(a - 1, 0), min(b + 1, n)
        gap[lo - a + 1 : hi - a + 1] = break_at[buf[lo:hi]]
        first = np.zeros(b - a + 1, bool)  # a document's first byte
        first[off[np.searchsorted(off, a) : np.searchsorted(off, b, side="right")] - a] = True
        inside = ~gap[1:-1]
        starts.append(np.flatnonzero(inside & (gap[:-2] | first[:-1])) + a)
        ends.append(np.flatnonzero(inside & (gap[2:] | first[1:])) + a + 1)
    every = np.concatenate(starts)
    return every, np.concatenate(ends), np.searchsorted(every, off)


def counts_at(buf: np.ndarray, which: np.ndarray, *places: np.ndarray) -> list[np.ndarray]:
    """How many bytes of the kind ``which`` (by byte) stand before each place; places ascend."""
    out, done, before = [np.zeros(len(p), np.int64) for p in places], [0] * len(places), 0
    for a, b in blocks(len(buf)):
        upto = np.concatenate(([0], np.cumsum(which[buf[a:b]], dtype=np.int64))) + before
        for j, p in enumerate(places):
            stop = int(np.searchsorted(p, b, side="right"))
            out[j][done[j] : stop] = upto[p[done[j] : stop] - a]
            done[j] = stop
        before = upto[-1]
    return out


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, break_at: np.ndarray = SPACE) -> pa.Array:
    """The runs that spans() found, as an Arrow array."""
    return strings(buf[~break_at[buf]], np.concatenate(([0], np.cumsum(ends - starts))))


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    p = np.full(size, base, np.uint64)
    p[0] = 1
    return np.cumprod(p)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(buf: np.ndarray, *pairs: tuple[np.ndarray, np.ndarray], values: np.ndarray = _TABLE) -> list[np.ndarray]:
    """64-bit hash of the symbols of each span, the same wherever the span lies.

    Each pair holds starts and ends, both ascending. Polynomial sums run over
    the symbols block by block; a span's hash is the difference of two of them.
    """
    places = [p for pair in pairs for p in pair]
    sums, done = [np.zeros(len(p), np.uint64) for p in places], [0] * len(places)
    up, before, scale, modulus = _powers(_BASE, BLOCK + 1), np.uint64(0), 1, 1 << 64
    for a, b in blocks(len(buf)):
        upto = np.zeros(b - a + 1, np.uint64)
        np.cumsum(values[buf[a:b]] * up[: b - a], out=upto[1:])
        upto *= np.uint64(scale)
        upto += before
        for j, p in enumerate(places):
            stop = int(np.searchsorted(p, b, side="right"))
            sums[j][done[j] : stop] = upto[p[done[j] : stop] - a]
            done[j] = stop
        before, scale = upto[-1], scale * pow(_BASE, b - a, modulus) % modulus
    low, high = _powers(_INVERSE, BLOCK), _powers(pow(_INVERSE, BLOCK, modulus), 1 + len(buf) // BLOCK)
    out = []
    for k, (starts, ends) in enumerate(pairs):
        h = sums[2 * k + 1]
        h -= sums[2 * k]
        h *= low[starts % BLOCK]
        h *= high[starts // BLOCK]
        h += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        out.append(mix(h))
    return out


class Tally:
    """Counts by key; batches are merged when they have grown by half."""

    def __init__(self):
        self.keys, self.counts, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > 200_000 + len(self.keys) // 2:
            self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        self.waiting, self.size = [], 0
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
        self.keys, self.counts = keys[first], np.add.reduceat(counts[by], first) if len(first) else counts

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys and counts; the tally starts anew."""
        self.merge()
        out = self.keys, self.counts
        self.keys, self.counts = self.keys[:0], self.counts[:0]
        return out

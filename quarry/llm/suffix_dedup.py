"""Removal of byte strings that occur earlier, by column-wise suffix sorting of anchored segments.

Every window of ``WIDTH`` bytes has an anchor: the place of its smallest hash
(winnowing), whose ``CORE`` bytes all equal windows share at the same offset.
Consecutive windows with one anchor are one occurrence (key, segment), so each
window belongs to exactly one occurrence, and equal windows meet under one key.

* All occurrences of a segment but the first are removed whole.
* First occurrences of the different segments of a key are compared: their bytes
  around the core, with the core as one symbol, are a collection whose
  Burrows-Wheeler transform and common prefixes are built column by column; runs
  of suffixes with ``WIDTH`` bytes in common are equal windows, of which the
  earliest stays. Over whole documents the method would take as many rounds as
  the longest document has bytes; over segments it takes at most
  2 * (WIDTH - CORE) + 1.
* A key with more than ``CLASS_LIMIT`` different segments (a line that very many
  documents hold) would make an unbounded collection. Its windows are grouped by
  their hash instead, which Spark sums up map-side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.column_bwt import equal_windows
from quarry.llm.carried import renamed, restored
from quarry.llm.flat import blocks, flat, give_back, mix, slices, span_hashes
from quarry.session import cut, table

WIDTH, CORE = 100, 40
#: Segments of a key that one collection takes, and those of a collection.
CLASS_LIMIT, COLLECTION = 2000, 2000
#: 64-bit words of the filters that keep keys and documents without a partner out of a shuffle: 4 MB.
FILTER_WORDS = 1 << 19
#: A filter that more values fill lets too much pass; a join does its work then.
FILTER_VALUES = 1 << 23
_BYTE = np.random.default_rng(97).integers(1, 2**32, 256, dtype=np.uint32) | np.uint32(1)
_NEVER = np.uint64(2**64 - 1)


def occurrences(buf: np.ndarray, off: np.ndarray, width: int = WIDTH, core: int = CORE) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, anchor, key hash and segment hash of every occurrence.

    Windows are looked at in blocks, and an occurrence ends with its block, so
    what a task holds doesn't grow with a text.
    """
    parts = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
    for a, b in blocks(max(0, len(buf) - width + 1)):
        stop = b + width - 1
        edges = off[np.searchsorted(off, a, side="right") : np.searchsorted(off, stop)]
        starts, *rest = _occurrences(buf[a:stop], edges - a, width, core)
        parts.append((starts + a, rest[0], rest[1] + a, *rest[2:]))
    starts, count, anchor, key, segment = (np.concatenate(x) for x in zip(*parts, strict=True))
    text = np.searchsorted(off, starts, side="right") - 1
    return text, starts - off[text], count, anchor - off[text], key, segment


def _occurrences(buf: np.ndarray, edges: np.ndarray, width: int, core: int) -> tuple[np.ndarray, ...]:
    """The same for the windows of one block, with places in the block; texts begin at ``edges`` too."""
    n = len(buf) - width + 1
    h, step = _BYTE[buf], 1
    while step < 8:
        h = h[:-step] * np.uint32(pow(0x9E3779B1, step, 1 << 32)) + h[step:]
        step *= 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h = h[: len(buf) - core + 1]
    # The smallest hash of each window, the last of equal ones; the low half says where.
    low = (h.astype(np.uint64) << np.uint64(32)) | (np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64))
    span, step = width - core + 1, 1
    while 2 * step <= span:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low = np.minimum(low[:n], low[span - step : span - step + n])
    inside = np.ones(n, bool)
    for e in edges.tolist():  # windows that cross into the next text
        inside[max(0, e - width + 1) : e] = False
    edge = np.ones(n, bool)
    edge[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    starts = np.flatnonzero(edge & inside)
    if not len(starts):
        return (starts,) * 3 + (np.zeros(0, np.uint64),) * 2
    breaks = np.append(np.flatnonzero(edge | ~inside), n)
    count = breaks[np.searchsorted(breaks, starts, side="right")] - starts
    anchor = (np.uint64(0xFFFFFFFF) - (low[starts] & np.uint64(0xFFFFFFFF))).astype(np.int64)
    key, segment = span_hashes(buf, (anchor, anchor + core), (starts, starts + count - 1 + width))
    return starts, count, anchor, key, mix(segment + (anchor - starts).astype(np.uint64))


def _bits(rows: DataFrame, column: str) -> np.ndarray | None:
    """A filter that holds every value of ``column``; None if they are too many. FILTER_WORDS rows come to the driver at most."""
    if rows.count() > FILTER_VALUES:
        return None
    word = F.pmod(F.col(column), F.lit(FILTER_WORDS)).alias("w")
    place = F.expr(f"bit_or(shiftleft(1L, cast(pmod(shiftrightunsigned(`{column}`, 40), 64) as int)))").alias("b")
    got = rows.groupBy(word).agg(place).toPandas()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[got["w"].to_numpy()] = got["b"].to_numpy().view(np.uint64)
    return words


def _held(words: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    if words is None:
        return np.ones(len(values), bool)
    signed = values.astype(np.int64)
    place = (signed.view(np.uint64) >> np.uint64(40)) % np.uint64(64)
    return (words[signed % len(words)] >> place) & np.uint64(1) == 1


def numbered(docs: DataFrame, id_column: str, text_column: str, carry: list[Column] | None = None) -> DataFrame:
    """_doc (in the order of ids, ties by text), _id, _text and ``carry``; rows alike in id and text are one document."""
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("_id"), F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).cast("binary").alias("_text"), *(carry or []))
    carry = rows.columns[2:]
    known = rows.groupBy("_id").count()
    if known.where("count > 1 OR _id IS NULL").isEmpty():
        return rows.select(F.col("_id").alias("_doc"), "_id", "_text", *carry)
    rows = rows.withColumn("_hash", F.md5("_text"))
    order = cut(rows.select("_id", "_hash").distinct().orderBy(F.col("_id").asc_nulls_last(), "_hash").withColumn("_doc", F.monotonically_increasing_id()))
    order = order.withColumnsRenamed({"_id": "_i", "_hash": "_h"})
    return rows.join(order, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h"))).select("_doc", "_id", "_text", *carry)


def _keys(width: int, core: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            key, n = np.unique(occurrences(*flat(batch.column(1)), width, core)[4], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["key", "n"])

    return run


def _shared(width: int, core: int, words: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            text, start, n, anchor, key, segment = occurrences(*flat(batch.column(1)), width, core)
            at = np.flatnonzero(_held(words, key.view(np.int64)))
            cols = [batch.column(0).take(pa.array(text[at])), pa.array(start[at].astype(np.int32)), pa.array(n[at].astype(np.int32)), pa.array(anchor[at].astype(np.int32)), pa.array(key[at].view(np.int64)), pa.array(segment[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["_doc", "start", "n", "anchor", "key", "segment"])

    return run


def zipped_texts(texts: pa.Array) -> pa.Array:
    """Compressed for a shuffle."""
    shrink = zstandard.ZstdCompressor(level=1).compress
    return pa.array([shrink(t) for t in texts.to_pylist()], pa.binary())


def _segments(width: int):
    """Bytes of each wanted occurrence of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for i in range(batch.num_rows):
                text, want = grow(batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                part = [text[w["start"] : w["start"] + w["n"] - 1 + width] for w in want]
                cols = [pa.array([batch.column(0)[i].as_py()] * len(want), pa.int64()), *(pa.array([w[k] for w in want], t) for k, t in (("start", pa.int32()), ("anchor", pa.int32()), ("key", pa.int64()))), pa.array([w["hot"] for w in want], pa.bool_()), pa.array(part, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["_doc", "start", "anchor", "key", "hot", "bytes"])

    return run


def _compared(width: int, core: int):
    """Windows of first occurrences that equal an earlier one, as runs (_doc, start of the occurrence, run's first window, windows)."""

    def collection(doc: np.ndarray, start: np.ndarray, anchor: np.ndarray, key: np.ndarray, parts: list[bytes]) -> np.ndarray:
        _, number = np.unique(key, return_inverse=True)
        strings = []
        for i, part in enumerate(parts):
            s, at = np.frombuffer(part, np.uint8).astype(np.uint16), int(anchor[i] - start[i])
            strings.append(np.concatenate([s[:at], np.array([256 + number[i]], np.uint16), s[at + core :]]))
        which, offset, cls = equal_windows(strings, width - core + 1)
        at = start[which] + offset
        by = np.lexsort((at, doc[which], cls))
        first = np.ones(len(by), bool)
        first[1:] = cls[by][1:] != cls[by][:-1]
        gone = by[~first]
        return np.stack([which[gone], offset[gone]], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)).combine_chunks()
        doc, start, anchor, key = (whole.column(c).to_numpy() for c in ("_doc", "start", "anchor", "key"))
        by = np.lexsort((start, doc, key))
        other = np.ones(len(by), bool)  # rows alike in id and text give the same segments twice
        other[1:] = (doc[by][1:] != doc[by][:-1]) | (start[by][1:] != start[by][:-1])
        by = by[other]
        doc, start, anchor, key = doc[by], start[by].astype(np.int64), anchor[by].astype(np.int64), key[by]
        parts = whole.column("bytes").take(pa.array(by)).to_pylist()
        heads = np.append(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))), len(key))
        lo, found = 0, []
        while lo < len(heads) - 1:  # keys are never parted; 150 keys leave a symbol in a byte
            hi = max(lo + 1, min(lo + 150, int(np.searchsorted(heads, heads[lo] + COLLECTION, side="right")) - 1))
            a, b = heads[lo], heads[hi]
            found.append(collection(doc[a:b], start[a:b], anchor[a:b], key[a:b], parts[a:b]) + [a, 0])
            lo = hi
        gone = np.concatenate([*found, np.zeros((0, 2), np.int64)])
        gone = gone[np.lexsort((gone[:, 1], gone[:, 0]))]
        new = np.ones(len(gone), bool)
        new[1:] = (gone[1:, 0] != gone[:-1, 0]) | (gone[1:, 1] != gone[:-1, 1] + 1)
        at = np.flatnonzero(new)
        size = np.diff(np.append(at, len(gone)))
        w = gone[at, 0]
        del whole, parts
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(doc[w]), pa.array(start[w].astype(np.int32)), pa.array((start[w] + gone[at, 1]).astype(np.int32)), pa.array(size.astype(np.int32))], ["_doc", "start", "run", "windows"])

    return run


def _windows(width: int):
    """Hash and place of each window of the hot keys' segments, with the smallest place of a batch only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", 1 << 18):
            buf, off = flat(batch.column(2))
            n = np.diff(off) - width + 1
            part = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
            at = off[part] + inner
            h = span_hashes(buf, (at, at + width))[0]
            doc, start = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[part] for k in (0, 1))
            by = np.lexsort((start + inner, doc, h))
            keep = np.ones(len(by), bool)
            keep[1:] = h[by][1:] != h[by][:-1]
            by = by[keep]
            yield pa.RecordBatch.from_arrays([pa.array(h[by].view(np.int64)), pa.array(doc[by]), pa.array(start[by].astype(np.int32)), pa.array((start + inner)[by].astype(np.int32))], ["window", "_doc", "start", "at"])

    return run


def _removed(owner: np.ndarray, at: np.ndarray, n: np.ndarray, kind: np.ndarray, docs: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and stop of maximal removed byte runs, from occurrences and the verdicts on them.

    kind 0: an occurrence, gone unless said otherwise; 1: the first of its
    segment, of which nothing is gone but runs of kind 2; 3: a window of a hot
    key's segments that is the earliest of its kind, and stays.
    """
    end = np.zeros(docs, np.int64)
    np.maximum.at(end, owner, at + n)
    base = np.concatenate(([0], np.cumsum(end + 1)))  # a free place parts documents
    place = base[owner] + at

    events = {}
    for k in range(4):
        i = kind == k
        events[k] = np.sort(place[i]), np.sort(place[i] + n[i])
    edges, level, last = [], dict.fromkeys(events, 0), False
    for a, b in blocks(int(base[-1]) + 1):
        on = {}
        for k, (opens, shuts) in events.items():
            some = [x[np.searchsorted(x, a) : np.searchsorted(x, b)] - a for x in (opens, shuts)]
            depth = np.cumsum(np.bincount(some[0], minlength=b - a) - np.bincount(some[1], minlength=b - a)) + level[k]
            on[k], level[k] = depth > 0, int(depth[-1])
        gone = ((on[0] & ~on[1]) | on[2]) & ~on[3]
        edges.append(np.flatnonzero(np.diff(np.concatenate(([last], gone)))) + a)
        last = bool(gone[-1])
    runs = np.concatenate([*edges, np.zeros(0, np.int64)]).reshape(-1, 2)  # the last place is free
    doc = np.searchsorted(base, runs[:, 0], side="right") - 1
    start, stop = runs[:, 0] - base[doc], runs[:, 1] - base[doc] + width - 1
    if not len(doc):
        return doc, start, stop
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
    first = np.flatnonzero(new)
    return doc[first], start[first], np.maximum.reduceat(stop, first)


def repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, core: int = CORE) -> DataFrame:
    """_doc, _id, and ``spans`` (array of start, stop) of the bytes to remove from each document that has any.

    A byte goes if a string of ``width`` bytes that covers it also starts
    earlier: in a smaller id, or before it in the same text. Null ids count as
    the largest; texts of one id are ordered among themselves, and rows alike in
    id and text are one document. Null texts are empty. Texts of any length are
    looked at whole, in blocks. An empty table gives an empty result.
    """
    return _repeats(numbered(docs, id_column, text_column), width, core)


def _repeats(rows: DataFrame, width: int, core: int) -> DataFrame:
    texts = rows.select("_doc", "_text")
    keys = cut(texts.mapInArrow(_keys(width, core), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    words = _bits(keys, "key")
    seen = texts.mapInArrow(_shared(width, core, words), "_doc bigint, start int, n int, anchor int, key bigint, segment bigint")
    seen = cut(seen if words is not None else seen.join(keys, "key", "left_semi"))
    place = F.struct("_doc", "start", "n", "anchor")
    firsts = cut(seen.groupBy("key", "segment").agg(F.min(place).alias("f")).select("key", "f.*"))
    several = firsts.groupBy("key").agg(F.count("*").alias("segments")).where("segments > 1").select("key", (F.col("segments") > CLASS_LIMIT).alias("hot"))
    wanted = cut(firsts.join(several, "key"))
    per_doc = wanted.groupBy("_doc").agg(F.collect_list(F.struct("start", "n", "anchor", "key", "hot")).alias("want"))
    held = _bits(wanted.select(F.xxhash64("_doc").alias("h")), "h")
    hashed = texts.select(F.xxhash64("_doc").alias("_h"), "_doc", "_text")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(_held(held, batch.column(0).to_numpy(zero_copy_only=False))))
            yield pa.RecordBatch.from_arrays([batch.column(1), zipped_texts(batch.column(2))], ["_doc", "_zip"])

    zipped = hashed.mapInArrow(near, "_doc bigint, _zip binary")
    parts = zipped.join(per_doc, "_doc").mapInArrow(_segments(width), "_doc bigint, start int, anchor int, key bigint, hot boolean, bytes binary")
    parts = cut(parts)
    cold = parts.where("NOT hot")
    groups = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-wanted.count() // (4 * COLLECTION))))).alias("_bucket")
    runs = cold.select(groups, "_doc", "start", "anchor", "key", "bytes").groupBy("_bucket")
    compared = runs.applyInArrow(_whole(_compared(width, core)), "_doc bigint, start int, run int, windows int")
    hot = parts.where("hot").select("_doc", "start", "bytes")
    earliest = hot.mapInArrow(_windows(width), "window bigint, _doc bigint, start int, at int").groupBy("window").agg(F.min(F.struct("_doc", "at")).alias("f"))
    i = lambda x: F.lit(x).cast("tinyint").alias("kind")
    verdicts = (
        seen.select("_doc", F.col("start").alias("at"), "n", i(0))
        .union(firsts.join(several.where("hot").select("key"), "key", "left_anti").select("_doc", F.col("start").alias("at"), "n", i(1)))
        .union(compared.select("_doc", F.col("run").alias("at"), F.col("windows").alias("n"), i(2)))
        .union(earliest.select("f._doc", "f.at", F.lit(1).alias("n"), i(3)))
    )

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
        for batch in batches:
            lists = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths(), np.int64))
            at, n, k = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in lists.flatten().flatten())
            doc, start, stop = _removed(owner, at, n, k, batch.num_rows, width)
            pairs = pa.StructArray.from_arrays([pa.array(start), pa.array(stop)], fields=list(kind))
            edges = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(edges, pairs, type=pa.list_(kind))], ["_doc", "spans"])

    return verdicts.groupBy("_doc").agg(F.collect_list(F.struct("at", "n", "kind"))).mapInArrow(spans, "_doc bigint, spans array<struct<start:bigint,stop:bigint>>").where("size(spans) > 0")


def _whole(run):
    """A group as the batches of one call."""

    def one(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(run(iter(group.to_batches())))

    return one


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document, as a digest."""
    rows = numbered(table(spark, sf_dir, "documents"), "doc_id", "text")
    return digests(rows, _repeats(rows, WIDTH, CORE))


def parted(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``column`` may be among ``ids``, and those whose isn't, told apart by a filter without a shuffle."""
    held = _bits(ids.select(F.xxhash64(column).alias("h")), "h")

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hit = _held(held, batch.column(0).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array(hit == wanted)).select(batch.schema.names[1:])

        return rows.select(F.xxhash64(column).alias("_h"), *rows.columns).mapInArrow(run, rows.schema)

    return side(True), side(False)


def whole_characters(text: bytes, spans: list[dict]) -> list[dict]:
    """Spans without the bytes at their ends that belong to characters which stay in part."""
    out = []
    for s in spans:
        a, b = s["start"], s["stop"]
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        out.append({"start": a, "stop": b})
    return out


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """``docs`` without the repeated bytes of their texts, ``length_column`` set to what stays.

    A character of which only some bytes would go stays whole. Documents of
    which nothing stays keep an empty text; null texts become empty ones.
    """
    names, kinds = docs.columns, dict(docs.dtypes)
    others = [c for c in names if c not in (text_column, length_column)]
    rows = numbered(docs, id_column, text_column, renamed(others))
    carry = [c for c in rows.columns if c not in ("_doc", "_id", "_text")]
    spans = cut(_repeats(rows, WIDTH, CORE))
    near, far = parted(rows, spans, "_doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left = [cut_out(t, whole_characters(t, s or [])) for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), *batch.columns[2:]], ["_text", *batch.schema.names[2:]])

    schema = "_text binary" + "".join(f", {c} {k}" for c, k in rows.dtypes if c in carry)
    shorter = near.join(spans, "_doc", "left").select("_text", "spans", *carry).mapInArrow(run, schema)
    text = F.col("_text").cast("string")
    out = far.select("_text", *carry).union(shorter).select(*restored(others), text.alias(text_column), *([F.length(text).cast(kinds[length_column]).alias(length_column)] if length_column in names else []))
    return out.select(*(f"`{n}`" for n in names))


def cut_out(text: bytes, spans: list[dict] | None) -> bytes:
    out, at = [], 0
    for s in spans or ():
        out.append(text[at : s["start"]])
        at = s["stop"]
    return b"".join([*out, text[at:]])


def digests(rows: DataFrame, spans: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            sizes, gone, n, sums = [], [], [], []
            for z, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text = grow(z)
                left = cut_out(text, s)
                sizes.append(len(text)), gone.append(len(text) - len(left)), n.append(len(s or ())), sums.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, gone, n)), pa.array(sums)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), zipped_texts(batch.column(2))], ["_doc", "_id", "_zip"])

    zipped = rows.mapInArrow(shrink, "_doc bigint, _id bigint, _zip binary")
    return zipped.join(spans, "_doc", "left").select("_id", "_zip", "spans").mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

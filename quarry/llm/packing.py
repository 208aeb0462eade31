"""Sum-of-squares packing of token sequences.

Every document becomes pieces of at most ``capacity`` tokens. Full pieces are
sequences by themselves; each other piece is placed where the squared counts of
open bins per residual gap become smallest (a new bin is one of the choices).
Groups of pieces are packed in tasks of their own; their size doesn't grow with
the table. Pieces of bins that a group left open go to a next round with fewer
groups, so the waste of small groups doesn't add up. The rounds end with one
group, or with one that leaves over half of its pieces in open bins: lengths that
don't add up to full bins wouldn't in larger groups either.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, carried
from quarry.llm.flat import slices
from quarry.session import cut, table

CAPACITY, END_ID = 1024, 2


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_column: str = "doc_id", text_column: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if wanted, the ids.

    The end id closes each document, so a null or empty text is one piece of one
    token. Documents longer than ``capacity`` are cut into full pieces, the
    first one taking what is over. Texts are encoded whole, whatever their
    length; rows that repeat an id are cut one by one, and a null id stays null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            rows, pieces, starts, lengths, crcs, lists = [], [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(bpe.encode(path, text or ""), end_id).astype("<u4")
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    part = ids[edges[k] : edges[k + 1]]
                    rows.append(r), pieces.append(k), starts.append(edges[k]), lengths.append(len(part)), crcs.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        lists.append(part.astype(np.int64))
            cols = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            names = ["_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols, names = [*cols, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_column)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item in the order given, and the gap each bin keeps."""
    open_bins = np.zeros(capacity + 1, np.int64)  # by gap; bins without a gap are closed
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    never = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        # Going from gap g to g - s changes the sum by 2 * (n[g - s] - n[g]) + 2, or 1 - 2 * n[g] where the bin closes.
        here = open_bins[s:]
        cost = 2 * (open_bins[: capacity + 1 - s] - here) + 2
        cost[0] = 1 - 2 * here[0]
        cost[here == 0] = never
        new = 2 * open_bins[capacity - s] + 1 if s < capacity else 0
        g = int(cost.argmin())
        if cost[g] <= new:
            g += s
            b = stacks[g].pop()
            open_bins[g] -= 1
        else:
            g, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - g
        gaps[b] = g - s
        if g > s:
            stacks[g - s].append(b)
            open_bins[g - s] += 1
    return bins, offsets, np.array(gaps, np.int64)


def _packer(order: list[str], capacity: int, step: int):
    """Packs one group by columns ``_length`` and ``order``; ``_open`` tells pieces of bins with a gap."""

    def one(group: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("_group").combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [(c, "descending") for c in ("_length", *order)]))
        bins, offsets, gaps = sum_of_squares(rows.column("_length").to_numpy(), capacity)
        rows = rows.append_column("_sequence", pa.array((np.int64(step) << 56) + (np.int64(group[0].as_py()) << 24) + bins))
        return rows.append_column("_offset", pa.array(offsets)).append_column("_open", pa.array(gaps[bins] > 0))

    return one


def pack(pieces: DataFrame, keys: list[str], capacity: int = CAPACITY, group_rows: int = 50000) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``length`` is between 1 and ``capacity``; ``keys`` tell pieces apart and fix
    the order of a group. Every piece has a number of its own besides, written down
    before the groups are dealt, so rows alike in all keys (ids that are null or
    repeated) spread over the groups like others and a lost task's second run
    packs alike. Pieces of one length go by their keys, then by that number.
    Columns of ``pieces`` named like the results are replaced, others are carried under
    names of their own, so none clashes. An empty table gives an empty result.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order = [f"c{names.index(k)}" for k in keys] + ["_tie"]
    rows = pieces.select(F.col("length").cast("long").alias("_length"), *carried.renamed(names)).withColumn("_tie", F.monotonically_increasing_id())
    own = rows.columns
    result = lambda df: df.select(*carried.restored(names), F.col("_sequence").alias("sequence_id"), F.col("_offset").alias("offset"))
    full = rows.where(F.col("_length") == capacity).withColumns({"_sequence": F.lit(-1) - F.col("_tie"), "_offset": F.lit(0).cast("long")})
    done = [result(full)]
    rest, step = cut(rows.where(F.col("_length") < capacity)), 0
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema) + ", _sequence bigint, _offset bigint, _open boolean"
    left = rest.count()
    while left:
        groups = max(1, math.ceil(left / group_rows))
        dealt = rest.withColumn("_group", F.pmod(F.xxhash64(*order), F.lit(groups)).cast("long"))
        packed = cut(dealt.groupBy("_group").applyInArrow(_packer(order, capacity, step), fields))
        rest, before, step = packed.where("_open").select(*own), left, step + 1
        left = rest.count() if groups > 1 else 0
        last = left == 0 or left > before // 2
        done.append(result(packed if last else packed.where("NOT _open")))
        if last:
            break
    return reduce(DataFrame.unionByName, done)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, tokenized and packed into sequences of 1024 tokens."""
    pieces = cut(tokenized_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))
    return pack(pieces, ["doc_id", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

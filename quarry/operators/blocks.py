"""A set of queries against all rows of an index, both in blocks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a block of index rows, about.
SLAB = 1 << 23

Load = Callable[[pa.Table], Any]
Answer = Callable[[Any, pa.RecordBatch], Iterator[pa.RecordBatch]]


def _stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _read(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, math.ceil(batch.num_rows / max(1, math.ceil(batch.nbytes / SLAB))))
        for at in range(0, batch.num_rows, rows):
            yield pa.RecordBatch.from_arrays([pa.array([_stored(pa.Table.from_batches([batch.slice(at, rows)]))], pa.binary())], ["slab"])


def answered(index: DataFrame, queries: DataFrame, names: int, block: int, load: Load, answer: Answer, schema: str) -> DataFrame:
    """Rows that ``answer`` gives for all rows of ``queries``, made ready by ``load``, and batches of ``index``.

    ``queries`` has a column query_id with ``names`` values. Up to ``block`` of
    them go to every task with the plan. More stay in Spark: blocks of queries
    become rows, which meet the index in as many parts as shuffles have
    partitions. The index is read and shuffled once however many queries there
    are, a task holds one block of either at a time, and the driver none.
    """
    if names <= block:
        ready = load(queries.toArrow().combine_chunks())

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from answer(ready, batch)

        return index.mapInArrow(whole, schema)

    def gathered(group: pa.Table) -> pa.Table:
        return pa.table({"asked": pa.array([_stored(group.drop_columns("_block"))], pa.binary())})

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ready = load(_read(batch.column(1)[i].as_py()))
                for part in _read(batch.column(0)[i].as_py()).to_batches():
                    yield from answer(ready, part)

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = 2 * math.ceil(names / block)  # hashes fill blocks unevenly
    by_block = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asked = by_block.groupBy("_block").applyInArrow(gathered, "asked binary").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    slabs = index.mapInArrow(_slabs, "slab binary").withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int"))
    # Merged, so that a part's blocks are read in turn, from disk where they are many.
    return slabs.join(asked.hint("merge"), "part").select("slab", "asked").mapInArrow(pairs, schema)

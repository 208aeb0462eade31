"""Trailing-window call counts and admission under rate limits."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.config import DEFAULT, Config


def trailing_counts(calls: DataFrame, key: str = "user_id", time: str = "ts", seconds: tuple[int, ...] = (60, 86400)) -> DataFrame:
    """Calls of the same key in the half-open window that ends at each call, itself included."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = calls.withColumn("_us", micros)
    for s in seconds:
        w = Window.partitionBy(key).orderBy("_us").rangeBetween(-s * 1_000_000 + 1, 0)
        rows = rows.withColumn(f"calls_{s}s", F.count("*").over(w))
    return rows.drop("_us")


def admitted(calls: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", config: Config = DEFAULT) -> DataFrame:
    """Which calls a sliding log lets through: refused calls don't count later on.

    Whether a call passes depends on the ones before it, so each key's calls are
    folded in order, batch by batch; the log holds no more times than the day's
    limit. Calls without a time come last.
    """
    minute, day = 60_000_000, 86_400_000_000
    names = calls.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, last_day, last_minute = object(), deque(), deque()
        for batch in batches:
            out = []
            for k, t in zip(batch.column(names.index(key)).to_pylist(), batch.column(len(names)).to_pylist()):
                if k != current and (k == k or current == current):  # NaN is one key
                    current, last_day, last_minute = k, deque(), deque()
                if t is not None:
                    while last_day and t - last_day[0] >= day:
                        last_day.popleft()
                    while last_minute and t - last_minute[0] >= minute:
                        last_minute.popleft()
                out.append(len(last_day) < config.calls_per_day and len(last_minute) < config.calls_per_minute)
                if out[-1]:
                    last_day.append(t)
                    last_minute.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.bool_())], [*names, "admitted"])

    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = calls.withColumn("_us", micros).repartition(key).sortWithinPartitions(key, F.col("_us").asc_nulls_last(), F.col(order).asc_nulls_last())
    return rows.mapInArrow(fold, StructType([*calls.schema, StructField("admitted", BooleanType())]))

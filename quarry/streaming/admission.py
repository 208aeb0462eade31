"""Admission under rate limits over a stream of calls."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.config import DEFAULT, Config

MINUTE, DAY = 60_000_000, 86_400_000_000
#: Spark's state of this kind needs this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Admission(StatefulProcessor):
    """The log of a key's admitted calls of the last day: no more times than the day's limit, and gone once they are a day old."""

    def __init__(self, names: list[str], order: str, config: Config):
        self.names, self.order, self.config = names, order, config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.log = handle.getValueState("log", "times array<bigint>, until bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        calls = pd.concat(list(rows), ignore_index=True)
        calls = calls.sort_values(["admission_us", self.order], kind="stable", na_position="last")
        times, until = self.log.get() if self.log.exists() else ([], None)
        times, passed = [int(t) for t in times], []
        for t in calls["admission_us"].tolist():
            times = [x for x in times if t - x < DAY]
            recent = sum(t - x < MINUTE for x in times)
            passed.append(len(times) < self.config.calls_per_day and recent < self.config.calls_per_minute)
            if passed[-1]:
                times.append(t)
        if times:
            end = (max(times) + DAY) // 1000 + 1
            if until is not None and int(until) != end:
                self.handle.deleteTimer(int(until))
            if until is None or int(until) != end:
                self.handle.registerTimer(end)
            self.log.update((times, end))
        yield calls.assign(admitted=passed)[[*self.names, "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.log.exists() and int(self.log.get()[1]) <= timerValues.getCurrentWatermarkInMs():
            self.log.clear()
        yield from ()

    def close(self) -> None:
        pass


def admitted(calls: DataFrame, key: str = "user_id", time: str = "ts", order: str = "event_id", late: str = "10 minutes", config: Config = DEFAULT) -> DataFrame:
    """The stream ``calls`` with ``admitted``, as rates.admitted() tells for the same calls at rest.

    Calls of a key must come in order of time from one micro-batch to the next; within
    one they are sorted. Where batches end doesn't matter. Calls later than ``late`` are
    judged when they come; calls without a time or a key are left out. A key's state
    is its log, and goes once the watermark is a day past its last admitted call. The session's
    ``spark.sql.streaming.stateStore.providerClass`` must be STORE.
    """
    names = calls.columns
    timed = calls.where(F.col(time).isNotNull() & F.col(key).isNotNull()).withColumn("admission_at", F.col(time).cast("timestamp")).withWatermark("admission_at", late)
    rows = timed.withColumn("admission_us", F.unix_micros("admission_at")).groupBy(key)
    schema = StructType([*calls.schema, StructField("admitted", BooleanType())])
    return rows.transformWithStateInPandas(Admission(names, order, config), schema, "Append", "EventTime")

"""Stages that pick up new documents as files arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.session import cut
from quarry.sources import store


def run_stage(
    spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "doc_id", version: str | None = None, files_per_batch: int = 128
) -> StreamingQuery:
    """Applies ``work`` to the rows of new Parquet files under ``source``; its results replace those of the same documents in the store ``target``.

    A document that comes again, changed or not, is worked on again, so its last
    version counts; of several in one micro-batch that of the largest ``version``, if
    a column is named. Rows whose result has an ``error`` aren't stored; their
    input waits in ``{target}-failed`` and is tried again by the next run, unless
    a new version has come. The stream keeps no state of documents, and a
    micro-batch that is run again after a failure writes the same state again. All
    files that are there are worked off, then the query ends; a later run with
    the same checkpoint goes on.
    """
    failed, retried = f"{target.rstrip('/')}-failed", []

    def flush(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates()
        if version:
            newest = rows.groupBy(key).agg(F.max(version).alias("_newest"))
            rows = rows.join(newest, key).where(F.col(version).eqNullSafe(F.col("_newest"))).drop("_newest")
        waiting = None if retried else store.read(spark, failed, key=key)
        if waiting is not None:
            rows = rows.unionByName(waiting.join(batch.select(key), key, "left_anti"))
        retried.append(number)
        rows = cut(rows)
        done = cut(work(rows))
        keys = rows.select(key).distinct()
        if "error" in done.columns:
            bad = done.where("error IS NOT NULL").select(key).distinct()
            store.write(rows.join(bad, key, "left_semi"), failed, keys, key)
            done, keys = done.join(bad, key, "left_anti").drop("error"), keys.join(bad, key, "left_anti")
        store.write(done, target, keys, key)
        store.tidied(spark, target, key=key)

    def retry(number: int = -1) -> None:
        """Failed documents are tried again even where no new file has come."""
        waiting = store.read(spark, failed, key=key)
        if waiting is not None and not waiting.isEmpty():
            flush(waiting.limit(0), number)

    retry()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def call_counts(calls: DataFrame, window: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """Calls of each user in tumbling windows of a stream; rows later than ``late`` are left out."""
    timed = calls.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("calls"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "calls")


def run_batches(
    spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "doc_id", rows_each: int = 128, files_per_batch: int = 128
) -> None:
    """Applies ``work`` to rows of all new files in flushes of ``rows_each`` rows or more, across documents, with one of the rest at the end.

    Rows wait in the store ``{target}-waiting`` until as many are there; a document's
    rows are flushed together, and replace what ``target`` has of it only then. A stop
    between leaves them waiting for the next run.
    """
    waiting = f"{target.rstrip('/')}-waiting"

    def flush() -> None:
        rows = store.read(spark, waiting, key=key)
        if rows is None or rows.isEmpty():
            return
        rows = cut(rows)
        keys = rows.select(key).distinct()
        store.write(work(rows), target, keys, key)
        store.delete(keys, waiting, key)

    def collect(batch: DataFrame, number: int) -> None:
        store.write(batch.dropDuplicates(), waiting, key=key)
        rows = store.read(spark, waiting, key=key)
        if rows.limit(rows_each).count() >= rows_each:
            flush()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(collect).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    flush()

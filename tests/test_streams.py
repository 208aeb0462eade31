"""Streams against the same work at rest."""

import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import rates
from quarry.sources import tables
from quarry.streaming import admission, stages


def folder(name="x"):
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/" + name


@pytest.mark.parametrize("batches", [1, 5])
def test_admission_whatever_the_batches(spark, batches):
    rng, start = random.Random(4), datetime(2024, 1, 1)
    times = sorted(start + timedelta(seconds=rng.randrange(0, 4 * 86400) // 20 * 20) for _ in range(600))
    calls = [(k, rng.randrange(4), t, f"p{k}") for k, t in enumerate(times)]
    schema, config = "event_id long, user_id long, ts timestamp, more string", Config(calls_per_minute=1, calls_per_day=20)
    source, target, check = folder("in"), folder("out"), folder("check")
    edges = sorted(rng.sample(range(1, 600), batches - 1))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", admission.STORE)
    try:
        for a, b in zip([0, *edges], [*edges, 600]):
            spark.createDataFrame(rng.sample(calls[a:b], b - a), schema).coalesce(1).write.mode("append").parquet(source)
            stream = admission.admitted(spark.readStream.schema(schema).parquet(source), config=config)
            query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", check).trigger(availableNow=True).start()
            query.awaitTermination(240)
            assert query.exception() is None
            state = [s.numRowsTotal for p in query.recentProgress for s in (p.stateOperators or [])]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = {tuple(r) for r in rates.admitted(spark.createDataFrame(calls, schema), config=config).collect()}
    got = [tuple(r) for r in spark.read.parquet(target).collect()]
    assert len(got) == 600 and set(got) == want and 0 < sum(r[-1] for r in got) < 600
    assert max(state, default=0) < 60


def test_flushes_of_enough_rows(spark):
    source, target, check = folder("s"), folder("t"), folder("c")
    sizes = []

    def work(df):
        sizes.append(df.count())
        return df.withColumn("w", F.col("v") + 1)

    schema = "doc_id string, v int"
    for k in range(6):
        spark.createDataFrame([(f"d{k}", v) for v in range(5)], schema).coalesce(1).write.mode("append").parquet(source)
    stages.run_batches(spark, source, schema, work, target, check, rows_each=12, files_per_batch=1)
    assert sizes == [15, 15]
    assert tables.load(spark, target).count() == 30
    spark.createDataFrame([("d0", 9)], schema).write.mode("append").parquet(source)
    stages.run_batches(spark, source, schema, work, target, check, rows_each=12)
    assert sizes == [15, 15, 1] and sorted(r.v for r in tables.load(spark, target).where("doc_id = 'd0'").collect()) == [9]
    assert tables.load(spark, f"{target}-waiting").count() == 0

"""Retrieval, evaluation, rates, stored tables and streams."""

import random
import tempfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry import providers
from quarry.config import Config
from quarry.operators import answers, audit, evaluation, rates, retrieval, vectors
from quarry.sources import files, tables
from quarry.streaming import stages


def folder(name="x"):
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/" + name


def test_dense_ties_and_blocks(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, [0.0, 0.0])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "query_id int, query_embedding array<float>")
    for size in (2, 100):
        got = vectors.dense_top_k(v, q, 3, Config(query_block=size)).orderBy("query_id", "rank").collect()
        assert [(r.query_id, r.chunk_id, r.score) for r in got] == [(i, c, s) for i in range(5) for c, s in ((1, 1.0), (3, 1.0), (2, 0.0))]


def test_many_questions_read_the_index_once(spark):
    rng = random.Random(5)
    vec = lambda n: [[rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 3]))] for _ in range(n)]
    v = spark.createDataFrame([*enumerate(vec(300)), (900, None), (901, [])], "chunk_id int, embedding array<double>").repartition(5)
    q = spark.createDataFrame([*enumerate(vec(120)), (900, None)], "query_id int, query_embedding array<double>")
    one, many = (vectors.dense_top_k(v, q, 5, Config(query_block=n)) for n in (1000, 7))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("_slabs(") == 1 and "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
    assert vectors.dense_top_k(v.limit(0), q, 5, Config(query_block=7)).count() == 0


def test_identifiers(spark):
    qs = spark.createDataFrame([(1, "Resolução 1234 de 2021"), (2, "em 2021"), (3, "n. 2016"), (4, "artigo 1234")], "query_id int, question string")
    docs = spark.createDataFrame([("a", "ren1234_2021.pdf"), ("b", "ren1234_2020.pdf"), ("a", "ren1234_2021.pdf")], "doc_id string, arquivo string")
    got = sorted(map(tuple, retrieval.identifier_documents(qs, docs).collect()))
    assert got == [(1, "a"), (4, "a"), (4, "b")]


def test_candidates(spark):
    rows = [(1, f"c{i}", "dense", i) for i in range(1, 31)] + [(1, "x", "identifier", 1), (2, "y", "identifier", 1), (2, "c1", "dense", 1)]
    fused = retrieval.fuse(spark.createDataFrame(rows, "query_id int, chunk_id string, source string, rank int"))
    docs = spark.createDataFrame([(1, f"d{i}") for i in range(4)] + [(2, "d")], "query_id int, doc_id string")
    got = retrieval.candidates(fused, docs).collect()
    assert [r.chunk_id for r in got if r.query_id == 2] == ["y"]
    one = {r.chunk_id: r.position for r in got if r.query_id == 1}
    assert len(one) == 20 and one["c1"] == 1 and one["x"] == 2


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", ["x"]), ("b", []), ("c", ["z"])], "case_id string, expected_doc_ids array<string>")
    got = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, "x")], "case_id string, rank int, doc_id string")
    hits = evaluation.hits_at(cases, got)
    assert {r.case_id: (r.hit_at_1, r.hit_at_3) for r in hits.collect()} == {"a": (False, True), "b": (False, False), "c": (False, False)}
    assert evaluation.summary(hits).first().hit_at_3 == pytest.approx(1 / 3)


def test_judge(spark):
    replies = ["none", 'a {"score": 4, "rationale": "r"} b', '{"score": "3"}', '{"rationale": "q"}', "{bad}", '{"score": "x"}', "} {", None]
    score, rationale = evaluation.judge_reply(F.col("t"))
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in replies], "t string").select(score, rationale).collect()]
    assert got == [(None, "none"), (4.0, "r"), (3.0, ""), (0.0, "q"), (None, None), (None, None), (None, None), (None, None)]


def test_refusals_and_benchmark(spark):
    rows = [("não consta" + "x" * 290,), ("não consta" + "x" * 291,), ("sim",)]
    assert [r[0] for r in spark.createDataFrame(rows, "a string").select(evaluation.rejected(F.col("a"))).collect()] == [True, False, False]
    res = spark.createDataFrame([("b", 1, -1.0, False), ("a", 2, 2.0, True), ("a", 3, -1.0, False)], "category string, seq int, elapsed double, passed boolean")
    assert [tuple(r) for r in evaluation.benchmark_summary(res).collect()] == [("b", 1, 0, 1, 0.0), ("a", 2, 1, 2, 2.0)]


def test_rates(spark):
    ts = ["2024-01-01 00:00:00", "2024-01-01 00:01:00", "2024-01-01 00:01:00", "2024-01-01 00:01:30"]
    rows = spark.createDataFrame([(i, 1, pd.Timestamp(t).to_pydatetime()) for i, t in enumerate(ts)], "event_id int, user_id int, ts timestamp_ntz")
    got = {r.event_id: r.calls_60s for r in rates.trailing_counts(rows).collect()}
    assert got == {0: 1, 1: 2, 2: 2, 3: 3}
    got = {r.event_id: r.admitted for r in rates.admitted(rows, config=Config(calls_per_minute=1, calls_per_day=2)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False}


def test_rates_and_hits_gather_no_groups(spark):
    from quarry.plans import search

    rows = spark.range(25000).select(F.col("id").alias("event_id"), F.when(F.col("id") % 5 == 0, F.col("id") % 7).alias("user_id"), F.timestamp_seconds(F.col("id") * 40).alias("ts"))
    out = rates.admitted(rows, config=Config(calls_per_minute=1, calls_per_day=300))
    got, want, logs = {r.event_id: r.admitted for r in out.collect()}, {}, {}
    for i in range(25000):
        log = logs.setdefault(i % 7 if i % 5 == 0 else None, [])
        want[i] = (not log or i * 40 - log[-1] >= 60) and sum(i * 40 - t < 86400 for t in log[-300:]) < 300
        log.extend([i * 40] * want[i])
    assert got == want
    plans = [out, search.hit_at_k(spark, "/root/testdata/sf0.001")]
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "FlatMapGroups" not in plan and "collect_set" not in plan


def test_tables(spark):
    path = folder()
    assert tables.load(spark, path) is None
    rows = spark.createDataFrame([("a", 1), ("b", 1)], "doc_id string, v int")
    tables.replace_documents(rows, path)
    tables.replace_documents(spark.createDataFrame([("a", 2)], "doc_id string, v int"), path)
    assert {(r.doc_id, r.v) for r in tables.load(spark, path).collect()} == {("a", 2), ("b", 1)}
    old = tables.points(spark.createDataFrame([("c1", "a", "f"), ("c2", "b", "g")], "chunk_id string, doc_id string, arquivo string"))
    new = tables.upsert_points(old, old.where("chunk_id = 'c1'").withColumn("arquivo", F.lit("h")))
    assert tables.upsert_points(new, new).count() == 2
    assert {r.doc_id: r.arquivo for r in tables.document_index(new).collect()} == {"a": "h", "b": "g"}
    assert tables.without_documents(new, new.where("doc_id = 'a'")).count() == 1 and tables.count_points(new, "b") == 1


def test_cases(spark):
    path = folder("cases.jsonl")
    with open(path, "w") as f:
        f.write('{"question": "q"}\n\n{"id": "k", "question": "r", "expected_doc_ids": ["a"]}\n{"question": "s"}\n')
    got = tables.read_cases(spark, path).orderBy("question").collect()
    assert [(r.case_id, r.expected_doc_ids) for r in got] == [("case_0000", []), ("k", ["a"]), ("case_0003", [])]


def test_files(spark):
    path = folder("d")
    import os

    os.makedirs(path)
    for name, data in (("a__0123456789.pdf", b"%PDF-1"), ("b__9876543210.pdf", b"html")):
        with open(f"{path}/{name}", "wb") as f:
            f.write(data)
    got = {r.suffix: r.is_pdf for r in files.read_documents(spark, path).collect()}
    assert got == {"0123456789": True, "9876543210": False}
    with open(f"{path}/x_2020_metadados.json", "w") as f:
        f.write('{"b": {"registros": [{"pdfs": [{"url": "http://h/q.pdf"}]}]}}')
    assert files.read_metadata(spark, f"{path}/x_2020_metadados.json").first().ano == 2020
    todo = spark.createDataFrame([("a", "http://h/a"), ("b", "boom")], "doc_id string, url string")

    def fetch(url):
        if url == "boom":
            raise OSError("x" * 500)
        return url.encode()

    got = {r.doc_id: (r.content, r.status, len(r.error or "")) for r in files.fetched(todo, fetch, tries=1).collect()}
    assert got == {"a": (b"https://h/a", "ok", 0), "b": (None, "error", 240)}


def test_answers(spark):
    hit = [(1, 1, "d", None, None, None, "V", "Art. 1", True, 0, 1, "text", "u", 0.5)]
    hits = spark.createDataFrame(hit, "query_id int, final_rank int, doc_id string, titulo string, ano int, autor string, situacao_doc string, article_ref string, has_revoked boolean, page_start int, page_end int, text string, url string, score double")
    assert retrieval.context(hits).first().context == "[1] doc_id=d | titulo=None | ano=None | autor=None | situacao_doc=V | art=Art. 1 | has_revoked=True | pg 0-1\ntext"
    done = answers.answer(hits, spark.createDataFrame([(1, "q?"), (2, "none")], "query_id int, question string"))
    out = done.orderBy("query_id").collect()
    assert out[0].citations[0].doc_id == "d" and out[1].citations is None
    assert [r.passed for r in answers.benchmark_passed(done).orderBy("query_id").collect()] == [True, False]
    with pytest.raises(ValueError):
        answers.checked(hits, 51)


def test_providers():
    calls = []

    class Bad:
        def generate(self, system, user):
            calls.append(1)
            raise OSError

    f = providers.Fallback(Bad(), providers.Extract())
    assert f.generate("", "q\nbody") == "body" and f.generate("", "q\nbody") == "body" and len(calls) == 1
    with pytest.raises(OSError):
        providers.with_retries(lambda: Bad().generate("", ""), 3, sleep=lambda s: None)


def test_audit(spark):
    cat = spark.createDataFrame([("a", "ok", "ok", "ok"), ("b", "error", "ok", "pending")], "doc_id string, status_download string, status_parse string, status_chunk string")
    pages = spark.createDataFrame([("a", "digital", True, ["t"], 5)], "doc_id string, classification string, has_revoked boolean, tables_markdown array<string>, char_count int")
    none = spark.createDataFrame([], "doc_id string, has_table boolean, has_revoked boolean, text string, chunk_index int")
    points = spark.createDataFrame([("b",)], "doc_id string")
    got = {(r.doc_id, r.issue) for r in audit.issues(audit.document_audit(cat, pages, none, points)).collect()}
    assert got == {("a", "chunked without chunks"), ("a", "struck-out text lost"), ("b", "chunks and points differ"), ("b", "not downloaded"), ("b", "parsed without pages")}


def test_stream(spark):
    source, target, check = folder("s"), folder("t"), folder("c")
    for part in ([("a", 1), ("b", 2)], [("b", 2), ("c", 3)]):
        spark.createDataFrame(part, "doc_id string, v int").write.mode("append").parquet(source)
        stages.run_stage(spark, source, "doc_id string, v int", lambda df: df.withColumn("w", F.col("v") * 2), target, check).awaitTermination(60)
    assert sorted((r.doc_id, r.w) for r in tables.load(spark, target).collect()) == [("a", 2), ("b", 4), ("c", 6)]


def test_lines_are_numbered_over_splits(spark):
    path = folder("lines.txt")
    want = [f"line {k} " + "x" * (k % 90) if k % 13 else "" for k in range(4000)]
    with open(path, "w") as f:
        f.write("\n".join(want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = tables.numbered_lines(spark, path)
        assert {r.n: r.line for r in got.collect()} == dict(enumerate(want))
        assert spark.read.text(path).rdd.getNumPartitions() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_a_compacted_store_skips_row_groups(spark):
    from quarry.sources import store

    path = folder("store")
    rows = spark.range(200_000).select(F.md5(F.col("id").cast("string")).alias("doc_id"), (F.col("id") % 20).cast("int").alias("ano"), F.repeat(F.col("id").cast("string"), 4).alias("text"))
    store.write(rows.repartition(4, "doc_id"), path)
    store.compact(spark, path, sort=("ano",), bloom=("doc_id",))

    def read(where):
        """Rows that the scan hands on."""
        df = store.read(spark, path).where(where)
        assert df.count() >= 1
        plan = df._jdf.queryExecution().executedPlan()
        df.write.format("noop").mode("overwrite").save()
        found = df.select("doc_id", "ano", "text")
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        return leaves.apply(0).metrics().apply("numOutputRows").value(), plan

    assert read("ano = 3")[0] < 100_000
    one = rows.where("id = 77").first().doc_id
    assert read(f"doc_id = '{one}' AND ano = 17")[0] < 100_000

"""Stored postings, clustered vectors, interval joins and the store of deltas against plain ways."""

import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.config import Config
from quarry.operators import clusters, pages, sparse_index, vectors
from quarry.sources import store


def folder(name="x"):
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/" + name


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def plain(got):
    return sorted((r.query_id, r.chunk_id, r.score, r["rank"]) for r in got.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    docs = [(i, " ".join(["all", *rng.choices(words, [1 / (k + 1) for k in range(400)], k=rng.randrange(1, 120))])) for i in range(1500)]
    docs += [(2000 + i, "rare needle needle") for i in range(3)] + [(3000, None), (3001, "")]
    return spark.createDataFrame(docs, "doc_id int, text string").repartition(3)


def index_of(spark, corpus):
    path = folder("index")
    sparse_index.write(sparse_index.blocks(vectors.postings(corpus, "doc_id", "text").withColumnRenamed("doc_id", "chunk_id")), path)
    return sparse_index.read(spark, path)


def test_stored_postings(spark, corpus):
    index = index_of(spark, corpus)
    assert index.agg(F.max(F.size("postings"))).first()[0] <= sparse_index.RANGE and index.where("term = 'all'").count() > 5
    asked = [(1, "needle"), (2, "all"), (3, "w0 w1 w1 w250"), (4, "none"), (5, ""), (6, "w399 all all"), (7, "needle w3")]
    q = vectors.postings(spark.createDataFrame(asked, "query_id int, text string"), "query_id", "text")
    for k in (1, 10, 2000):
        assert plain(sparse_index.top_k(index, q, k)) == plain(vectors.sparse_top_k(vectors.term_lists(corpus, "doc_id", "text"), q, k))
    read = {r.kind: r.postings for r in sparse_index.rows_read(index, q.where("query_id IN (1, 4, 7)"), 3).collect()}
    assert read["read"] < 0.05 * read["stored"] and read["read"] < 0.5 * read["of_terms"]
    read = {r.kind: r.postings for r in sparse_index.rows_read(index, q.where("query_id = 2"), 10).collect()}
    assert read["stored"] > read["of_terms"] >= read["read"]
    assert sparse_index.top_k(index, q.limit(0), 3).count() == 0


def test_texts_are_shuffled_in_place_of_their_terms(spark, corpus):
    rows = vectors.postings(corpus, "doc_id", "text").groupBy("doc_id", "term").agg(F.sum("weight"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Generate") < plan.index("Exchange hashpartitioning")  # the shuffle is below


def test_stored_postings_of_some_documents(spark, corpus, monkeypatch):
    index = index_of(spark, corpus)
    q = vectors.postings(spark.createDataFrame([(1, "w0 w7"), (2, "needle all")], "query_id int, text string"), "query_id", "text")
    some = corpus.where("doc_id % 7 = 3").select(F.col("doc_id").alias("chunk_id"))
    want = plain(vectors.sparse_top_k(vectors.term_lists(corpus.where("doc_id % 7 = 3"), "doc_id", "text"), q, 12))
    assert plain(sparse_index.top_k(index, q, 12, some)) == want
    monkeypatch.setattr(sparse_index, "LOOKED_UP", 1)  # a join in place of the filter
    assert plain(sparse_index.top_k(index, q, 12, some)) == want


def test_lookup_reaches_the_files(spark, corpus):
    index = index_of(spark, corpus)
    q = vectors.postings(spark.createDataFrame([(1, "needle")], "query_id int, text string"), "query_id", "text")
    _, found = sparse_index._asked(index, q)
    assert "PushedFilters: [In(term, [needle])]" in found._jdf.queryExecution().executedPlan().toString().replace("EqualTo(term,needle)", "In(term, [needle])").replace("IsNotNull(term), ", "")


def test_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(12, 16)) * 3
    points = [(int(i), (centers[i % 12] + rng.normal(size=16) * 0.3).astype(np.float32).tolist()) for i in range(3000)]
    points += [(3000, [0.0] * 16), (3001, None), (3002, [None] * 16), (None, [1.0] * 16)] + [(4000 + i, points[5][1]) for i in range(40)]  # copies
    v = spark.createDataFrame(points, "chunk_id int, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, points[i * 7][1]) for i in range(60)] + [(60, [0.0] * 16), (61, [1.0] * 5), (62, None)], "query_id int, query_embedding array<float>")
    layout = clusters.laid_out(v, folder("dense"), 24)
    whole = v.where("chunk_id IS NOT NULL AND embedding IS NOT NULL AND chunk_id <> 3002")
    for k in (1, 10, 4000):
        assert plain(clusters.top_k(layout, q, k)) == plain(vectors.dense_top_k(whole, q.where("query_id < 61"), k))
    again = clusters.read(spark, layout.slabs.inputFiles()[0].split("/slabs")[0])
    assert again.dims == 16 and plain(clusters.top_k(again, q.limit(3), 5)) == plain(vectors.dense_top_k(whole, q.limit(3), 5))
    shares = [r.read / r.of for r in clusters.clusters_read(layout, q.where("query_id < 60"), 10).collect()]
    assert len(shares) == 60 and np.mean(shares) < 0.25
    with pytest.raises(ValueError):
        clusters.laid_out(v.union(spark.createDataFrame([(9, [1.0])], v.schema)), folder("odd"))
    none = clusters.laid_out(v.limit(0), folder("none"))
    assert clusters.top_k(none, q, 3).count() == 0


def test_only_needed_clusters_are_scanned(spark):
    points = [(i, [float(i % 2), float(1 - i % 2), 0.001 * i]) for i in range(200)]
    layout = clusters.laid_out(spark.createDataFrame(points, "chunk_id int, embedding array<float>"), folder("dense"), 2)
    _, first, rest = clusters.choices(layout, spark.createDataFrame([(1, [1.0, 0.0, 0.0])], "query_id int, query_embedding array<float>"), 3)
    assert first.count() == 1 and rest.count() == 0
    plan = clusters._products(layout, first, 3, 6)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cluster" in plan or "PartitionFilters: [(cluster" in plan or "PartitionFilters: [cluster" in plan


def brute(spans, marks, cover=0.55, strike=0.45):
    out = set()
    for s in spans:
        for m in marks:
            if s[:2] != m[:2]:
                continue
            x0, y0, x1, y1 = s[4:]
            a, b, c, d = m[3:]
            overlap = max(0.0, min(x1, c) - max(x0, a))
            if m[2] == "line":
                mid, reach = (y0 + y1) / 2, (y1 - y0) * strike
                hit = x1 > x0 and mid - reach <= (b + d) / 2 <= mid + reach and overlap / (x1 - x0) >= cover
            else:
                hit = m[2] == "annotation" and c >= x0 and a <= x1 and d >= y0 and b <= y1 and overlap / max(1e-6, x1 - x0) >= cover
            if hit:
                out.add(s[2:4])
    return out


SPANS = "doc_id string, page_index int, line_no int, span_no int, x0 double, y0 double, x1 double, y1 double"
MARKS = "doc_id string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("cover", [0.55, 0.3])
def test_struck_in_bands(spark, cover):
    rng = random.Random(9)
    wide = lambda: rng.choice([0.0, 1.0, 8.0, 8.0, 8.0, 100.0, 5000.0])
    spans, marks = [], []
    for i in range(400):
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), wide(), wide()
        spans.append((f"d{i % 3}", i % 2, i, 0, x, y, x + w * rng.choice([1, 1, 1, -1]), y + h * rng.choice([1, 1, 1, -1])))
        x, y, w, h = rng.uniform(-300, 300), rng.uniform(-300, 300), wide(), wide()
        marks.append((f"d{i % 4}", i % 2, rng.choice(["line", "annotation", "other"]), x, y, x + w, y + h * rng.choice([0, 1, -1])))
    spans += [("d0", 0, 900, 0, None, 1.0, 2.0, 3.0), ("d0", 0, 901, 0, float("nan"), 1.0, 2.0, 3.0), ("d0", 0, 902, 0, 0.0, 0.0, float("inf"), 3.0), ("d0", 0, 903, 0, 0.0, 0.0, 8.0, 8.0)]
    marks += [("d0", 0, "line", 0.0, 4.0, 8.0, 4.0), ("d0", 0, "line", 0.0, None, 8.0, 4.0)]
    config = Config(strike_coverage=cover)
    got = pages.struck(spark.createDataFrame(spans, SPANS), spark.createDataFrame(marks, MARKS), config).collect()
    assert len(got) == len(spans)
    clean = lambda rows: [r for r in rows if all(v is not None and abs(v) < 1e12 for v in r[-4:])]
    assert {(r.line_no, r.span_no) for r in got if r.revoked} == brute(clean(spans), clean(marks), cover)


def test_a_page_of_very_many_spans_and_marks(spark):
    n = 100_000  # 1,000 lines of 100 words; every fourth word is struck out
    x, y = (F.col("id") % 100) * 20.0, F.floor(F.col("id") / 100) * 12.0
    spans = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit(0).alias("page_index"), F.floor(F.col("id") / 100).cast("int").alias("line_no"), (F.col("id") % 100).cast("int").alias("span_no"), x.alias("x0"), y.alias("y0"), (x + 18).alias("x1"), (y + 10).alias("y1"))
    marks = spans.select("doc_id", "page_index", F.lit("line").alias("kind"), "x0", (F.col("y0") + 5).alias("y0"), (F.col("x1") - F.when(F.col("span_no") % 4 == 0, 0).otherwise(12)).alias("x1"), (F.col("y0") + 5.5).alias("y1"))
    assert pages.strike_pairs(spans, marks).count() < 10 * n
    assert pages.struck(spans, marks).where("revoked").count() == n // 4


def state(spark, path):
    return sorted((r.doc_id, r.v) for r in store.read(spark, path).collect())


def test_store_of_deltas(spark):
    path = folder("store")
    assert store.read(spark, path) is None and not store.exists(spark, path)
    store.write(spark.range(20_000).select(F.format_string("d%05d", "id").alias("doc_id"), F.col("id").alias("v")), path)
    before = size(path)
    ten = spark.range(10).select(F.format_string("d%05d", F.col("id") * 7).alias("doc_id"), F.lit(-1).cast("long").alias("v"))
    store.write(ten.coalesce(1), path)
    assert size(path) - before < before / 10
    want = {(f"d{k:05d}", k) for k in range(20_000)} - {(f"d{k * 7:05d}", k * 7) for k in range(10)} | {(f"d{k * 7:05d}", -1) for k in range(10)}
    assert state(spark, path) == sorted(want)
    gone = spark.createDataFrame([("d00000",), ("d00001",)], "doc_id string")
    store.delete(gone, path)
    store.write(spark.createDataFrame([("d00002", 5), ("d00002", 6)], "doc_id string, v long"), path, spark.createDataFrame([("d00003",)], "doc_id string"))
    want = {(d, v) for d, v in want if d not in ("d00000", "d00001", "d00002", "d00003")} | {("d00002", 5), ("d00002", 6)}
    assert state(spark, path) == sorted(want)
    os.makedirs(f"{path}/rows/seq=9")  # a batch that failed
    spark.createDataFrame([("d00002", 99)], "doc_id string, v long").write.parquet(f"{path}/rows/seq=8")
    assert state(spark, path) == sorted(want)
    number = store.compact(spark, path, sort=("v",), bloom=("doc_id",))
    assert number == 4 == store.compact(spark, path) and state(spark, path) == sorted(want)
    store.vacuum(spark, path)
    assert state(spark, path) == sorted(want) and not os.path.exists(f"{path}/rows/seq=1")
    assert store.write(spark.createDataFrame([("new", 1)], "doc_id string, v long"), path) == 10
    assert state(spark, path) == sorted(want | {("new", 1)})


def test_store_takes_new_columns(spark):
    path = folder("store")
    store.write(spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v long"), path)
    store.write(spark.createDataFrame([("b", 3, "x")], "doc_id string, v long, more string"), path)
    assert sorted((r.doc_id, r.v, r.more) for r in store.read(spark, path).collect()) == [("a", 1, None), ("b", 3, "x")]
    store.compact(spark, path)
    store.write(spark.createDataFrame([("a", 4)], "doc_id string, v long"), path)
    assert sorted((r.doc_id, r.v, r.more) for r in store.read(spark, path).collect()) == [("a", 4, None), ("b", 3, "x")]

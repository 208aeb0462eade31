"""Vectors laid out by cluster, and exact cosine top-k that skips clusters and their files.

Centroids are fitted once, on a bounded sample. Every vector lies in the
cluster of its nearest centroid, which knows how far its vectors reach. By the triangle
inequality no vector of a cluster is nearer to a query than the distance to the
centroid less that reach; clusters that can't hold one of a query's k best aren't read.

A cluster is stored in slabs of SLAB vectors, a row each, in a folder of its own.
Queries meet slabs in an equi-join on the cluster, as blocks of BLOCK queries, and
a task multiplies one such pair of matrices at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.operators.vectors import norm, ranked
from quarry.session import cut

#: Vectors that centroids are fitted on, centroids at most, and rounds of fitting.
SAMPLE, MOST, ROUNDS = 20_000, 1024, 8
SLAB, BLOCK = 1024, 256
#: What rounding can add to a score: bounds are in doubles, stored vectors are doubles of unit length.
SLACK = 1e-9


@dataclass(frozen=True)
class Layout:
    """The slabs (cluster, slab, keys, matrix) and the clusters (cluster, center, reach, n; MOST at most)."""

    slabs: DataFrame
    clusters: DataFrame
    dims: int


def unit(embedding: Column) -> Column:
    """Doubles of unit length; vectors of no length become zeros, which score 0."""
    size = norm(embedding)
    return F.transform(embedding, lambda x: F.coalesce(F.when(size > 0, x.cast("double") / size), F.lit(0.0)))


def fitted(vectors: DataFrame, clusters: int, seed: int = 7) -> np.ndarray:
    """Centroids of a sample of SAMPLE unit vectors at most, by Lloyd's rounds from distinct vectors."""
    total = vectors.count()
    # A hash takes about SAMPLE of them, and the same ones every time.
    share = F.pmod(F.xxhash64("chunk_id"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, 0.9 * SAMPLE / max(total, 1)))
    rows = vectors.where(share).select("unit").limit(SAMPLE).toArrow()
    if not rows.num_rows:
        return np.zeros((1, 0))
    points = np.unique(_matrix(rows["unit"].combine_chunks()), axis=0)
    rng = np.random.default_rng(seed)
    centers = points[rng.choice(len(points), min(clusters, len(points)), replace=False)]
    for _ in range(ROUNDS):
        nearest = _nearest(points, centers)[0]
        sums, counts = np.zeros_like(centers), np.bincount(nearest, minlength=len(centers))
        np.add.at(sums, nearest, points)
        centers = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centers)
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, and the distance to it, of each point."""
    half = (centers * centers).sum(axis=1) / 2
    which = np.concatenate([np.argmax(points[a : a + 4096] @ centers.T - half, axis=1) for a in range(0, max(len(points), 1), 4096)])
    return which, np.sqrt(((points - centers[which]) ** 2).sum(axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def laid_out(vectors: DataFrame, path: str, clusters: int | None = None) -> Layout:
    """Writes ``vectors`` (chunk_id, embedding) under ``path`` by cluster.

    All vectors must have one length, else it is an error; rows without a vector, with a
    null in it or without a chunk_id take no part. ``clusters`` is the root of the
    number of vectors unless given, MOST at most.
    """
    whole = F.col("embedding").isNotNull() & F.col("chunk_id").isNotNull() & ~F.exists("embedding", lambda x: x.isNull())
    rows = cut(vectors.where(whole).select("chunk_id", unit(F.col("embedding")).alias("unit")))
    sizes = [r.n for r in rows.select(F.size("unit").alias("n")).distinct().limit(2).collect()]
    if len(sizes) > 1:
        raise ValueError("a layout is for vectors of one length")
    spark, dims = vectors.sparkSession, sizes[0] if sizes else 0
    centers = fitted(rows, clusters or max(1, min(MOST, math.isqrt(rows.count()))))
    key = dict(rows.dtypes)["chunk_id"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                which, far = _nearest(_matrix(batch.column(1)), centers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(which.astype(np.int32)), pa.array(far)], ["chunk_id", "unit", "cluster", "far"])

    dealt = cut(rows.mapInArrow(assign, f"chunk_id {key}, unit array<double>, cluster int, far double"))
    reach = dealt.groupBy("cluster").agg(F.max("far").alias("reach"), F.count("*").alias("n"))
    names = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "cluster int, center array<double>")
    names.join(reach, "cluster").coalesce(1).write.mode("overwrite").parquet(f"{path}/clusters")
    # Slabs are numbered by sorted ranges, so a cluster of very many vectors is many rows of many tasks.
    placed = dealt.repartitionByRange("cluster", "far", "chunk_id").sortWithinPartitions("cluster", "far", "chunk_id").withColumn("_id", F.monotonically_increasing_id())
    slabs = placed.groupBy("cluster", (F.col("_id") - F.col("_id") % SLAB).alias("slab")).agg(F.collect_list("chunk_id").alias("keys"), F.flatten(F.collect_list("unit")).alias("matrix"))
    slabs.write.mode("overwrite").partitionBy("cluster").parquet(f"{path}/slabs")
    return read(spark, path, dims)


def read(spark: SparkSession, path: str, dims: int | None = None) -> Layout:
    clusters = spark.read.parquet(f"{path}/clusters")
    if dims is None:
        first = clusters.select(F.size("center").alias("n")).first()
        dims = first.n if first else 0
    if clusters.isEmpty():
        return Layout(spark.createDataFrame([], "cluster int, slab long, keys array<long>, matrix array<double>"), clusters, dims)
    return Layout(spark.read.parquet(f"{path}/slabs"), clusters, dims)


def _bounds(layout: Layout):
    """A function that gives for unit queries the highest score that each cluster can hold; centroids are MOST at most."""
    rows = layout.clusters.orderBy("cluster").collect()
    ids, counts = np.array([r.cluster for r in rows], np.int64), np.array([r.n for r in rows], np.int64)
    centers, reach = np.array([r.center for r in rows], np.float64).reshape(len(rows), layout.dims), np.array([r.reach for r in rows])

    def of(units: np.ndarray) -> np.ndarray:
        far = np.sqrt(np.maximum(0, (units * units).sum(axis=1)[:, None] + (centers * centers).sum(axis=1) - 2 * units @ centers.T))
        return 1 - np.maximum(0, far - reach - 1e-7) ** 2 / 2

    return ids, counts, of


def _chosen(layout: Layout, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, unit, cluster) to be read for queries (query_id, unit, kth, first).

    Without a k-th score (``first``) the clusters of the highest bounds that hold
    k vectors; else all others that can reach it.
    """
    ids, counts, bounds = _bounds(layout)
    names = ["query_id", "unit", "kth", "first"]
    kind = dict(queries.dtypes)["query_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                units = _matrix(batch.column(1))
                top = bounds(units)
                order = np.argsort(-top, axis=1, kind="stable")
                early = np.zeros(top.shape, bool)
                before = np.cumsum(counts[order], axis=1) - counts[order]
                np.put_along_axis(early, order, before < k, axis=1)
                first = batch.column(3).to_numpy(zero_copy_only=False)
                kth = batch.column(2).fill_null(-2.0).to_numpy(zero_copy_only=False)
                want = np.where(first[:, None], early, ~early & (top >= kth[:, None] - SLACK))
                row, col = np.nonzero(want)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), pa.array(ids[col].astype(np.int32))], ["query_id", "unit", "cluster"])

    return queries.select(*names).mapInArrow(run, f"query_id {kind}, unit array<double>, cluster int")


def _products(layout: Layout, chosen: DataFrame, k: int, decimals: int) -> DataFrame:
    """(query_id, chunk_id, score): of each slab the k best of each query that chose its cluster."""
    kinds = dict(chosen.dtypes) | {"keys": dict(layout.slabs.dtypes)["keys"][6:-1]}
    number = F.floor((F.row_number().over(Window.partitionBy("cluster", F.pmod(F.xxhash64("query_id"), F.lit(64))).orderBy("query_id")) - 1) / BLOCK)
    blocks = chosen.withColumn("_b", F.struct(F.pmod(F.xxhash64("query_id"), F.lit(64)), number)).groupBy("cluster", "_b").agg(F.collect_list("query_id").alias("asked"), F.flatten(F.collect_list("unit")).alias("units")).drop("_b")
    blocks = cut(blocks)
    needed = [r.cluster for r in blocks.select("cluster").distinct().collect()]  # MOST at most
    pairs = layout.slabs.where(F.col("cluster").isin(needed)).join(blocks, "cluster").select("keys", "matrix", "asked", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                keys, matrix, asked, units = (whole.column(c)[i].values for c in range(4))
                scores = np.round(matrix.to_numpy().reshape(len(keys), -1) @ units.to_numpy().reshape(len(asked), -1).T, decimals) + 0.0
                least = max(0, len(keys) - k)
                row, query = np.nonzero(scores >= np.partition(scores, least, axis=0)[least])
                place = np.empty(len(keys), np.int64)
                place[pa.compute.sort_indices(keys).to_numpy()] = np.arange(len(keys))
                by = np.lexsort((place[row], -scores[row, query], query))
                row, query = row[by], query[by]
                keep = np.arange(len(query)) - np.searchsorted(query, query) < k
                row, query = row[keep], query[keep]
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(query)), keys.take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "chunk_id", "score"])

    return pairs.mapInArrow(run, f"query_id {kinds['query_id']}, chunk_id {kinds['keys']}, score double")


def _prepared(layout: Layout, queries: DataFrame) -> DataFrame:
    fits = F.size("query_embedding") == layout.dims
    return cut(queries.where(fits & ~F.exists("query_embedding", lambda x: x.isNull())).select("query_id", unit(F.col("query_embedding")).alias("unit")))


def choices(layout: Layout, queries: DataFrame, k: int, decimals: int = 6) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores in the first clusters, and (query_id, unit, cluster) of those read first and those read after them."""
    asked = _prepared(layout, queries)
    first = cut(_chosen(layout, asked.withColumns({"kth": F.lit(None).cast("double"), "first": F.lit(True)}), k))
    scores = cut(ranked(_products(layout, first, k, decimals), "query_id", "score", "chunk_id", k))
    # Scores are rounded, so a bound may lie half a step below the k-th.
    kth = scores.where(F.col("rank") == k).select("query_id", (F.col("score") - 0.5 * 10**-decimals).alias("kth"))
    rest = cut(_chosen(layout, asked.join(kth, "query_id", "left").withColumn("first", F.lit(False)), k))
    return scores, first, rest


def top_k(layout: Layout, queries: DataFrame, k: int = DEFAULT.dense_k, decimals: int = 6) -> DataFrame:
    """query_id, chunk_id, score (cosine) and rank, the same rows as vectors.dense_top_k() gives.

    Queries of another length than the layout's, or with nulls, have no rows.
    """
    scores, _, rest = choices(layout, queries, k, decimals)
    return ranked(scores.drop("rank").unionByName(_products(layout, rest, k, decimals)), "query_id", "score", "chunk_id", k)


def clusters_read(layout: Layout, queries: DataFrame, k: int = DEFAULT.dense_k) -> DataFrame:
    """(query_id, read, of): vectors in the clusters that each query reads, and all vectors."""
    _, first, rest = choices(layout, queries, k)
    total = layout.clusters.agg(F.sum("n")).first()[0] or 0
    rows = first.unionByName(rest).join(layout.clusters.select("cluster", "n"), "cluster")
    return rows.groupBy("query_id").agg(F.sum("n").alias("read")).withColumn("of", F.lit(total))

"""Exact top-k inner products by branch and bound over a ball tree in each shard.

Vectors go to shards of bounded size by regions of space, so that a shard's balls
are small; each shard is one row that holds its ball tree. Queries go in blocks of bounded size, and each pair of a block and a shard
is one row of work. A first round reads, for each query, the most promising leaf
of each shard; the k-th best score of those is a score that every shard may
prune by. The second round visits nodes in the order of their upper bound
(query times centre plus query norm times radius) until the bound is below the
better of the shared and the shard's own k-th score.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.session import cut, table

LEAF, SHARD_ROWS, BLOCK_ROWS = 64, 2048, 2048
#: Vectors that the shards' regions are fitted on; all vectors are searched.
SAMPLE = 16_384
#: Vectors whose squared norm is at most this have inner products that float64 holds exactly.
EXACT = 2.0**52


class BallTree:
    """Nodes as arrays; a leaf holds rows ``first`` to ``last``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order, self.nodes = np.arange(len(ids)), []
        work = [(0, len(ids), -1, 0)]
        x = vectors.astype(np.float64)
        while work:
            lo, hi, parent, side = work.pop()
            rows = order[lo:hi]
            centre = x[rows].mean(axis=0)
            away = ((x[rows] - centre) ** 2).sum(axis=1)
            me = len(self.nodes)
            self.nodes.append([lo, hi, -1, -1, centre, math.sqrt(away.max())])
            if parent >= 0:
                self.nodes[parent][2 + side] = me
            if hi - lo > leaf and away.max() > 0:
                # Two far points; the rest goes to the nearer half along their line.
                a = x[rows[int(away.argmax())]]
                b = x[rows[int(((x[rows] - a) ** 2).sum(axis=1).argmax())]]
                along = (x[rows] - a) @ (b - a)
                order[lo:hi] = rows[np.argsort(along, kind="stable")]
                mid = (lo + hi) // 2
                work += [(lo, mid, me, 0), (mid, hi, me, 1)]
        self.ids, self.vectors = ids[order], vectors[order]
        self.centres = np.array([n[4] for n in self.nodes])
        self.radii = np.array([n[5] for n in self.nodes])
        self.nodes = [tuple(n[:4]) for n in self.nodes]
        self.exact = float((self.vectors.astype(np.float64) ** 2).sum(axis=1).max(initial=0)) <= EXACT
        if self.exact:
            self.vectors = self.vectors.astype(np.float64)

    def scores(self, query: np.ndarray, lo: int, hi: int) -> np.ndarray:
        part = self.vectors[lo:hi]
        if self.exact and float(query.astype(np.float64) @ query.astype(np.float64)) <= EXACT:
            return (part @ query.astype(np.float64)).astype(np.int64)
        return part.astype(np.int64) @ query

    def bounds(self, query: np.ndarray) -> np.ndarray:
        q = query.astype(np.float64)
        top = self.centres @ q + math.sqrt(q @ q) * self.radii
        return top + 1e-9 * np.abs(top) + 1e-3  # for rounding

    def search(self, query: np.ndarray, query_id: int, k: int, floor: int | None, first_leaf: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores that can be among the k best; scores below ``floor`` can't."""
        bounds = self.bounds(query)
        heap = [(-bounds[0], 0)]
        found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while heap:
            top, node = heapq.heappop(heap)
            if floor is not None and -top < floor:
                break
            lo, hi, left, right = self.nodes[node]
            if left >= 0:
                heapq.heappush(heap, (-bounds[left], left))
                heapq.heappush(heap, (-bounds[right], right))
                continue
            ids, s = self.ids[lo:hi], self.scores(query, lo, hi)
            keep = ids != query_id
            if floor is not None:
                keep &= s >= floor
            found_ids, found = np.concatenate([found_ids, ids[keep]]), np.concatenate([found, s[keep]])
            if len(found) > k:
                best = np.lexsort((found_ids, -found))[:k]
                found_ids, found = found_ids[best], found[best]
            if len(found) == k:
                floor = int(found.min()) if floor is None else max(floor, int(found.min()))
            if first_leaf:
                break
        return found_ids, found


class Regions:
    """Halves of space from a sample of vectors: rows near each other get the same number.

    ``depth`` splits along the line of two far points, as in the trees; a region's
    number is the path of its splits.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth, self.splits = depth, {}
        work = [(1, np.arange(len(sample)))]
        x = sample.astype(np.float64)
        while work:
            node, rows = work.pop()
            if node >= 1 << depth or len(rows) < 2:
                continue
            away = ((x[rows] - x[rows].mean(axis=0)) ** 2).sum(axis=1)
            a = x[rows[int(away.argmax())]]
            b = x[rows[int(((x[rows] - a) ** 2).sum(axis=1).argmax())]]
            along = x[rows] @ (b - a)
            at = float(np.median(along))
            if not away.max() or not (along > at).any():
                continue
            self.splits[node] = (b - a, at)
            work += [(2 * node, rows[along <= at]), (2 * node + 1, rows[along > at])]

    def of(self, vectors: np.ndarray) -> np.ndarray:
        nodes = np.ones(len(vectors), np.int64)
        for level in range(self.depth):
            for node in np.unique(nodes[nodes >= 1 << level]).tolist():
                if node in self.splits and node < 1 << (level + 1):
                    line, at = self.splits[node]
                    rows = np.flatnonzero(nodes == node)
                    nodes[rows] = 2 * node + (vectors[rows].astype(np.float64) @ line > at)
        return nodes


def _sharded(vectors: DataFrame, rows: int, total: int) -> DataFrame:
    """``vectors`` with a shard of about ``rows`` rows: by length, then by region, and a region of more rows by number.

    Regions come from SAMPLE vectors of the commonest length at most; only how
    well bounds prune depends on them. Every row has a number of its own, written down
    first, so copies spread over shards like others.
    """
    tagged = cut(vectors.select("vec_id", "vector", F.size("vector").alias("_n"), F.monotonically_increasing_id().alias("_tie")))
    lengths = tagged.groupBy("_n").count().orderBy(F.desc("count"), "_n").limit(1).collect()
    dims, depth = lengths[0]["_n"], min(12, max(0, math.ceil(math.log2(max(1, total / rows)))))
    share = F.pmod(F.xxhash64("vec_id", "_tie"), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, 0.9 * SAMPLE / total))
    sample = tagged.where((F.col("_n") == dims) & share).select("vector").limit(SAMPLE).toArrow()
    regions = Regions(np.array(sample["vector"].to_pylist(), np.int64).reshape(sample.num_rows, -1), depth)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = np.zeros(batch.num_rows, np.int64)
            fits = np.flatnonzero(batch.column(2).to_numpy() == dims)
            if len(fits):
                part = batch.column(1).take(pa.array(fits))
                where[fits] = regions.of(part.flatten().to_numpy().reshape(len(fits), -1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(where)], [*batch.schema.names, "_region"])

    placed = cut(tagged.mapInArrow(assign, "vec_id bigint, vector array<bigint>, _n int, _tie bigint, _region bigint"))
    parts = placed.groupBy("_n", "_region").agg(F.ceil(F.count("*") / rows).alias("_parts"))
    sub = F.pmod(F.xxhash64("vec_id", "_tie"), F.col("_parts"))
    return placed.join(parts, ["_n", "_region"]).select("vec_id", "vector", "_n", F.concat_ws(":", "_n", "_region", sub).alias("shard"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for columns (vec_id bigint, vector array<bigint>).

    All vectors of ``vectors`` are candidates of each row of ``queries``, but for
    those with the query's own id. Ties go to the smaller id. Rows whose id or
    vector is null take no part; vectors meet the queries of their own length.
    Repeated rows are candidates each, with a rank each; of several query rows with
    one id the best of all their scores count. Further columns are ignored. Empty
    tables give an empty result.
    """
    full = lambda df: df.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0").select("vec_id", "vector")
    vectors, queries = full(vectors), full(queries)
    n, m = vectors.count(), queries.count()
    if not n or not m:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    blocks = math.ceil(m / block_rows)

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        tree = BallTree(pdf["vec_id"].to_numpy(), np.stack(pdf["vector"].to_list()).astype(np.int64))
        return pd.DataFrame({"shard": [key[0]], "_n": [len(pdf["vector"].iloc[0])], "tree": [pickle.dumps(tree)]})

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        return pd.DataFrame({"block": [key[0]], "_n": [len(pdf["vector"].iloc[0])], "asked": [pickle.dumps((pdf["vec_id"].to_numpy(), np.stack(pdf["vector"].to_list()).astype(np.int64)))]})

    trees = cut(_sharded(vectors, shard_rows, n).groupBy("shard").applyInPandas(build, "shard string, _n int, tree binary"))
    tagged = cut(queries.withColumn("_tie", F.monotonically_increasing_id()))
    block = F.concat_ws(":", F.size("vector"), F.pmod(F.xxhash64("vec_id", "_tie"), F.lit(blocks)))
    asked = cut(tagged.select("vec_id", "vector", block.alias("block")).groupBy("block").applyInPandas(gather, "block string, _n int, asked binary"))
    # Every block meets every shard of its length: a query set against all rows, in blocks.
    work = asked.join(trees.select("_n", "shard"), "_n").repartition("shard", "block")

    def searching(first_leaf: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {name: batch.column(j)[i].as_py() for j, name in enumerate(batch.schema.names)}
                    tree, (ids, q) = pickle.loads(row["tree"]), pickle.loads(row["asked"])
                    floors = dict(row.get("floors") or [])
                    out: list[list] = [[], [], []]
                    for query_id, query in zip(ids.tolist(), q, strict=True):
                        found, s = tree.search(query, query_id, k, floors.get(query_id), first_leaf)
                        out[0] += [query_id] * len(found)
                        out[1] += found.tolist()
                        out[2] += s.tolist()
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]] * len(out[0]), pa.string()), *(pa.array(x, pa.int64()) for x in out)], ["block", "query_id", "vec_id", "score"])

        return run

    schema = "block string, query_id bigint, vec_id bigint, score bigint"
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    pilot = ranked(work.join(trees.drop("_n"), "shard").select("block", "asked", "tree").mapInArrow(searching(True), schema))
    floors = (
        pilot.where(F.col("rank") == k).groupBy("block")
        .agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("floors"))
    )
    full = work.join(floors, "block", "left").join(trees.drop("_n"), "shard").select("block", "asked", "tree", "floors").mapInArrow(searching(False), schema)
    return ranked(full).select("query_id", "rank", "vec_id", "score")


def integer_vectors(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = 1024) -> DataFrame:
    """vec_id and floor(scale * x) of each component; vectors that are null or hold null, NaN or infinite components are left out."""
    x = F.col(column)
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.where(good).select(F.col(id_column).alias("vec_id"), F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("vector"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all vectors for every vector whose id is divisible by 100."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_inner_product(list_transform(q.e, lambda x: CAST(x AS DOUBLE)), list_transform(c.e, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

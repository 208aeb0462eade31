"""Exact dense and sparse top-k for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Config
from quarry.functions.text import tokens
from quarry.operators.blocks import answered


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def ranked(rows: DataFrame, query: str, score: str, key: str, k: int) -> DataFrame:
    """The k best of each query with their rank; ties go to the smaller key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(column: pa.Array, length: int) -> np.ndarray:
    """Rows of unit length from a list column whose lists have ``length`` entries; 0 for lists of no length or with nulls."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, length)
    size = np.sqrt((flat * flat).sum(axis=1, keepdims=True))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.nan_to_num(flat / size, nan=0.0, posinf=0.0, neginf=0.0)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = DEFAULT.dense_k, config: Config = DEFAULT, decimals: int = 6) -> DataFrame:
    """query_id, chunk_id, score (cosine) and rank; vectors of no length score 0.

    ``vectors`` has chunk_id and embedding, ``queries`` query_id and
    query_embedding; vectors meet the queries of their own length. Each block of
    queries goes to the vectors' tasks, which multiply matrices batch by batch
    and keep k rows of each query before anything is shuffled.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"

    def load(asked: pa.Table) -> dict[int, tuple[pa.Array, np.ndarray]]:
        """Ids and unit vectors of a block's queries, by length."""
        lengths = pc.list_value_length(asked["query_embedding"]).to_numpy() if asked.num_rows else np.zeros(0, int)
        by_length = {}
        for n in np.unique(lengths).tolist():
            part = asked.filter(pa.array(lengths == n))
            by_length[n] = part["query_id"].combine_chunks(), _unit(part["query_embedding"].combine_chunks(), n)
        return by_length

    def best(by_length: dict[int, tuple[pa.Array, np.ndarray]], whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sizes = pc.fill_null(pc.list_value_length(whole.column(1)), -1).to_numpy(zero_copy_only=False)
        for n, (query_ids, matrix) in by_length.items():
            batch = whole.filter(pa.array(sizes == n))
            if not batch.num_rows or not n:
                continue
            unit, place = _unit(batch.column(1), n), np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(batch.num_rows)
            for at in range(0, len(matrix), 256):
                scores = np.round(unit @ matrix[at : at + 256].T, decimals) + 0.0
                floor = np.partition(scores, max(0, len(scores) - k), axis=0)[max(0, len(scores) - k)]
                row, query = np.nonzero(scores >= floor)
                by = np.lexsort((place[row], -scores[row, query], query))
                row, query = row[by], query[by]
                first = np.searchsorted(query, query)
                keep = np.arange(len(query)) - first < k
                row, query = row[keep], query[keep]
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(query + at)), batch.column(0).take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "chunk_id", "score"])

    asked = queries.select("query_id", "query_embedding").where("query_embedding IS NOT NULL")
    rows = answered(vectors.select("chunk_id", "embedding"), asked, asked.count(), config.query_block, load, best, schema)
    return ranked(rows, "query_id", "score", "chunk_id", k)


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): how often each term stands in a text.

    Texts are shuffled by key, being smaller than their terms; counting, and all that counts by key and term after it, stays in the task.
    """
    return rows.select(key, text).repartition(key).select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("weight"))


def term_lists(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(chunk_id, terms): the terms of each text, each as often as it stands there; no shuffle."""
    return rows.select(F.col(key).alias("chunk_id"), tokens(F.col(text)).alias("terms"))


def listed(index: DataFrame) -> DataFrame:
    """(chunk_id, terms, weights) of stored postings (chunk_id, term, weight)."""
    return index.groupBy("chunk_id").agg(F.collect_list("term").alias("terms"), F.collect_list("weight").alias("weights"))


def sparse_top_k(index: DataFrame, queries: DataFrame, k: int = DEFAULT.sparse_k, config: Config = DEFAULT) -> DataFrame:
    """query_id, chunk_id, score and rank by the dot product of term weights; at least one term is shared.

    ``index`` has chunk_id, terms and, if they aren't all 1, weights; ``queries``
    are postings (query_id, term, weight). Each block of queries goes to the
    index's tasks as a matrix by term; they add up the products batch by batch
    and keep k rows of each query before anything is shuffled, so neither common
    terms nor many queries make more rows than that.
    """
    kinds = {f.name: f.dataType.simpleString() for f in [*index.schema, *queries.schema]}
    schema = f"query_id {kinds['query_id']}, chunk_id {kinds['chunk_id']}, score double"
    weighted = "weights" in index.columns

    def load(asked: pa.Table) -> dict:
        """A block's postings by term."""
        ids, terms = (asked[c].combine_chunks().dictionary_encode() if asked.num_rows else pa.array([], asked[c].type).dictionary_encode() for c in ("query_id", "term"))
        query, term = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (ids, terms))
        by = np.argsort(term, kind="stable")
        edges = np.searchsorted(term[by], np.arange(len(terms.dictionary) + 1))
        return {"query": query[by], "amount": asked["weight"].to_numpy()[by], "edges": edges, "ids": ids.dictionary, "terms": terms.dictionary}

    def scores_of(asked: dict, doc: np.ndarray, term: np.ndarray, weight: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of products, and whether a term is shared, by document and query."""
        edges, n_queries = asked["edges"], len(asked["ids"])
        size = edges[term + 1] - edges[term]
        at = np.repeat(edges[term] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))
        cell = np.repeat(doc, size) * n_queries + asked["query"][at]
        total = np.bincount(cell, np.repeat(weight, size) * asked["amount"][at], docs * n_queries).reshape(docs, n_queries)
        shared = np.zeros(docs * n_queries, bool)
        shared[cell] = True
        return total, shared.reshape(docs, n_queries)

    def best(asked: dict, whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_queries = len(asked["ids"])
        rows = max(1, min(1000, 4_000_000 // max(n_queries, 1)))
        for start in range(0, whole.num_rows if n_queries else 0, rows):
            batch = whole.slice(start, rows)
            found = pc.index_in(batch.column(1).flatten(), asked["terms"])
            doc = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            hit = found.is_valid().to_numpy(zero_copy_only=False)
            weight = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(float)[hit] if weighted else np.ones(int(hit.sum()))
            total, shared = scores_of(asked, doc[hit], found.drop_null().to_numpy().astype(np.int64), weight, batch.num_rows)
            place = np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(batch.num_rows)
            total[~shared] = -np.inf
            least = max(0, batch.num_rows - k)
            floor = np.partition(total, least, axis=0)[least]
            row, col = np.nonzero((total >= floor) & shared)
            by = np.lexsort((place[row], -total[row, col], col))
            row, col = row[by], col[by]
            keep = np.arange(len(col)) - np.searchsorted(col, col) < k
            row, col = row[keep], col[keep]
            yield pa.RecordBatch.from_arrays([asked["ids"].take(pa.array(col)), batch.column(0).take(pa.array(row)), pa.array(total[row, col])], ["query_id", "chunk_id", "score"])

    columns = ["chunk_id", "terms", *(["weights"] if weighted else [])]
    asked = queries.select("query_id", "term", F.col("weight").cast("double").alias("weight"))
    names = asked.select("query_id").distinct().count()
    return ranked(answered(index.select(*columns), asked, names, config.query_block, load, best, schema), "query_id", "score", "chunk_id", k)

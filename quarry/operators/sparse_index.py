"""Stored postings in blocks with their largest weight, and exact top-k that skips blocks.

Documents are put in ranges of RANGE by their size, so that a range's documents are
alike in what they can score. A row of the index is one term's postings in one range,
with its largest weight. A search adds up the largest weights of a question's terms by
range, scores the most promising ranges for a first k-th score, and then only those
ranges whose bound reaches it. The corpus isn't tokenized again, and the lists of
skipped ranges are never unpacked.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT
from quarry.operators.vectors import ranked
from quarry.session import cut

#: Documents of a range; a list is no longer than that.
RANGE = 128
#: Terms that are looked up by a filter which reaches the files' statistics; more of them meet the index in a join.
LOOKED_UP = 2_000
#: Sums of products in another order differ by less than this share.
SLACK = 1e-9


def ranges(postings: DataFrame) -> DataFrame:
    """(chunk_id, range): documents in the order of their total weight, RANGE of them to a range."""
    sizes = postings.groupBy("chunk_id").agg(F.sum("weight").alias("_size"))
    sorted_ = sizes.repartitionByRange("_size", "chunk_id").sortWithinPartitions("_size", "chunk_id").withColumn("_id", F.monotonically_increasing_id())
    return cut(sorted_.select("chunk_id", (F.col("_id") - F.col("_id") % RANGE).alias("range")))


def blocks(postings: DataFrame) -> DataFrame:
    """Index rows (term, range, n, top, postings) of postings (chunk_id, term, weight) with a weight above 0.

    ``postings`` is a list of (chunk_id, weight) of RANGE entries at most, so
    a term that all documents have is many rows, dealt out by term and range.
    Repeated postings of a document and term add up.
    """
    once = postings.where("chunk_id IS NOT NULL AND term IS NOT NULL AND weight > 0").groupBy("chunk_id", "term").agg(F.sum("weight").alias("weight"))
    once = cut(once)
    rows = once.join(ranges(once), "chunk_id")
    return rows.groupBy("term", "range").agg(F.count("*").alias("n"), F.max("weight").alias("top"), F.array_sort(F.collect_list(F.struct("chunk_id", "weight"))).alias("postings"))


def write(index: DataFrame, path: str) -> None:
    """The index sorted by term, so that statistics of files and row groups tell where a term can be."""
    index.repartitionByRange("term", "range").sortWithinPartitions("term", "range").write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _asked(index: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries' postings, and the index rows of their terms."""
    queries = cut(queries.where("weight > 0").groupBy("query_id", "term").agg(F.sum("weight").alias("_asked")))
    terms = queries.select("term").distinct()
    few = [r.term for r in terms.limit(LOOKED_UP + 1).collect()]  # bounded by LOOKED_UP
    found = index.where(F.col("term").isin(few)) if len(few) <= LOOKED_UP else index.join(terms, "term", "left_semi")
    return queries, found


def bounds(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, range, bound, n): what a document of the range can score at most, and a number of documents that do score."""
    rows = index.select("term", "range", "n", "top").join(queries, "term")
    return rows.groupBy("query_id", "range").agg(F.sum(F.col("top") * F.col("_asked")).cast("double").alias("bound"), F.max("n").alias("n"))


def scored(index: DataFrame, queries: DataFrame, chosen: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score) of all documents in the chosen (query_id, range) that share a term."""
    wanted = chosen.select("query_id", "range").join(queries, "query_id")
    rows = index.select("term", "range", "postings").join(wanted, ["term", "range"]).select("query_id", "_asked", F.explode("postings").alias("p"))
    out = rows.select("query_id", F.col("p.chunk_id").alias("chunk_id"), (F.col("p.weight") * F.col("_asked")).alias("s"))
    if allowed is not None:
        out = out.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return out.groupBy("query_id", "chunk_id").agg(F.sum("s").cast("double").alias("score"))


def choices(index: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Scores of the first ranges, and of all ranges (query_id, range, n) those read first and those read after them.

    The first ranges of a query are those of the highest bounds that hold k of
    its documents; a range holds one at least, so they are k ranges at most.
    """
    every = cut(bounds(index, queries))
    w = Window.partitionBy("query_id").orderBy(F.desc("bound"), "range")
    best = every.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    before = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = cut(best.withColumn("_before", before).where(F.col("_before") < k).select("query_id", "range", "n"))
    scores = cut(scored(index, queries, first, allowed))
    kth = ranked(scores, "query_id", "score", "chunk_id", k).where(F.col("rank") == k).select("query_id", F.col("score").alias("_kth"))
    open_ = every.join(kth, "query_id", "left").where("_kth IS NULL OR bound * (1 + %r) >= _kth" % SLACK)  # ties go by id, so equal bounds are read
    return scores, first, open_.join(first, ["query_id", "range"], "left_anti").select("query_id", "range", "n")


def top_k(index: DataFrame, queries: DataFrame, k: int = DEFAULT.sparse_k, allowed: DataFrame | None = None) -> DataFrame:
    """query_id, chunk_id, score and rank by the dot product of term weights; the same rows as vectors.sparse_top_k().

    ``queries`` are postings (query_id, term, weight); with ``allowed``
    (chunk_id) only these documents count, and bounds still hold.
    """
    queries, found = _asked(index, queries)
    scores, _, rest = choices(found, queries, k, allowed)
    return ranked(scores.unionByName(scored(found, queries, rest, allowed)), "query_id", "score", "chunk_id", k)


def rows_read(index: DataFrame, queries: DataFrame, k: int = DEFAULT.sparse_k) -> DataFrame:
    """(kind, postings): those in the index (stored), of the queries' terms (of_terms), and those that a search unpacks (read)."""
    queries, found = _asked(index, queries)
    _, first, rest = choices(found, queries, k)
    chosen = first.unionByName(rest).join(queries, "query_id").select("term", "range").distinct()
    kinds = {"stored": index, "of_terms": found, "read": found.join(chosen, ["term", "range"], "left_semi")}
    return reduce(DataFrame.unionByName, (df.agg(F.lit(kind).alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")) for kind, df in kinds.items()))

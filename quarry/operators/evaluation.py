"""Retrieval metrics, judge replies and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10)


def hits_at(cases: DataFrame, retrieved: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Whether an expected document is among the first k retrieved, for each case.

    ``cases`` has case_id and expected_doc_ids, ``retrieved`` case_id, rank and
    doc_id. Cases without expectations or results are misses.
    """
    lists = retrieved.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x.doc_id).alias("_got"))
    rows = cases.join(lists, "case_id", "left")
    return rows.select("case_id", *(F.coalesce(F.arrays_overlap("expected_doc_ids", F.slice("_got", 1, k)), F.lit(False)).alias(f"hit_at_{k}") for k in cuts))


def hits_among(cases: DataFrame, retrieved: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """hits_at() where ``retrieved`` (case_id, rank) already tells which rows are ``expected``; no lists are made."""
    hits = retrieved.groupBy("case_id").agg(*(F.bool_or(F.col("expected") & (F.col("rank") <= k)).alias(f"_{k}") for k in cuts))
    return cases.join(hits, "case_id", "left").select("case_id", *(F.coalesce(f"_{k}", F.lit(False)).alias(f"hit_at_{k}") for k in cuts))


def summary(hits: DataFrame, judged: DataFrame | None = None, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """Mean hits over all cases; mean and number of the judge's scores where there are any."""
    out = hits.agg(F.count("*").alias("n_cases"), *(F.avg(F.col(f"hit_at_{k}").cast("int")).alias(f"hit_at_{k}") for k in cuts))
    if judged is not None:
        out = out.crossJoin(judged.agg(F.avg("score").alias("judge_mean"), F.count("score").alias("judge_n")))  # a row each
    return out


def judge_reply(reply: Column) -> tuple[Column, Column]:
    """Score and rationale from the JSON object in a reply.

    No braces: no score and the reply's beginning; not JSON: neither.
    """
    start, from_end = F.instr(reply, "{"), F.instr(F.reverse(reply), "}")
    found = (start > 0) & (from_end > 0)
    end = F.length(reply) - from_end + 1
    part = F.substring(reply, start, F.greatest(F.lit(0), end - start + 1))
    # Read as text, so that numbers in quotes count.
    parsed = F.from_json(part, "score string, rationale string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    good = found & parsed.isNotNull() & parsed["_bad"].isNull()
    number = F.coalesce(parsed["score"], F.lit("0")).try_cast("double")
    score = F.when(good, number)
    rationale = F.when(~found, F.substring(reply, 1, 240)).when(good & number.isNotNull(), F.substring(F.coalesce(parsed["rationale"], F.lit("")), 1, 500))
    return score, rationale


def rejected(answer: Column) -> Column:
    """Short answers that only say that nothing was found."""
    a = F.lower(answer)
    return (a.startswith("não consta") | a.startswith("nao consta")) & (F.length(answer) <= 300)


def benchmark_summary(results: DataFrame) -> DataFrame:
    """By category, in the order of first appearance (seq): passes, items, mean of the positive times."""
    time = F.when(F.col("elapsed") > 0, F.col("elapsed"))
    out = results.groupBy("category").agg(F.min("seq").alias("first_seq"), F.count_if("passed").alias("n_pass"), F.count("*").alias("n"), F.coalesce(F.avg(time), F.lit(0.0)).alias("avg_elapsed"))
    return out.orderBy("first_seq")

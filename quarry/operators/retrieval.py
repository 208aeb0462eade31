"""Hybrid retrieval: identifiers, reciprocal rank fusion, candidates, re-ranking, citations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Config
from quarry.functions.text import tokens
from quarry.operators.chunks import clean_text

SOURCES = ("dense", "sparse", "identifier")


def identifier_numbers(question: Column) -> tuple[Column, Column]:
    """Numbers of 3 to 5 digits that aren't years, and years from 2010 to 2025."""
    q = F.lower(question)
    # Fixed patterns of numbers and years.
    years = F.regexp_extract_all(q, F.lit(r"\b(201[0-9]|202[0-5])\b"), F.lit(1))
    return F.array_except(F.regexp_extract_all(q, F.lit(r"\b(\d{3,5})\b"), F.lit(1)), years), years


def digit_strings(name: Column) -> Column:
    """All different strings of 3 to 5 digits that stand anywhere in a file name."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d{3,})"), F.lit(1))
    of_size = lambda run, k: F.transform(F.sequence(F.lit(1), F.length(run) - k + 1), lambda i: F.substring(run, i, F.lit(k)))
    parts = lambda run: F.concat(*(F.when(F.length(run) >= k, of_size(run, k)).otherwise(F.array().cast("array<string>")) for k in (3, 4, 5)))
    return F.array_distinct(F.flatten(F.transform(runs, parts)))


def identifier_documents(queries: DataFrame, documents: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, doc_id) of documents whose file name holds a number of the question, and a year if it names any.

    At most ``identifier_docs`` of each query, by id. Numbers of questions meet
    the digit strings of file names in an equi-join; years are a residual
    condition.
    """
    numbers, years = identifier_numbers(F.col("question"))
    asked = queries.select("query_id", years.alias("years"), F.explode(F.array_distinct(numbers)).alias("number"))
    files = documents.select("doc_id", "arquivo").dropDuplicates(["doc_id"]).select("doc_id", "arquivo", F.explode(digit_strings(F.col("arquivo"))).alias("number"))
    dated = (F.size("years") == 0) | F.exists("years", lambda y: F.contains(F.col("arquivo"), y))
    hits = files.join(asked, "number").where(dated).select("query_id", "doc_id").distinct()
    w = Window.partitionBy("query_id").orderBy("doc_id")
    return hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= config.identifier_docs).drop("_n")


def fuse(rankings: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, rrf, first_seen, ident_rank) from (query_id, chunk_id, source, rank).

    Terms are added in the order of the sources, so that near ties come out alike.
    """
    term = lambda i: F.coalesce(F.max(F.when(F.col("source") == SOURCES[i], 1.0 / (F.lit(config.rrf_k) + F.col("rank")).cast("double"))), F.lit(0.0))
    number = F.when(F.col("source") == "dense", 0).when(F.col("source") == "sparse", 1).otherwise(2)
    return rankings.groupBy("query_id", "chunk_id").agg(
        (term(0) + term(1) + term(2)).alias("rrf"), F.min(number * 1_000_000 + F.col("rank")).alias("first_seen"), F.min(F.when(F.col("source") == "identifier", F.col("rank"))).alias("ident_rank")
    )


def candidates(fused: DataFrame, identifier_docs: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(query_id, chunk_id, rrf, position, is_ident): what the re-ranker sees.

    With 1 to 3 identified documents that have hits, their hits alone; else the
    best fused ones and the first identifier hits that aren't among them.
    """
    n = identifier_docs.groupBy("query_id").agg(F.count("*").alias("_docs"))
    q = Window.partitionBy("query_id")
    rows = fused.join(n, "query_id", "left").withColumns({"_fr": F.row_number().over(q.orderBy(F.desc("rrf"), "first_seen")), "_any": F.max(F.col("ident_rank").isNotNull()).over(q)})
    hard = F.coalesce(F.col("_docs").between(1, config.hard_filter_docs), F.lit(False)) & F.col("_any")
    soft = F.when(F.col("_fr") <= config.fused_n, F.col("_fr")).when(F.col("ident_rank") <= config.identifier_extra, 100 + F.col("ident_rank"))
    rows = rows.withColumn("position", F.when(hard, F.col("ident_rank")).otherwise(soft)).where("position IS NOT NULL")
    return rows.select("query_id", "chunk_id", "rrf", "position", F.col("ident_rank").isNotNull().alias("is_ident"))


def overlap_score(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: share of the question's distinct terms that the text holds."""
    q = F.array_distinct(tokens(question))
    return F.coalesce(F.size(F.array_intersect(q, tokens(text))).cast("double") / F.nullif(F.size(q), F.lit(0)), F.lit(0.0))


def reranked(rows: DataFrame, config: Config = DEFAULT, top_k: int | None = None, scorer: Callable[[Column, Column], Column] = overlap_score) -> DataFrame:
    """The ``top_k`` best by the scorer, with first pages lowered and identifier hits raised.

    ``rows`` has question, arquivo, text, page_start, is_ident and position.
    """
    seen = F.concat(F.lit("[arquivo: "), F.coalesce("arquivo", F.lit("")), F.lit("]\n"), F.coalesce("text", F.lit("")))
    factor = F.when(F.coalesce("page_start", F.lit(1)) == 0, config.first_page_factor).otherwise(1.0) * F.when(F.col("is_ident"), config.identifier_factor).otherwise(1.0)
    rows = rows.withColumn("score", F.round(scorer(F.col("question"), seen) * factor, 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "position")
    return rows.withColumn("final_rank", F.row_number().over(w)).where(F.col("final_rank") <= (top_k or config.top_k))


def hybrid(dense: DataFrame, sparse: DataFrame, identified: DataFrame, identifier_docs: DataFrame, payload: DataFrame, questions: DataFrame, config: Config = DEFAULT, top_k: int | None = None) -> DataFrame:
    """Re-ranked hits of all questions from three rankings (query_id, chunk_id, rank)."""
    tag = lambda df, s: df.select("query_id", "chunk_id", F.lit(s).alias("source"), "rank")
    rankings = tag(dense, "dense").unionByName(tag(sparse, "sparse")).unionByName(tag(identified, "identifier"))
    found = candidates(fuse(rankings, config), identifier_docs, config)
    return reranked(found.join(payload, "chunk_id").join(questions, "query_id"), config, top_k)


def context(hits: DataFrame) -> DataFrame:
    """Numbered context of each query, as the answering model reads it; the header's format is fixed."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    flag = F.when(F.col("has_revoked"), "True").when(~F.col("has_revoked"), "False").otherwise("None")
    head = F.concat(
        F.lit("["), F.col("final_rank").cast("string"), F.lit("] doc_id="), show("doc_id"), F.lit(" | titulo="), show("titulo"), F.lit(" | ano="), show("ano"), F.lit(" | autor="), show("autor"),
        F.lit(" | situacao_doc="), show("situacao_doc"), F.lit(" | art="), show("article_ref"), F.lit(" | has_revoked="), flag, F.lit(" | pg "), show("page_start"), F.lit("-"), show("page_end"),
    )
    part = F.struct("final_rank", F.concat(head, F.lit("\n"), clean_text(F.coalesce("text", F.lit("")))).alias("t"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x.t), "\n\n---\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """All retrieved chunks of each query, in their final order."""
    item = F.struct("final_rank", "doc_id", "article_ref", "page_start", "page_end", "situacao_doc", "url", "score")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("citations"))

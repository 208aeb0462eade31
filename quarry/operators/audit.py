"""Audits of documents across the stages' tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def document_audit(catalog: DataFrame, pages: DataFrame, chunks: DataFrame, points: DataFrame) -> DataFrame:
    """A row per document of ``catalog``: page kinds, flags and counts of its pages, chunks and points."""
    p = pages.groupBy("doc_id").agg(
        F.count("*").alias("pages"), *(F.count_if(F.col("classification") == k).alias(f"{k}_pages") for k in ("digital", "scanned", "complex")),
        F.bool_or("has_revoked").alias("any_revoked"), F.sum(F.size("tables_markdown")).alias("tables"), F.sum("char_count").alias("chars"),
    )
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("has_table").alias("table_chunks"), F.count_if("has_revoked").alias("revoked_chunks"), F.min_by("text", "chunk_index").alias("first_text"))
    v = points.groupBy("doc_id").agg(F.count("*").alias("points"))
    return catalog.join(p, "doc_id", "left").join(c, "doc_id", "left").join(v, "doc_id", "left")


def issues(audit: DataFrame) -> DataFrame:
    """(doc_id, issue) for rows of document_audit() that don't fit together or with the stages' statuses."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    is_ok = lambda stage: F.col(f"status_{stage}") == "ok"
    rules = F.array(
        F.when(~is_ok("download"), "not downloaded"),
        F.when(is_ok("parse") & (n("pages") == 0), "parsed without pages"),
        F.when(is_ok("chunk") & (n("chunks") == 0), "chunked without chunks"),
        F.when(n("chunks") != n("points"), "chunks and points differ"),
        F.when(F.coalesce("any_revoked", F.lit(False)) & (n("revoked_chunks") == 0), "struck-out text lost"),
    )
    return audit.select("doc_id", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("issue"))


def mentions(rows: DataFrame, text: str, every: list[str], any_of: list[str], top: int = 3) -> DataFrame:
    """Documents with most texts that hold all of ``every`` and one of ``any_of``."""
    keep = F.lit(True)
    for term in every:
        keep &= F.contains(F.col(text), F.lit(term))
    some = F.lit(not any_of)
    for term in any_of:
        some |= F.contains(F.col(text), F.lit(term))
    return rows.where(keep & some).groupBy("doc_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "doc_id").limit(top)

"""Metadata and binary files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.catalog import flatten_metadata
from quarry.providers import with_retries


def read_metadata(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Catalog records of metadata files, with their place in them; any store that Spark reads serves."""
    raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    return flatten_metadata(raw, ordered=True)


def local_name(doc_id, arquivo):
    """File name that no other document has: the given one without path parts, and the end of the id."""
    safe = F.regexp_replace(F.coalesce(arquivo, F.lit("")), r"[/\\]", "_")
    return F.concat(F.regexp_replace(safe, r"(?i)\.pdf$", ""), F.lit("__"), F.element_at(F.split(doc_id, "__"), -1), F.lit(".pdf"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix, content, is_pdf) of files; the suffix is the end of the document's id, by which files are found too."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    suffix = F.regexp_extract("path", r"__([0-9a-f]{10})\.pdf$", 1)
    return files.select("path", suffix.alias("suffix"), "content", sniffed(F.col("content")).alias("is_pdf"))


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(path, suffix) of document files; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    return files.select("path", F.regexp_extract("path", r"__([0-9a-f]{10})\.pdf$", 1).alias("suffix")).where("suffix <> ''")


def sniffed(content):
    """Do the first bytes say that this is a PDF?"""
    return F.coalesce(F.substring(content, 1, 4) == F.unhex(F.lit("25504446")), F.lit(False))


def parse_status(content):
    """Status of the parse stage before any parsing: other files are skipped for good."""
    return F.when(content.isNull(), "error").when(sniffed(content), "pending").otherwise("skipped")


def fetched(todo: DataFrame, fetch: Callable[[str], bytes], tries: int = 4, batch: int = 16, present: DataFrame | None = None) -> DataFrame:
    """(doc_id, content, status, error) of documents (doc_id, url); ``fetch`` gets https addresses.

    ``batch`` tasks fetch at the same time; each works through its rows, and
    failures are kept as rows with their message. Documents with content in
    ``present`` (doc_id, content) aren't fetched again.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for doc_id, url in zip(part["doc_id"], part["url"], strict=True):
                try:
                    out.append((doc_id, with_retries(lambda u=url: fetch(u), tries), "ok", None))
                except Exception as e:  # a bad address must not end the job
                    out.append((doc_id, None, "error", str(e)[:240]))
            yield pd.DataFrame(out, columns=["doc_id", "content", "status", "error"])

    if present is not None:
        todo = todo.join(present.where(F.length("content") > 0).select("doc_id").distinct(), "doc_id", "left_anti")
    safe = todo.select("doc_id", F.regexp_replace("url", "^http://", "https://").alias("url"))
    return safe.repartition(batch).mapInPandas(run, "doc_id string, content binary, status string, error string")

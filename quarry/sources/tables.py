"""Stored tables: parsed pages, overlays, chunks, points, evaluation cases and reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.functions.ids import point_id
from quarry.operators.catalog import latest
from quarry.session import cut
from quarry.sources import store

CASES = "id string, question string, expected_doc_ids array<string>, gold_answer string, filters map<string,string>"


def load(spark: SparkSession, path: str, schema: StructType | None = None, form: str = "parquet") -> DataFrame | None:
    """A stored table, be it a store of deltas or a plain folder; None if there is none. JSON needs a schema."""
    if store.exists(spark, path):
        return store.read(spark, path, schema, form=form)
    reader = spark.read.format(form)
    try:
        return (reader.schema(schema) if schema else reader).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def replace_documents(rows: DataFrame, path: str, documents: DataFrame | None = None, form: str = "parquet") -> None:
    """All stored rows of the documents in ``rows`` and in ``documents`` make way for the new ones; others stay.

    Writes no more than ``rows`` and these documents' ids.
    """
    store.write(rows, path, documents, form=form)


def write_chunks(chunks: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Chunks as JSON lines; those of documents that aren't among ``chunks`` stay, unless ``documents`` names them as gone."""
    replace_documents(chunks, path, documents, "json")


CHUNKS = "doc_id string, chunk_id string, chunk_index bigint, text string, article_ref string, has_table boolean, has_revoked boolean, page_start int, page_end int"


def read_chunks(spark: SparkSession, path: str, schema: str = CHUNKS, documents: list[str] | None = None) -> DataFrame:
    """Stored chunks, all or those of some documents (a few); none stored: no rows."""
    stored = load(spark, path, StructType.fromDDL(schema), "json")
    rows = spark.createDataFrame([], schema) if stored is None else stored
    return rows.where(F.col("doc_id").isin(documents)) if documents is not None else rows


def points(chunks: DataFrame) -> DataFrame:
    """Chunks with their point ids."""
    return chunks.withColumn("point_id", point_id(F.col("chunk_id")))


def upsert_points(old: DataFrame, new: DataFrame) -> DataFrame:
    """New points instead of old ones of the same id; of repeated new ones the last by chunk_id."""
    new = latest(new, ["point_id"], ["chunk_id"])
    return old.join(new.select("point_id"), "point_id", "left_anti").unionByName(new)


def without_documents(stored: DataFrame, documents: DataFrame) -> DataFrame:
    return stored.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def document_index(stored: DataFrame) -> DataFrame:
    """(doc_id, arquivo), the entry of the smallest point for each document; only these columns are read."""
    return stored.groupBy("doc_id").agg(F.min_by("arquivo", "point_id").alias("arquivo"))


def count_points(stored: DataFrame, doc_id: str) -> int:
    return stored.where(F.col("doc_id") == doc_id).count()


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, line) of a text file or folder of files, numbered from 0 over all splits in the files' order.

    Lines are counted split by split; a line's number is its place in its split
    and the lines of the splits before it, so no task holds more than its split.
    """
    text = spark.read.text(path).select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_id"), F.struct(F.input_file_name().alias("file"), F.input_file_block_start().alias("start")).alias("_split"))
    rows = cut(text)
    counts = rows.groupBy("_split").agg(F.count("*").alias("_lines"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_lines").over(Window.orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    shift = counts.select("_split", (before - F.col("_first")).alias("_shift"))
    return rows.join(shift, "_split").select((F.col("_id") + F.col("_shift")).cast("int").alias("n"), "line")


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON lines; blank lines are skipped, and a case without an id is named by its line."""
    return parsed_cases(numbered_lines(spark, path))


def parsed_cases(lines: DataFrame) -> DataFrame:
    """Cases of numbered lines (n, line)."""
    c = lines.where(F.trim("line") != "").select("n", F.from_json("line", CASES).alias("c"))
    return c.select(F.coalesce("c.id", F.format_string("case_%04d", "n")).alias("case_id"), "c.question", F.coalesce("c.expected_doc_ids", F.array().cast("array<string>")).alias("expected_doc_ids"), "c.gold_answer", "c.filters")


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

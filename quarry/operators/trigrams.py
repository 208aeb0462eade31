"""Substring search over texts by lists of three-letter strings.

A row of the index is one string of three letters in one range of RANGE
documents, with those documents. A term's strings are looked up, their lists
intersected range by range, and what is left is verified. Documents without
one of the strings aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import cut

#: Documents of a range, and bytes of their texts, at most (unless one alone has more).
RANGE, BYTES = 1024, 1 << 22
COLUMNS = ("titulo", "autor", "ementa", "assunto")


def grams(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Strings of three letters of texts in lower case, as code points of 21 bits each, and the row of each; nulls have none."""
    text = pc.fill_null(text.cast(pa.large_string()), "")
    points = np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(size)), size)
    if len(points) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, own = points[:-2] << 42 | points[1:-1] << 21 | points[2:], row[:-2] == row[2:]
    return code[own], row[:-2][own]


def _letters(codes: np.ndarray) -> pa.Array:
    """The strings that codes stand for."""
    text = np.stack([codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of RANGE rows at most, and of BYTES unless a row alone has more."""
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns[2:]:
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        upto, at = np.concatenate(([0], np.cumsum(size))), 0
        while at < batch.num_rows:
            end = min(at + RANGE, max(at + 1, int(np.searchsorted(upto, upto[at] + BYTES, side="right")) - 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def lists(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id") -> DataFrame:
    """Index rows (gram, range, n, docs) of the columns' strings; ``docs`` has RANGE entries at most.

    A range's documents stand together in a task, which sorts their strings; each
    text is passed over once, and no string is shuffled for itself.
    """
    rows = documents.select(F.monotonically_increasing_id().alias("_id"), F.col(key).alias("doc"), *(F.lower(F.col(c).cast("string")).alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [grams(c) for c in batch.columns[2:]]
            code, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            docs = batch.column(1)
            place = np.empty(batch.num_rows, np.int64)
            place[pc.sort_indices(docs).to_numpy()] = np.arange(batch.num_rows)
            by = np.lexsort((place[row], code))
            code, row = code[by], row[by]
            new = np.ones(len(code), bool)
            new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            code, row = code[new], row[new]
            first = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.zeros(0, np.int64)
            edges = np.append(first, len(code))
            names = pa.array(np.full(len(first), batch.column(0)[0].as_py()))
            yield pa.RecordBatch.from_arrays([_letters(code[first]), names, pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), docs.take(pa.array(row)))], ["gram", "range", "n", "docs"])

    kind = dict(rows.dtypes)["doc"]
    return cut(rows.where("doc IS NOT NULL").mapInArrow(run, f"gram string, range bigint, n bigint, docs array<{kind}>"))


def write(index: DataFrame, path: str) -> None:
    """The index sorted by string, so that statistics tell where one can be."""
    index.repartitionByRange("gram", "range").sortWithinPartitions("gram", "range").write.option("parquet.block.size", 8 << 20).mode("overwrite").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def needed(term: str) -> list[str]:
    """Strings that every text with ``term`` has; wildcards of LIKE (``%``, ``_``) and what they escape have none."""
    parts = re.split(r"\\.|[%_]", term.strip().lower())
    return sorted({p[i : i + 3] for p in parts for i in range(len(p) - 2)})


def candidates(index: DataFrame, term: str) -> DataFrame | None:
    """(doc) of documents that have all of the term's strings; None if it has none, so that all must be read."""
    wanted = needed(term)
    if not wanted:
        return None
    hits = index.where(F.col("gram").isin(wanted)).groupBy("range").agg(F.collect_list("docs").alias("lists")).where(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.element_at("lists", 1), lambda a, b: F.array_intersect(a, b))
    return hits.select(F.explode(both).alias("doc"))


def held(term: str, columns: tuple[str, ...] = COLUMNS) -> Column:
    """Is the term in one of the columns, in any case?"""
    like, out = F.lit(f"%{term.strip()}%"), F.lit(False)
    for c in columns:
        out |= F.coalesce(F.ilike(c, like), F.lit(False))
    return out


def holding(documents: DataFrame, index: DataFrame, term: str, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id") -> DataFrame:
    """Documents with ``term`` in one of the columns; the same rows as a scan gives."""
    found = candidates(index, term)
    rows = documents if found is None else documents.join(found.withColumnRenamed("doc", key).distinct(), key, "left_semi")
    return rows.where(held(term, columns))

"""Tables by document that grow by deltas: an upsert writes what it changes and nothing else.

A store is a folder with

* ``rows/seq=N``: rows written by batch N;
* ``marks/seq=N``: the documents that batch N replaces, with or without rows of
  their own (a document without rows is gone). It is written last, so batch N
  counts once this folder is complete;
* ``base/seq=N``: the state after batch N, as the compaction job wrote it.

Reading resolves them: of each document the rows of its last batch count. Marks
behind the base are few, and meet the base's rows in an anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _sequences(spark: SparkSession, path: str, complete: bool = True) -> list[int]:
    """Numbers of the batches in a folder; only those whose job has ended, unless told otherwise."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at)]
    ended = [p for p in names if p.getName().startswith("seq=") and (not complete or fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))]
    return sorted(int(p.getName()[4:]) for p in ended)


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_sequences(spark, f"{path}/marks") or _sequences(spark, f"{path}/base"))


def _load(spark: SparkSession, path: str, numbers: list[int], schema: StructType | None, form: str) -> DataFrame:
    reader = spark.read.format(form).option("basePath", path)
    if schema is not None:
        reader = reader.schema(StructType([*(f for f in schema if f.name != "seq"), StructField("seq", IntegerType())]))
    else:
        reader = reader.option("mergeSchema", "true")
    return reader.load([f"{path}/seq={n}" for n in numbers])


def write(rows: DataFrame, path: str, documents: DataFrame | None = None, key: str = "doc_id", form: str = "parquet") -> int:
    """Batch of ``rows``: they replace all rows of their documents, and ``documents`` without rows are gone.

    Returns the batch's number. Two writers that take the same number don't both
    succeed. A failed batch leaves files that don't count; its number isn't used again.
    ``rows`` must not have a column ``seq``, and no null keys.
    """
    spark = rows.sparkSession
    number = 1 + max([0, *(n for part in ("rows", "marks", "base") for n in _sequences(spark, f"{path}/{part}", complete=False))])
    at = f"{path}/rows/seq={number}"
    rows.write.mode("errorifexists").format(form).save(at)
    touched = _load(spark, f"{path}/rows", [number], rows.schema, form).select(key)
    if documents is not None:
        touched = touched.unionByName(documents.select(key))
    touched.distinct().write.mode("errorifexists").parquet(f"{path}/marks/seq={number}")
    return number


def delete(documents: DataFrame, path: str, key: str = "doc_id") -> int:
    """Batch that takes all rows of ``documents`` away."""
    spark = documents.sparkSession
    number = 1 + max([0, *(n for part in ("rows", "marks", "base") for n in _sequences(spark, f"{path}/{part}", complete=False))])
    documents.select(key).distinct().write.mode("errorifexists").parquet(f"{path}/marks/seq={number}")
    return number


def _parts(spark: SparkSession, path: str) -> tuple[int, list[int], list[int]]:
    """The newest base (0: none), the batches behind it, and those of them with rows."""
    base = max(_sequences(spark, f"{path}/base"), default=0)
    marks = [n for n in _sequences(spark, f"{path}/marks") if n > base]
    return base, marks, [n for n in _sequences(spark, f"{path}/rows") if n in set(marks)]


def read(spark: SparkSession, path: str, schema: StructType | None = None, key: str = "doc_id", form: str = "parquet") -> DataFrame | None:
    """The store's present state, None if there is none; JSON needs a schema."""
    base, marks, batches = _parts(spark, path)
    if not base and not marks:
        return None
    out = _load(spark, f"{path}/base", [base], schema, form).drop("seq") if base else None
    if marks:
        newest = _load(spark, f"{path}/marks", marks, None, "parquet").groupBy(key).agg(F.max("seq").alias("_newest"))
        if out is not None:
            out = out.join(newest.select(key), key, "left_anti")
        if batches:
            rows = _load(spark, f"{path}/rows", batches, schema, form).join(newest, key).where("seq = _newest").drop("seq", "_newest")
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def compact(spark: SparkSession, path: str, schema: StructType | None = None, key: str = "doc_id", form: str = "parquet", sort: tuple[str, ...] = (), bloom: tuple[str, ...] = ()) -> int:
    """Writes the present state as a new base and returns its number; readers see the old one until it is complete.

    Rows are sorted by ``sort`` and the key within files, so that filters on these columns skip
    row groups; ``bloom`` names columns whose Parquet files get Bloom filters.
    """
    base, marks, _ = _parts(spark, path)
    number = max([base, *marks])
    rows = read(spark, path, schema, key, form)
    if rows is None or number == base:
        return number
    by = [*sort, key]
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").format(form)
    for c in bloom:
        out = out.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.expected.ndv#{c}", "100000")
    out.save(f"{path}/base/seq={number}")
    return number


def tidied(spark: SparkSession, path: str, batches: int = 16, **given) -> None:
    """Compacts once there are many batches behind the base."""
    if len(_parts(spark, path)[1]) >= batches:
        compact(spark, path, **given)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes batches and bases that the newest base has taken up; readers of an older state must have ended."""
    base, _, _ = _parts(spark, path)
    for part in ("rows", "marks", "base"):
        fs, _ = _files(spark, path)
        for n in _sequences(spark, f"{path}/{part}", complete=False):
            if n < base or (n == base and part != "base"):
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{part}/seq={n}"), True)

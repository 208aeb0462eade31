"""Command line: python -m quarry COMMAND ..., for spark-submit too.

Stages that need a model use the stand-ins of quarry.providers; a deployment
calls the same operators with its own.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import providers
from quarry.operators import answers, catalog, chunks, clusters, pages, retrieval, ruling, sparse_index, vectors
from quarry.session import cut
from quarry.sources import files, filesink, store, tables

#: Arguments of each command.
COMMANDS = {
    "init": ("metadata", "catalog"), "status": ("catalog",), "pending": ("catalog", "stage"), "download": ("catalog", "mirror", "files"), "vision": ("catalog", "pages"),
    "parse": ("catalog", "spans", "strokes", "pages"), "chunk": ("catalog", "pages", "chunks"), "index": ("points", "index"), "compact": ("points",), "embed": ("catalog", "chunks", "points"), "search": ("points", "questions"), "qa": ("points", "questions"), "evaluate": ("points", "cases", "report"),
    "all": ("catalog", "pages", "chunks", "points"),
}


def stored(spark: SparkSession, path: str) -> DataFrame:
    rows = tables.load(spark, path)
    if rows is None:
        raise SystemExit(f"nothing is stored in {path}")
    return rows


def save(spark: SparkSession, rows: DataFrame, path: str, changed: DataFrame | None = None) -> None:
    """A new state of a catalog; where only the documents in ``changed`` differ, only these are written."""
    if changed is not None and store.exists(spark, path):
        rows = rows.join(changed.select("doc_id"), "doc_id", "left_semi")
    store.write(rows, path)
    store.tidied(spark, path)


def init(spark: SparkSession, given) -> None:
    """Metadata files into the catalog; stages of known documents keep their statuses."""
    old = tables.load(spark, given.catalog)
    records = files.read_metadata(spark, given.metadata)
    new = catalog.loaded(catalog.empty_snapshot(spark) if old is None else old, records)
    save(spark, new, given.catalog, records)


def marked(spark: SparkSession, path: str, results: DataFrame, stage: str, counted: dict[str, str] | None = None) -> None:
    """Writes a stage's statuses to the catalog and shows its statistics, which the writing job counts."""
    seen, statistics = catalog.observed(results, counted)
    changed = cut(seen)
    names = [c for c in ("error",) if c in changed.columns]
    new = catalog.mark_status(stored(spark, path), changed, stage, tuple(c for c in names if c in stored(spark, path).columns))
    save(spark, new, path, changed)
    print(stage, json.dumps(statistics.get))


def download(spark: SparkSession, given) -> None:
    """Pending documents' files from a folder that mirrors their addresses by document id; failures are marked."""
    todo = catalog.pending(stored(spark, given.catalog), "download", given.limit).select("doc_id")
    # Paths are joined first; only the files of these documents are read, once.
    found = files.listed(spark, given.mirror).withColumnRenamed("path", "_path")
    rows = cut(todo.withColumn("suffix", F.element_at(F.split("doc_id", "__"), -1)).join(found, "suffix", "left").groupBy("doc_id").agg(F.min("_path").alias("path")))
    filesink.write_files(rows.where("path IS NOT NULL").select(F.concat("doc_id", F.lit(".pdf")).alias("name"), F.col("path").alias("source")), given.files)
    marked(spark, given.catalog, rows.select("doc_id", F.when(F.col("path").isNull(), "error").otherwise("ok").alias("status")), "download")


def parse(spark: SparkSession, given) -> None:
    """Pages of pending documents from their spans, strokes and (if given) tables; what comes with them, no PDF library.

    A document without spans is an error. Struck-out text is marked, tables are those
    given, or ruled, or aligned, and pages are classified by their text and tables.
    """
    todo = cut(catalog.pending(stored(spark, given.catalog), "parse", given.limit).select("doc_id"))
    own = lambda path: stored(spark, path).join(todo, "doc_id", "left_semi")
    spans, drawings = own(given.spans), own(given.strokes)
    marks = pages.stroke_lines(drawings.where("kind <> 'annotation'")).unionByName(drawings.where("kind = 'annotation'").select("doc_id", "page_index", "kind", "x0", "y0", "x1", "y1"))
    struck = cut(pages.struck(spans, marks))
    found = cut(ruling.extracted(struck, drawings.where("kind <> 'annotation'"), own(given.tables) if given.tables else None))
    made = cut(pages.assembled(struck, found))
    seen = cut(made.select("doc_id").distinct())
    tables.replace_documents(made, given.pages, seen)
    counts = made.groupBy("doc_id").agg(F.count("*").alias("n"))
    results = todo.join(counts, "doc_id", "left").select("doc_id", F.when(F.col("n").isNull(), "error").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    marked(spark, given.catalog, results, "parse", {"pages": "n"})


def chunk(spark: SparkSession, given) -> None:
    """Pages of pending documents into chunks; a document without pages is an error.

    A document whose pages hold no text any more loses its chunks.
    """
    todo = catalog.pending(stored(spark, given.catalog), "chunk", given.limit).select("doc_id")
    rows = stored(spark, given.pages).join(todo, "doc_id", "left_semi")
    made = cut(chunks.merged(chunks.pieces(chunks.structural_blocks(chunks.page_lines(rows)))))
    seen = cut(rows.select("doc_id").distinct())
    tables.replace_documents(made, given.chunks, seen)
    counts = made.groupBy("doc_id").agg(F.count("*").alias("n"))
    results = todo.join(seen.withColumn("status", F.lit("ok")), "doc_id", "left").join(counts, "doc_id", "left").select("doc_id", F.coalesce("status", F.lit("error")).alias("status"), F.coalesce("n", F.lit(0)).alias("n"))
    marked(spark, given.catalog, results, "chunk", {"chunks": "n"})


def embed(spark: SparkSession, given, make=providers.HashedWords) -> None:
    """Chunks of pending documents into points; documents without chunks lose their points and are done at once.

    A document with a chunk that can't be encoded keeps its old points and is an error.
    """
    todo, none = catalog.embed_work(stored(spark, given.catalog), stored(spark, given.chunks))
    meta = stored(spark, given.catalog).select("doc_id", *catalog.META_COLUMNS)
    rows = chunks.with_metadata(todo, meta, list(catalog.META_COLUMNS))
    made = cut(providers.embedded(tables.points(rows), "text", make, error="error"))
    per = made.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("error").alias("error"))
    done = cut(per.select("doc_id", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", F.when(F.col("error").isNull(), F.col("n")).otherwise(0).alias("n")))
    results = done.unionByName(none.select("doc_id", "status", F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("n")))
    ok = results.where("status = 'ok'").select("doc_id")
    tables.replace_documents(made.join(ok, "doc_id", "left_semi").drop("error"), given.points, ok)
    marked(spark, given.catalog, results, "embed", {"points": "n"})


def index(spark: SparkSession, given) -> None:
    """Stored postings and a layout by clusters of all points, for searches with --index."""
    points = stored(spark, given.points)
    sparse_index.write(sparse_index.blocks(vectors.postings(points, "chunk_id", "text")), f"{given.index}/postings")
    clusters.laid_out(points.select("chunk_id", "embedding"), f"{given.index}/vectors")


def compact(spark: SparkSession, given) -> None:
    """One sorted state of the points instead of their batches, with Bloom filters for lookups; old files go."""
    store.compact(spark, given.points, sort=("ano", "situacao_doc"), bloom=("doc_id", "autor"))
    store.vacuum(spark, given.points)


def hits(spark: SparkSession, points: str, questions: DataFrame, filters: dict | None, top_k: int | None, index: str | None = None) -> DataFrame:
    """Hybrid search of questions (query_id, question) over the points that the filters keep.

    With ``index`` no text is tokenized but the questions' and the best candidates'; its
    vectors are of use only without filters.
    """
    stored = tables.load(spark, points).where(catalog.payload_filter(filters))
    asked = providers.embedded(questions, "question", column="query_embedding").select("query_id", "query_embedding")
    terms = vectors.postings(questions, "query_id", "question")
    if index:
        sparse = sparse_index.top_k(sparse_index.read(spark, f"{index}/postings"), terms, allowed=stored.select("chunk_id") if filters else None)
    else:
        sparse = vectors.sparse_top_k(vectors.term_lists(stored, "chunk_id", "text"), terms)
    if index and not filters:
        dense = clusters.top_k(clusters.read(spark, f"{index}/vectors"), asked)
    else:
        dense = vectors.dense_top_k(stored.select("chunk_id", "embedding"), asked)
    dense, sparse = cut(dense), cut(sparse)
    named = retrieval.identifier_documents(questions, stored)
    own = stored.join(named, "doc_id").join(asked, "query_id")
    score = F.round(vectors.dot(F.col("embedding"), F.col("query_embedding")) / (vectors.norm(F.col("embedding")) * vectors.norm(F.col("query_embedding"))), 6)
    identified = vectors.ranked(own.select("query_id", "chunk_id", score.alias("score")), "query_id", "score", "chunk_id", 40)
    return cut(retrieval.hybrid(dense, sparse, identified, named, stored.drop("embedding"), questions, top_k=top_k))  # read more than once


def asked(spark: SparkSession, path: str, top_k: int | None) -> DataFrame:
    """Questions of a text file, a line each."""
    rows = tables.numbered_lines(spark, path).select(F.col("n").alias("query_id"), F.col("line").alias("question")).where(F.trim("question") != "")
    return answers.checked(rows, top_k)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="quarry")
    sub = top.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        p = sub.add_parser(name)
        for a in args:
            p.add_argument(a)
        p.add_argument("--limit", type=int)
        p.add_argument("--top-k", type=int)
        p.add_argument("--tables", help="tables that documents already have, for parse")
        if "index" not in args:
            p.add_argument("--index", help="folder that the command index has written")
        p.add_argument("--filters", type=json.loads, help='as JSON: {"ano": [2021, 2022], "situacao_doc": "VIGENTE"}')
    given = top.parse_args(argv)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    run = {"init": init, "download": download, "parse": parse, "chunk": chunk, "embed": embed, "index": index, "compact": compact}
    if given.command in run:
        run[given.command](spark, given)
    elif given.command == "status":
        catalog.stage_progress(stored(spark, given.catalog)).show()
    elif given.command == "pending":
        catalog.pending(stored(spark, given.catalog), given.stage, given.limit).select("doc_id").show(100, truncate=False)
    elif given.command == "vision":
        catalog.vision_candidates(stored(spark, given.catalog), stored(spark, given.pages), given.limit).select("doc_id").show(100, truncate=False)
    elif given.command == "search":
        found = hits(spark, given.points, asked(spark, given.questions, given.top_k), given.filters, given.top_k, given.index)
        found.select("query_id", "final_rank", "doc_id", "article_ref", "score").orderBy("query_id", "final_rank").show(100, truncate=60)
    elif given.command == "qa":
        questions = asked(spark, given.questions, given.top_k)
        answers.answer(hits(spark, given.points, questions, given.filters, given.top_k, given.index), questions).select("question", "answer", F.size("citations").alias("citations")).show(100, truncate=100)
    elif given.command == "evaluate":
        cases = cut(tables.read_cases(spark, given.cases))
        found = hits(spark, given.points, cases.select(F.col("case_id").alias("query_id"), "question"), given.filters, given.top_k, given.index)
        rows, summary = answers.evaluate(cases, found)
        tables.write_report(rows, given.report)
        summary.show()
    else:
        chunk(spark, given)
        embed(spark, given)


if __name__ == "__main__":
    main()

"""Stale rows, failing documents, the file sink and stored indexes at the command line."""

import argparse
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry import __main__ as cli
from quarry import providers
from quarry.operators import catalog
from quarry.sources import filesink, tables
from quarry.streaming import stages


def folder(name="t"):
    return os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), name)


def given(**values):
    return argparse.Namespace(**{"limit": None} | values)


def catalog_of(spark, **stages_of):
    fields = [(d, *(s for s in states)) for d, states in stages_of.items()]
    rows = spark.createDataFrame(fields, "doc_id string, " + ", ".join(f"status_{s} string" for s in catalog.STAGES))
    path = folder("catalog")
    empty = catalog.empty_snapshot(spark)
    cli.save(spark, empty.unionByName(rows, allowMissingColumns=True), path)
    return path


def states(spark, path, stage):
    return {r.doc_id: r[f"status_{stage}"] for r in tables.load(spark, path).collect()}


CHUNK = "doc_id string, chunk_id string, chunk_index bigint, text string"


def test_points_of_a_document_without_chunks_go(spark):
    cat = catalog_of(spark, a=("ok", "ok", "ok", "pending"), b=("ok", "ok", "ok", "ok"))
    chunks, points = folder("chunks"), folder("points")
    spark.createDataFrame([("b", "b0", 0, "text of b")], CHUNK).write.parquet(chunks)
    old = [("a", "a0", 0, "old text"), ("a", "a1", 1, "old text"), ("b", "b0", 0, "text of b")]
    tables.replace_documents(spark.createDataFrame(old, CHUNK), points)
    cli.embed(spark, given(catalog=cat, chunks=chunks, points=points))
    assert [r.doc_id for r in tables.load(spark, points).collect()] == ["b"]
    assert states(spark, cat, "embed") == {"a": "ok", "b": "ok"}


def test_chunks_of_a_document_that_became_blank_go(spark):
    cat = catalog_of(spark, a=("ok", "ok", "pending", "pending"), b=("ok", "ok", "pending", "pending"), c=("ok", "ok", "pending", "pending"))
    pages, chunks = folder("pages"), folder("chunks")
    page = "doc_id string, page_index int, page_text string"
    spark.createDataFrame([("a", 0, "  \n "), ("b", 0, "Art. 1 new text")], page).write.parquet(pages)
    tables.replace_documents(spark.createDataFrame([("a", "a0", 0, "old"), ("b", "b0", 0, "old"), ("c", "c0", 0, "old")], CHUNK), chunks)
    cli.chunk(spark, given(catalog=cat, pages=pages, chunks=chunks))
    assert sorted((r.doc_id, r.text) for r in tables.load(spark, chunks).select("doc_id", "text").collect()) == [("b", "Art. 1 new text"), ("c", "old")]
    assert states(spark, cat, "chunk") == {"a": "ok", "b": "ok", "c": "error"}


def test_a_failing_document_is_marked_and_the_others_go_on(spark, capsys):
    class Picky(providers.HashedWords):
        def encode(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("can't encode " + "x" * 500)
            return super().encode(texts)

    cat = catalog_of(spark, **{d: ("ok", "ok", "ok", "pending") for d in "abc"})
    chunks, points = folder("chunks"), folder("points")
    spark.createDataFrame([("a", "a0", 0, "fine"), ("b", "b0", 0, "fine"), ("b", "b1", 1, "bad"), ("c", "c0", 0, "fine too")], CHUNK).coalesce(1).write.parquet(chunks)
    tables.replace_documents(spark.createDataFrame([("b", "b9", 0, "old")], CHUNK), points)
    cli.embed(spark, given(catalog=cat, chunks=chunks, points=points), Picky)
    assert states(spark, cat, "embed") == {"a": "ok", "b": "error", "c": "ok"}
    assert sorted(r.chunk_id for r in tables.load(spark, points).collect()) == ["a0", "b9", "c0"]
    shown = json.loads(capsys.readouterr().out.strip().splitlines()[-1].split(" ", 1)[1])
    assert shown == {"pending": 3, "ok": 2, "errors": 1, "points": 2}


def test_the_catalog_writes_what_changed(spark):
    cat = catalog_of(spark, **{f"d{k}": ("ok", "ok", "ok", "pending") for k in range(50)})
    cli.marked(spark, cat, spark.createDataFrame([("d7", "ok")], "doc_id string, status string"), "embed")
    assert states(spark, cat, "embed") == {f"d{k}": "ok" if k == 7 else "pending" for k in range(50)}
    assert spark.read.parquet(f"{cat}/rows/seq=2").count() == 1
    for k in range(20):
        cli.marked(spark, cat, spark.createDataFrame([(f"d{k}", "error")], "doc_id string, status string"), "embed")
    assert os.path.isdir(f"{cat}/base") and states(spark, cat, "embed")["d19"] == "error"


def test_a_second_version_replaces_the_first(spark):
    source, target, check = folder("s"), folder("t"), folder("c")

    def work(df):
        return df.select("doc_id", "v", F.when(F.col("v") < 0, "negative").alias("error"))

    def run(rows=()):
        if rows:
            spark.createDataFrame(rows, "doc_id string, v int").coalesce(1).write.mode("append").parquet(source)
        stages.run_stage(spark, source, "doc_id string, v int", work, target, check, version="v").awaitTermination(120)
        return sorted((r.doc_id, r.v) for r in tables.load(spark, target).collect())

    assert run([("a", 1), ("b", 1), ("b", 1), ("c", -1)]) == [("a", 1), ("b", 1)]
    assert run([("a", 2), ("d", 1), ("d", 3)]) == [("a", 2), ("b", 1), ("d", 3)]
    assert run() == [("a", 2), ("b", 1), ("d", 3)]
    assert [r.doc_id for r in tables.load(spark, f"{target}-failed").collect()] == ["c"]
    assert run([("c", 5)]) == [("a", 2), ("b", 1), ("c", 5), ("d", 3)]
    assert tables.load(spark, f"{target}-failed").count() == 0


def test_failed_documents_are_tried_again(spark):
    source, target, check, switch = folder("s"), folder("t"), folder("c"), folder("on")
    spark.createDataFrame([("a", 1), ("b", 2)], "doc_id string, v int").write.parquet(source)

    def work(df):
        broken = not os.path.exists(switch)
        return df.withColumn("error", F.when((F.col("doc_id") == "b") & F.lit(broken), "out of order"))

    for want in ([("a", 1)], [("a", 1), ("b", 2)]):
        stages.run_stage(spark, source, "doc_id string, v int", work, target, check).awaitTermination(120)
        assert sorted((r.doc_id, r.v) for r in tables.load(spark, target).collect()) == want
        open(switch, "w").close()


def test_files_are_whole_or_not_there(spark):
    path = folder("files")
    os.makedirs(path)
    with open(f"{path}/kept.pdf", "w") as f:
        f.write("old")
    rows = spark.range(40).select(F.format_string("f%02d.pdf", "id").alias("name"), F.encode(F.repeat(F.col("id").cast("string"), 1000), "UTF-8").alias("content")).repartition(4)
    filesink.write_files(rows, path)
    filesink.write_files(rows, path)  # again: the same files
    files = sorted(f for f in os.listdir(path) if not f.startswith("_"))
    assert files == [f"f{k:02d}.pdf" for k in range(40)] + ["kept.pdf"] and os.path.getsize(f"{path}/f11.pdf") == 2000
    bad = rows.withColumn("name", F.when(F.col("name") == "f39.pdf", "a/b").otherwise(F.concat(F.lit("x"), "name")))
    with pytest.raises(Exception, match="no name of a file"):
        filesink.write_files(bad, path)
    after = [f for d, _, fs in os.walk(path) for f in fs]
    assert all(f.endswith(".pdf") for f in after)  # no parts are left
    assert all(os.path.getsize(f"{path}/{f}") >= 1000 for f in after if f.startswith("x"))
    copies = folder("copies")
    os.makedirs(copies)
    filesink.write_files(spark.createDataFrame([("c.pdf", f"file:{path}/f05.pdf")], "name string, source string"), copies)
    assert os.path.getsize(f"{copies}/c.pdf") == 1000


def test_search_with_a_stored_index(spark, capsys):
    cat = catalog_of(spark, **{f"d{k}": ("ok", "ok", "ok", "pending") for k in range(30)})
    chunks, points, index, questions = folder("chunks"), folder("points"), folder("index"), folder("q.txt")
    rows = [(f"d{k}", f"d{k}:{n}", n, f"texto {k} energia " + f"palavra{k % 7} " * n) for k in range(30) for n in range(3)]
    spark.createDataFrame(rows, CHUNK).withColumns({"article_ref": F.lit("Art. 1"), "has_table": F.lit(False), "has_revoked": F.lit(False), "page_start": F.lit(0), "page_end": F.lit(1)}).write.parquet(chunks)
    cli.main(["embed", cat, chunks, points])
    cli.main(["compact", points])
    cli.main(["index", points, index])
    with open(questions, "w") as f:
        f.write("energia palavra3\ntexto 12\n")
    shown = []
    for extra in ([], ["--index", index], ["--filters", '{"page_start": 0}'], ["--index", index, "--filters", '{"page_start": 0}']):
        capsys.readouterr()
        cli.main(["search", points, questions, *extra])
        shown.append(capsys.readouterr().out)
    assert len(set(shown)) == 1 and "palavra" not in shown[0] and "d12" in shown[0]


def test_parse_spans_and_strokes(spark):
    cat = catalog_of(spark, a=("ok", "pending", "pending", "pending"), b=("ok", "pending", "pending", "pending"), c=("ok", "ok", "pending", "pending"))
    spans, strokes, given_tables, pages, chunks = folder("spans"), folder("strokes"), folder("tables"), folder("pages"), folder("chunks")
    text = "Art. 1 " + "palavra " * 12
    rows = [("a", 0, 0, 0, text, 0.0, 0.0, 400.0, 10.0), ("a", 0, 1, 0, "gone away", 0.0, 20.0, 60.0, 30.0), ("a", 0, 2, 0, "x", 15.0, 105.0, 25.0, 115.0), ("a", 0, 2, 1, "y", 65.0, 105.0, 75.0, 115.0), ("a", 1, 0, 0, "short", 0.0, 0.0, 30.0, 10.0), ("c", 0, 0, 0, "not pending", 0.0, 0.0, 9.0, 9.0)]
    spark.createDataFrame(rows, "doc_id string, page_index int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double").write.parquet(spans)
    lines = [("a", 0, "line", 0.0, 25.0, 60.0, 25.0), *(("a", 0, "line", 0.0, y, 100.0, y) for y in (100.0, 120.0)), *(("a", 0, "line", x, 100.0, x, 120.0) for x in (0.0, 50.0, 100.0))]
    spark.createDataFrame(lines, "doc_id string, page_index int, kind string, x0 double, y0 double, x1 double, y1 double").write.parquet(strokes)
    spark.createDataFrame([("z", 0, 0, "primary", [["other"]])], "doc_id string, page_index int, table_no int, source string, rows array<array<string>>").write.parquet(given_tables)
    cli.main(["parse", cat, spans, strokes, pages, "--tables", given_tables])
    got = {(r.doc_id, r.page_index): r for r in tables.load(spark, pages).collect()}
    assert set(got) == {("a", 0), ("a", 1)} and states(spark, cat, "parse") == {"a": "ok", "b": "error", "c": "ok"}
    first = got["a", 0]
    assert first.text_markdown.split("\n")[1] == "~~gone away~~" and first.has_revoked and first.classification == "complex" and not first.needs_vision
    assert first.tables_markdown == ["| x | y |\n| --- | --- |"] and first.page_text.endswith(first.tables_markdown[0])
    assert got["a", 1].classification == "scanned" and not got["a", 1].has_revoked
    cli.main(["chunk", cat, pages, chunks])
    assert "~~gone away~~" in tables.load(spark, chunks).first().text

"""Tables from lines, substring search by lists, and work in child processes."""

import os
import random
import tempfile
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quarry import quarantine
from quarry.operators import catalog, ruling, trigrams

SPANS = "doc_id string, page_index int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double"
STROKES = "doc_id string, page_index int, x0 double, y0 double, x1 double, y1 double"


def grid(doc, xs, ys, page=0, jitter=0.0):
    """Strokes of a grid, each drawn in two overlapping pieces."""
    rng, out = random.Random(doc), []
    j = lambda: rng.uniform(-jitter, jitter)
    for y in ys:
        mid = (xs[0] + xs[-1]) / 2
        out += [(doc, page, xs[0] + j(), y + j(), mid + 3, y + j()), (doc, page, mid - 3, y + j(), xs[-1] + j(), y + j())]
    for x in xs:
        out.append((doc, page, x + j(), ys[0] + j(), x + j(), ys[-1] + j()))
    return out


def words(doc, cells, page=0, first=0):
    """Spans at the middle of (x, y, text)."""
    return [(doc, page, first + n, 0, t, x - 2.0, y - 2.0, x + 2.0, y + 2.0) for n, (x, y, t) in enumerate(cells)]


def tables(df):
    return {(r.doc_id, r.page_index, r.table_no): (r.source, [list(x) for x in r.rows]) for r in df.collect()}


def test_ruled_tables(spark):
    xs, ys = [0, 40, 90, 130], [0, 15, 30]
    cells = [(20, 7, "a"), (60, 7, "b|"), (110, 7, "c"), (20, 22, "d"), (110, 22, "f")]
    strokes = grid("plain", xs, ys, jitter=0.4) + grid("two", [0, 40, 80], [0, 20, 40]) + grid("two", [200, 240, 280], [0, 20]) + grid("two", [0, 50, 100], [100, 130])
    strokes += [("box", 0, 10.0, 10.0, 60.0, 40.0), ("box", 0, 35.0, 10.0, 35.0, 40.0)]  # a rectangle and an upright
    strokes += [("one", 0, 10.0, 10.0, 60.0, 40.0), ("odd", 0, None, 1.0, 2.0, 3.0), ("odd", 0, 0.0, float("nan"), 50.0, 3.0), ("lines", 0, 0.0, 10.0, 90.0, 10.0)]
    spans = words("plain", cells) + words("two", [(20, 10, "t1"), (220, 10, "t2"), (60, 110, "t3")]) + words("box", [(20, 20, "in"), (45, 20, "out"), (200, 200, "far")]) + words("one", [(20, 20, "x")])
    spans += [("plain", 0, 9, 1, "more", 20.0, 5.0, 24.0, 9.0), ("plain", 0, 9, 0, "and ", 16.0, 5.0, 20.0, 9.0)]
    got = tables(ruling.lattice(spark.createDataFrame(spans, SPANS), spark.createDataFrame(strokes, STROKES)))
    assert got == {
        ("plain", 0, 0): ("lattice", [["a\nand more", "b|", "c"], ["d", "", "f"]]),
        ("two", 0, 0): ("lattice", [["t1", ""], ["", ""]]), ("two", 0, 1): ("lattice", [["t2", ""]]), ("two", 0, 2): ("lattice", [["", "t3"]]),
        ("box", 0, 0): ("lattice", [["in", "out"]]),
    }
    assert ruling.lattice(spark.createDataFrame([], SPANS), spark.createDataFrame([], STROKES)).count() == 0


def test_spanning_cells(spark):
    # A heading over two columns: the upright at 50 begins below it.
    strokes = [("d", 0, 0.0, y, 100.0, y) for y in (0.0, 20.0, 40.0)] + [("d", 0, 0.0, 0.0, 0.0, 40.0), ("d", 0, 100.0, 0.0, 100.0, 40.0), ("d", 0, 50.0, 20.0, 50.0, 40.0)]
    boxes = sorted((r.x0, r.y0, r.x1, r.y1) for r in ruling.cells(spark.createDataFrame(strokes, STROKES)).collect())
    assert boxes == [(0.0, 0.0, 100.0, 20.0), (0.0, 20.0, 50.0, 40.0), (50.0, 20.0, 100.0, 40.0)]
    spans = words("d", [(50, 10, "head"), (25, 30, "l"), (75, 30, "r")])
    assert tables(ruling.lattice(spark.createDataFrame(spans, SPANS), spark.createDataFrame(strokes, STROKES))) == {("d", 0, 0): ("lattice", [["head", ""], ["l", "r"]])}


def test_grids_against_plain_counts(spark):
    rng = random.Random(2)
    strokes, want = [], {}
    for k in range(30):
        xs = sorted(rng.sample(range(0, 600, 10), rng.randrange(2, 7)))
        ys = sorted(rng.sample(range(0, 800, 10), rng.randrange(2, 9)))
        strokes += grid(f"d{k}", [float(x) for x in xs], [float(y) for y in ys], page=k % 3)
        want[f"d{k}"] = sorted((a, c, b, d) for a, b in zip(xs, xs[1:]) for c, d in zip(ys, ys[1:]))
    got = {}
    for r in ruling.cells(spark.createDataFrame(strokes, STROKES)).collect():
        got.setdefault(r.doc_id, []).append((r.x0, r.y0, r.x1, r.y1))
    assert {d: sorted(c) for d, c in got.items()} == want


def test_pages_are_shuffled_once(spark):
    strokes = spark.createDataFrame(grid("d", [0.0, 40.0, 80.0], [0.0, 20.0]), STROKES)
    spans = spark.createDataFrame(words("d", [(20, 10, "a"), (60, 10, "b")]), SPANS)
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    with ruling.by_page(spark):
        boxes = ruling.cells(strokes)
        assert shuffles(boxes) <= 3 and shuffles(ruling.grouped(boxes)) == shuffles(boxes)  # level lines twice (their lengths), uprights
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before
    assert shuffles(ruling.stream(spans)) == 1 and shuffles(ruling.lattice(spans, strokes)) == 0


def test_pages_need_one_sort(spark):
    # Windows and joins over groups of a few rows took most of the time: ruled_tables did not end in time at 1 GB.
    strokes = spark.createDataFrame(grid("d", [0.0, 40.0, 80.0], [0.0, 20.0]), STROKES)
    plan = ruling.grouped(ruling.cells(strokes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "Window" not in plan and "Join" not in plan


def test_many_pages_in_time(spark):
    pages = spark.range(60_000).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("page_index"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("n"))
    line = lambda *c: F.struct(*(F.lit(v).alias(k) if k in ("x0", "x1") else (F.col("n") * 12 + v).cast("double").alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), c, strict=True)))
    strokes = pages.select("doc_id", "page_index", F.explode(F.array(line(0.0, 0, 80.0, 0), line(0.0, 12, 80.0, 12), *(line(x, 0, x, 12) for x in (0.0, 40.0, 80.0)))).alias("s")).select("doc_id", "page_index", "s.*")
    spans = pages.select("doc_id", "page_index", F.col("n").alias("line_no"), F.lit(0).alias("span_no"), F.col("n").cast("string").alias("text"), F.lit(10.0).alias("x0"), (F.col("n") * 12 + 1.0).alias("y0"), F.lit(20.0).alias("x1"), (F.col("n") * 12 + 11.0).alias("y1"))
    began = time.monotonic()
    got = ruling.lattice(spans, strokes, 4).groupBy("rows").count().collect()
    assert time.monotonic() - began < 30
    assert [(r["rows"], r["count"]) for r in got] == [([[str(n), ""] for n in range(5)], 60_000)]


def test_batches_end_with_a_page():
    rows = [("a", 0)] * 3 + [("a", 1)] * 2 + [(None, 1)] + [("b", 0)] * 9 + [("c", 0)] * 2 + [("c", 1)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "page_index"])
    for size in range(1, 20):
        for least in (1, 4, 100):
            got = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in ruling.whole_pages((batch[k : k + size] for k in range(0, len(rows), size)), least)]
            assert [r for b in got for r in b] == rows
            assert all(a[-1] != b[0] for a, b in zip(got, got[1:])) and all(len(b) < least + 10 + size for b in got)
    assert list(ruling.whole_pages(iter([]))) == []


def test_odd_texts_of_ruled_tables(spark):
    long = "".join(random.Random(3).choices("ab é𝒳\n", k=5000)) + "end"
    spans = words("d", [(20, 10, long), (60, 10, None)]) + [("d", 0, None, None, " first ", 18.0, 8.0, 22.0, 12.0), ("d", 0, 5, 0, "tie b", 58.0, 8.0, 62.0, 12.0), ("d", 0, 5, 0, "tie a", 58.0, 8.0, 62.0, 12.0), ("d", 0, 6, 0, "none", float("nan"), 8.0, 62.0, 12.0)]
    spans += words("bare", [(20, 10, "no strokes")])
    strokes = grid("d", [0.0, 40.0, 80.0], [0.0, 20.0]) + grid("d", [0.0, 40.0], [100.0, 120.0]) + grid("d", [0.0, 40.0, 80.0], [200.0, 220.0])
    got = tables(ruling.lattice(spark.createDataFrame(spans, SPANS), spark.createDataFrame(strokes, STROKES)))
    # The table of a single cell isn't given, and keeps its number.
    assert got == {("d", 0, 0): ("lattice", [["first\n" + long.strip(), "tie atie b"]]), ("d", 0, 2): ("lattice", [["", ""]])}
    assert tables(ruling.lattice(spark.createDataFrame(spans, SPANS), spark.createDataFrame([], STROKES))) == {}


def test_dense_pages(spark):
    # Tables one below the other have lines with all uprights in reach, and those in a row points with all heights.
    n, wide = 4000, 150
    down = [("down", 0, *c) for k in range(n) for c in ((0.0, 20.0 * k, 40.0, 20.0 * k + 10), (20.0, 20.0 * k, 20.0, 20.0 * k + 10))]
    beside = [("beside", 0, *c) for k in range(n) for c in ((60.0 * k, 7.0 * (k % 9), 60.0 * k + 40, 100.0 + 7 * (k % 5)), (60.0 * k + 20, 7.0 * (k % 9), 60.0 * k + 20, 100.0 + 7 * (k % 5)))]
    spans = [(d, 0, k, 0, str(k), x, y, x, y) for k in range(n) for d, x, y in (("down", 10.0, 20.0 * k + 5), ("beside", 60.0 * k + 30, 80.0))]
    spans += [("grid", 0, a, b, f"{a} {b}", 10.0 * b, 10.0 * a, 10.0 * b + 8, 10.0 * a + 8) for a in range(wide) for b in range(wide)]
    strokes = down + beside + grid("grid", [10.0 * k for k in range(wide + 1)], [10.0 * k for k in range(wide + 1)])
    got = tables(ruling.lattice(spark.createDataFrame(spans, SPANS), spark.createDataFrame(strokes, STROKES)))
    assert got.pop(("grid", 0, 0)) == ("lattice", [[f"{a} {b}" for b in range(wide)] for a in range(wide)])
    assert got == {("down", 0, k): ("lattice", [[str(k), ""]]) for k in range(n)} | {("beside", 0, k): ("lattice", [["", str(k)]]) for k in range(n)}


def test_aligned_columns_and_the_choice(spark):
    line = lambda doc, n, *cells: [(doc, 0, n, k, t, x, 12.0 * n, x + 5.0 * len(t), 12.0 * n + 10) for k, (x, t) in enumerate(cells)]
    spans = line("s", 0, (0.0, "a title over all")) + line("s", 1, (0.0, "name"), (100.0, "n")) + line("s", 2, (1.0, "ana"), (99.0, "1")) + line("s", 3, (0.0, "bo"), (10.0, "bo"), (101.0, "22")) + line("s", 4, (0.0, "x"), (150.0, "y")) + line("s", 5, (0.0, "end"))
    ruled = words("r", [(20, 10, "in"), (60, 10, "b")]) + line("r", 8, (0.0, "p"), (100.0, "q")) + line("r", 9, (0.0, "p"), (100.0, "q"))
    given = [("p", 0, 0, "primary", [["given"]])]
    strokes = grid("r", [0.0, 40.0, 80.0], [0.0, 20.0]) + grid("p", [0.0, 40.0, 80.0], [0.0, 20.0])
    primary = spark.createDataFrame(given, "doc_id string, page_index int, table_no int, source string, rows array<array<string>>")
    got = tables(ruling.extracted(spark.createDataFrame(spans + ruled, SPANS), spark.createDataFrame(strokes, STROKES), primary))
    assert got == {("p", 0, 0): ("primary", [["given"]]), ("r", 0, 0): ("lattice", [["in", "b"]]), ("s", 0, 0): ("stream", [["name", "n"], ["ana", "1"], ["bobo", "22"]])}


def test_substring_search_by_lists(spark):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdeÁ ") for _ in range(n))
    rows = [(f"d{k}", text(20), None if k % 5 == 0 else text(9), text(60), text(rng.randrange(0, 80))) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id string, titulo string, autor string, ementa string, assunto string").repartition(4)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/index"
    trigrams.write(trigrams.lists(docs), path)
    index = trigrams.read(spark, path)
    assert index.agg(F.max(F.size("docs"))).first()[0] <= trigrams.RANGE
    for term in ("abcde", "ÁB c", "ab", "a_cd%be", "zzz", " ", "dea\\%"):
        want = {r[0] for r in rows if any(v is not None and like(term.strip(), v) for v in r[1:])}
        assert {r.doc_id for r in trigrams.holding(docs, index, term).collect()} == want
    assert trigrams.candidates(index, "abcde").count() < 300 and trigrams.candidates(index, "ab") is None
    full = docs.withColumns({"ano": F.lit(1), "situacao_doc": F.lit(""), "tipo_pdf": F.lit("")})
    plain, listed = catalog.browse(full, search="abcd", limit=20), catalog.browse(full, search="abcd", limit=20, index=index)
    assert plain.collect() == listed.collect()


def like(term, value):
    import re

    out, i = "", 0
    while i < len(term):
        if term[i] == "\\":
            out, i = out + re.escape(term[i + 1 : i + 2]), i + 2
        else:
            out, i = out + {"%": ".*", "_": "."}.get(term[i], re.escape(term[i].lower())), i + 1
    return re.search(out, value.lower(), re.S) is not None


def test_a_document_that_kills_its_process(spark):
    def make():
        def work(row):
            if row["doc_id"] == "dies":
                os._exit(9)
            if row["doc_id"] == "hangs":
                time.sleep(60)
            if row["doc_id"] == "fails":
                raise ValueError("not a document " + "x" * 500)
            return [{"page": k, "text": row["t"] * k} for k in range(row["n"])]

        return work

    names = ["a", "dies", "b", "hangs", "c", "fails", "d", "none", "dies"]
    rows = spark.createDataFrame([(n, "t", 0 if n == "none" else 2) for n in names], "doc_id string, t string, n int").coalesce(1)
    schema = StructType([StructField("page", IntegerType()), StructField("text", StringType())])
    got = [tuple(r) for r in quarantine.isolated(rows, make, schema, seconds=3, rows_each=2).collect()]
    for n in "abcd":
        assert sorted(r[1:] for r in got if r[0] == n) == [(0, "", None), (1, "t", None)]
    errors = {r[0]: r[3] for r in got if r[3]}
    assert set(errors) == {"dies", "hangs", "fails"} and "died (9)" in errors["dies"] and "longer than 3 s" in errors["hangs"] and len(errors["fails"]) == 240
    assert len(got) == 4 * 2 + 4


@pytest.mark.parametrize("rows", [[], [("x", "t", 1)]])
def test_no_rows_and_one(spark, rows):
    schema = StructType([StructField("page", IntegerType())])
    df = spark.createDataFrame(rows, "doc_id string, t string, n int")
    assert quarantine.isolated(df, lambda: lambda row: [{"page": 1}], schema).count() == len(rows)


def test_lists_of_long_texts(spark):
    # A text of 1,000,000 characters: cutting each string out from the text's beginning took quadratic time.
    long = "".join(random.Random(1).choices("abcdefghij ÁΩ𝒳", k=1_000_000))
    rows = [("long", long, None, "aba", ""), (None, "xyzzy", "", "", ""), ("short", "aÁb", "ab", "𝒳yz", "b𝒳c")]
    docs = spark.createDataFrame(rows, "doc_id string, titulo string, autor string, ementa string, assunto string").coalesce(1)
    began = time.monotonic()
    got = {(r.gram, d) for r in trigrams.lists(docs).collect() for d in r.docs}
    assert time.monotonic() - began < 60
    low = long.lower()
    want = {(low[i : i + 3], "long") for i in range(len(low) - 2)} | {("aba", "long")} | {(g, "short") for g in ("aáb", "𝒳yz", "b𝒳c")}
    assert got == want

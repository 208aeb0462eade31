"""Tables from ruling lines, and from gaps between columns where no lines are drawn.

Strokes are snapped and united along their lines; cells are found from the crossings:
a cell has an edge above and one below between the same two uprights, and one on
either side between the same two levels. Uprights that only reach a line from the
other side don't part its cells, so spanning cells are found too. Spans go to the
cell that holds their middle.

Spark brings the rows of a page together and sorts them; ``grids`` works on whole
pages, many in a batch. Windows and joins that did the same took most of their time
for groups of a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip
from quarry.operators import grids, intervals
from quarry.session import cut

PAGE = ["doc_id", "page_index"]
CORNERS = ["x0", "y0", "x1", "y1"]
#: The gap that parts columns of text, and how far their beginnings may be apart.
GAP, ALIGNED = 12.0, 6.0
#: Rows of a batch of whole pages, at least, and the characters of a text that travel in one row.
ROWS, PIECE = 1 << 16, 1024


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_page(spark: SparkSession) -> AbstractContextManager[None]:
    """Sides that lie by page already are joined where they are, though the join has more keys than the page."""
    return _setting(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")


def by_rows(spark: SparkSession) -> AbstractContextManager[None]:
    """Arrow batches end by their rows only: to look at their bytes after each row takes Spark longer than to send it. For rows of bounded size."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", str(2**31 - 1))


def parted(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """Rows by page, in ``parts`` or as many partitions as shuffles have: all sides in as many, so that they can meet."""
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *PAGE)


def numbered(doc: pa.Array, index: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of sorted rows' pages, from 0, and each page's first row."""
    new = grids.changes(*(c.dictionary_encode("encode").indices.to_numpy() for c in (doc, index)))
    return np.cumsum(new) - 1, np.flatnonzero(new)


def whole_pages(batches: Iterator[pa.RecordBatch], rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """Sorted rows in batches of ``rows`` or more that end with a page; a page of any size is in one of them."""
    held, n, last = [], 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        begins = int(numbered(batch.column(0), batch.column(1))[1][-1])  # of the batch's last page
        own = [c[-1].as_py() for c in batch.columns[:2]]
        n += batch.num_rows
        if n >= (rows or ROWS) and (begins or own != last):
            if begins or held:
                yield pa.concat_batches([*held, batch[:begins]])
            held, n = [], batch.num_rows - begins
            batch = batch[begins:]
        held.append(batch)
        last = own
    if held:
        yield pa.concat_batches(held)


def _floats(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def cells(strokes: DataFrame, parts: int | None = None) -> DataFrame:
    """(page, x0, y0, x1, y1) of the cells that strokes draw, page by page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_pages(batches):
            page, first = numbered(batch.column(0), batch.column(1))
            boxes = grids.cells(page, *_floats(batch, CORNERS))
            names = [batch.column(k).take(pa.array(first[boxes.page])) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*names, *(pa.array(c) for c in boxes[1:])], [*PAGE, *CORNERS])

    rows = parted(strokes.where(intervals.finite(*CORNERS)).select(*PAGE, *(F.col(c).cast("double").alias(c) for c in CORNERS)), parts).sortWithinPartitions(*PAGE)
    return rows.mapInArrow(run, rows.schema)


def grouped(boxes: DataFrame) -> DataFrame:
    """Cells, as ``cells`` gives them, with ``table_no`` within their page, from above and then from the left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_pages(batches):
            page, _ = numbered(batch.column(0), batch.column(1))
            part = grids.tables(grids.Boxes(page, *_floats(batch, CORNERS)))
            numbers = pa.array(grids.ranks(page, part), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, numbers], [*batch.schema.names, "table_no"])

    return boxes.mapInArrow(run, boxes.withColumn("table_no", F.lit(0)).schema)


def _nested(values: pa.Array, *counts: np.ndarray) -> pa.Array:
    """Lists of lists: ``counts`` has the lengths of the innermost lists first."""
    for n in counts:
        values = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), values)
    return values


def _filled(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(page, table_no, cells) of the tables of two cells or more in a batch of whole pages: in each of their rows and columns the spans' texts, by line."""
    page, first = numbered(batch.column(0), batch.column(1))
    stroke = batch.column("stroke").to_numpy(zero_copy_only=False)
    corners = _floats(batch, CORNERS)
    boxes = grids.cells(page[stroke], *(c[stroke] for c in corners))
    part = grids.tables(boxes)
    number, many = grids.ranks(boxes.page, part), np.bincount(part)[part] > 1
    boxes, number = grids.Boxes(*(c[many] for c in boxes)), number[many]
    part = np.unique(part[many], return_inverse=True)[1]
    row, col = grids.ranks(part, boxes.y0), grids.ranks(part, boxes.x0)
    n = int(part.max(initial=-1)) + 1
    height, width, of, no = (np.zeros(n, np.int64) for _ in range(4))
    np.maximum.at(height, part, row + 1)
    np.maximum.at(width, part, col + 1)
    of[part], no[part] = boxes.page, number
    # Places of all tables one after the other, also those without a cell; rows of spans come in reading order.
    size = height * width
    place = (np.cumsum(size) - size)[part] + row * width[part] + col
    spans = np.flatnonzero(~stroke)
    x0, y0, x1, y1 = (c[spans] for c in corners)
    box, point = grids.holding(boxes, page[spans], (x0 + x1) / 2, (y0 + y1) / 2)
    point, place = spans[point], place[box]
    by = np.lexsort((point, place))
    point, place = point[by], place[by]
    line = batch.column("line_no").dictionary_encode("encode").indices.to_numpy()[point]
    starts = np.flatnonzero(grids.changes(place, line))
    texts = batch.column("text").take(pa.array(point))
    nested = _nested(texts, np.diff(np.append(starts, len(point))), np.bincount(place[starts], minlength=size.sum()), np.repeat(width, height), height)
    names = [batch.column(k).take(pa.array(first[of])) for k in range(2)]
    return pa.RecordBatch.from_arrays([*names, pa.array(no, pa.int32()), nested], [*PAGE, "table_no", "cells"])


def lattice(spans: DataFrame, strokes: DataFrame, parts: int | None = None) -> DataFrame:
    """(page, table_no, source, rows) of ruled tables of two cells or more, with the spans' texts in reading order.

    Strokes and spans are shuffled by page, unless they lie so already, and sorted; all that follows is done within the page's task.
    """
    kinds = dict(spans.dtypes)
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    drawn = parted(strokes.where(intervals.finite(*CORNERS)), parts).select(*PAGE, F.lit(True).alias("stroke"), *corners, *(F.lit(None).cast(kinds[c]).alias(c) for c in ("line_no", "span_no", "text")))
    middle = spans.withColumns({"_x": (F.col("x0") + F.col("x1")) / 2, "_y": (F.col("y0") + F.col("y1")) / 2}).where(intervals.finite("_x", "_y"))
    written = parted(middle, parts).select(*PAGE, F.lit(False).alias("stroke"), *corners, "line_no", "span_no", "text")
    # Both sides lie by page, and so does their union: Spark sees that, and doesn't shuffle it again.
    rows = parted(drawn.unionByName(written), parts).sortWithinPartitions(*PAGE, "line_no", "span_no", "text").drop("span_no")
    # Long texts travel in pieces, which come together again as spans of a line do.
    rows = rows.withColumn("text", F.explode_outer(F.when(F.octet_length("text") > PIECE, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array("text"))))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_pages(batches):
            yield _filled(batch)

    found = rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, page_index {kinds['page_index']}, table_no int, cells array<array<array<array<string>>>>")
    text = lambda lines: strip(F.array_join(F.transform(lines, lambda t: strip(F.array_join(t, ""))), "\n"))
    with by_rows(spans.sparkSession):
        return cut(found.select(*PAGE, "table_no", F.transform("cells", lambda r: F.transform(r, text)).alias("rows"), F.lit("lattice").alias("source")))


def stream(spans: DataFrame, parts: int | None = None) -> DataFrame:
    """(page, table_no, source, rows) of lines that follow each other with as many columns, two or more, at the same places."""
    line = [*PAGE, "line_no"]
    w = Window.partitionBy(*line).orderBy("x0", "span_no")
    s = parted(spans.where(intervals.finite("x0", "x1", "y0") & (strip(F.col("text")) != "")), parts)  # the only shuffle
    s = s.withColumn("col", 1 + F.sum(F.coalesce((F.col("x0") - F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1)) > GAP).cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = s.groupBy(*line, "col").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_no", "text"))), lambda t: t.text), "")).alias("text"))
    lines = parts.groupBy(*line).agg(F.min("y").alias("y"), F.transform(F.array_sort(F.collect_list(F.struct("col", "x"))), lambda c: c.x).alias("xs"), F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c.text).alias("cells"))
    by = Window.partitionBy(*PAGE).orderBy("y", "line_no")
    like = (F.size("xs") == F.size(F.lag("xs").over(by))) & ~F.exists(F.zip_with("xs", F.lag("xs").over(by), lambda a, b: F.abs(a - b) > ALIGNED), lambda far: far)
    lines = lines.withColumn("_new", F.when(F.coalesce(like, F.lit(False)), 0).otherwise(1))
    lines = lines.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).where(F.size("xs") > 1)
    tables = lines.groupBy(*PAGE, "_run").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "line_no", "cells"))), lambda r: r.cells).alias("rows")).where(F.size("rows") > 1)
    return tables.withColumn("table_no", (F.row_number().over(Window.partitionBy(*PAGE).orderBy("_run")) - 1).cast("int")).select(*PAGE, "table_no", "rows", F.lit("stream").alias("source"))


def extracted(spans: DataFrame, strokes: DataFrame, primary: DataFrame | None = None) -> DataFrame:
    """Tables (page, table_no, source, rows) of all documents: those in ``primary``, else ruled ones, else those of aligned lines.

    Only documents without a table so far are looked at by the next way.
    """
    names = [*PAGE, "table_no", "source", "rows"]
    done = None if primary is None else primary.where(F.size("rows") > 0).select(*names)
    left = lambda df: df if done is None else df.join(done.select("doc_id").distinct(), "doc_id", "left_anti")
    ruled = lattice(left(spans), left(strokes)).select(*names)
    done = ruled if done is None else done.unionByName(ruled)
    return done.unionByName(stream(left(spans)).select(*names))

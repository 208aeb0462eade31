"""Pages: routing, tables, struck-out text, overlays and summaries by document."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Config
from quarry.functions.text import strip, strip_end
from quarry.operators import intervals


def image_ratio(areas: Column, page_area: Column) -> Column:
    """Share of a page that images cover, 1 at most; no page area: 0."""
    total = F.aggregate(F.coalesce(areas, F.array().cast("array<double>")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    return F.when(page_area > 0, F.least(total / page_area, F.lit(1.0))).otherwise(0.0)


def classify(char_count: Column, has_table: Column, config: Config = DEFAULT) -> Column:
    return F.when(char_count < config.router_min_chars, "scanned").when(F.coalesce(has_table, F.lit(False)), "complex").otherwise("digital")


def needs_vision(classification: Column, text: Column, tables: Column) -> Column:
    """Pages without readable text, and complex ones without a table."""
    empty = strip(F.coalesce(text, F.lit(""))) == ""
    no_table = F.coalesce(F.size(tables), F.lit(0)) <= 0
    return (classification.isin("scanned", "complex") & empty) | ((classification == "complex") & no_table)


def summary(pages: DataFrame) -> DataFrame:
    """By document: pages by kind, and what kind of document that makes."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), n(F.col("classification") == "scanned").alias("scanned_pages"), n(F.col("classification") == "complex").alias("complex_pages"),
        n(F.col("has_revoked")).alias("revoked_pages"), n(F.col("needs_vision")).alias("vision_pages"), F.coalesce(F.sum("char_count"), F.lit(0)).cast("long").alias("total_chars"),
    )
    return out.withColumn("mix", mix(F.col("vision_pages"), F.col("total_pages")))


def mix(vision_pages: Column, total_pages: Column) -> Column:
    return F.when(F.coalesce(vision_pages, F.lit(0)) == 0, "digital").when(vision_pages < total_pages, "mixed").otherwise("vision_heavy")


def histogram(pages: DataFrame) -> DataFrame:
    """Pages of each kind by document, 0 where there are none."""
    kinds = ["digital", "scanned", "complex"]
    return pages.groupBy("doc_id").pivot("classification", kinds).count().fillna(0, kinds)


def table_markdown(rows: Column) -> Column:
    """A ragged array of rows as Markdown, the first row as its header; no rows: an empty text."""
    cell = lambda c: F.trim(strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))))
    width = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r)))), cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    text = F.concat_ws("\n", line(F.element_at(rows, 1)), rule, F.array_join(F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line), "\n"))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) <= 0, "").otherwise(F.regexp_replace(text, "\n$", ""))


def tables_by_page(tables: DataFrame) -> DataFrame:
    """Rendered tables of each page in order; of a document the first source that has any counts.

    Sources come in the order primary, lattice, stream.
    """
    full = tables.where(F.size("rows") > 0).withColumn("_rank", F.when(F.col("source") == "primary", 0).when(F.col("source") == "lattice", 1).otherwise(2))
    first = F.min("_rank").over(Window.partitionBy("doc_id"))
    chosen = full.withColumn("_first", first).where("_rank = _first").withColumn("markdown", table_markdown(F.col("rows")))
    return chosen.groupBy("doc_id", "page_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("table_no", "markdown"))), lambda t: t.markdown).alias("tables_markdown"))


def overlaid(pages: DataFrame, vision: DataFrame) -> DataFrame:
    """Page texts: the vision result where it is ok and not blank, else text and tables."""
    v = vision.where("status = 'ok'").select("doc_id", "page_index", strip(F.col("markdown")).alias("_seen")).where("_seen <> ''")
    own = F.concat_ws("\n\n", F.nullif(strip(F.coalesce("text_markdown", F.lit(""))), F.lit("")), F.nullif(F.array_join("tables_markdown", "\n\n"), F.lit("")))
    return pages.join(v, ["doc_id", "page_index"], "left").withColumn("page_text", F.coalesce("_seen", own)).drop("_seen")


def vision_todo(pages: DataFrame, vision: DataFrame) -> DataFrame:
    """Pages that need vision and have no good result yet."""
    return pages.where("needs_vision").join(vision.where("status = 'ok'"), ["doc_id", "page_index"], "left_anti")


def merge_vision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results by page, new ones instead of old ones."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("doc_id", "page_index").orderBy(F.desc("_new"))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def stroke_lines(drawings: DataFrame) -> DataFrame:
    """Flat lines and thin boxes (kind 'line' or 'rect') as lines with ordered corners."""
    flat = (F.col("kind") == "line") & (F.abs(F.col("y1") - F.col("y0")) <= 1.2) & (F.abs(F.col("x1") - F.col("x0")) > 4)
    thin = (F.col("kind") == "rect") & (F.col("y1") - F.col("y0") <= 2.0) & (F.col("x1") - F.col("x0") > 4)
    return drawings.where(flat | thin).select(
        "doc_id", "page_index", F.lit("line").alias("kind"), F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"), F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1")
    )


def _probes(coverage: float) -> list[float]:
    """Places along a span's width of which any stroke that covers ``coverage`` of it meets one."""
    if coverage > 0.5:
        return [0.5]
    n = math.ceil(1 / max(coverage, 0.02))
    return [k / n for k in range(n + 1)]


def strike_pairs(spans: DataFrame, marks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Spans with the marks of their page that may strike them out, as pairs on equal bands of height and width.

    Both sides stand in bands of height; in the width, a stroke that covers enough
    of a span reaches its middle, so the span stands in the bands of that place
    and the mark in those of its width. Spans and marks of a page with very
    many of both meet in proportion to those that lie on each other.
    """
    page, side = ["doc_id", "page_index"], ["x0", "y0", "x1", "y1"]
    m = marks.where(F.col("kind").isin("line", "annotation") & intervals.finite(*side)).select(*page, "kind", *(F.col(c).alias(f"m{c}") for c in side))
    middle = (F.col("my0") + F.col("my1")) / 2
    flat = F.col("kind") == "line"  # a line counts at its middle, an annotation from edge to edge
    m = m.withColumns({"_mlow": F.when(flat, middle).otherwise(F.least("my0", "my1")), "_mhigh": F.when(flat, middle).otherwise(F.greatest("my0", "my1")), "_left": F.least("mx0", "mx1"), "_right": F.greatest("mx0", "mx1")})
    s = spans.where(intervals.finite(*side)).withColumns({"_low": F.least("y0", "y1"), "_high": F.greatest("y0", "y1")})
    reach = (F.col("y1") - F.col("y0")) * config.strike_band
    if config.strike_band > 0.5:  # then the band is wider than the span
        s = s.withColumns({"_low": F.least("_low", (F.col("y0") + F.col("y1")) / 2 - F.abs(reach)), "_high": F.greatest("_high", (F.col("y0") + F.col("y1")) / 2 + F.abs(reach))})
    s = s.withColumn("_at", F.explode(F.array(*(F.col("x0") + (F.col("x1") - F.col("x0")) * f for f in _probes(config.strike_coverage)))))
    wide = F.collect_set(intervals.level(F.col("_left"), F.col("_right"))).alias("_wide")
    of_marks = m.groupBy(*page).agg(F.collect_set(intervals.level(F.col("_mlow"), F.col("_mhigh"))).alias("_flat"), wide)
    s, m = s.join(of_marks, page), m.join(intervals.levels(s, page, "_tall", "_low", "_high"), page)  # pages without both have no pairs
    s = intervals.banded(s.withColumn("_wx", F.explode("_wide")), F.col("_flat"), "_s", "_low", "_high")
    s = s.withColumn("_bx", F.floor(F.col("_at") / (F.lit(intervals.BASE) * F.pow(F.lit(2.0), F.col("_wx")))).cast("long"))
    m = intervals.banded(m, F.col("_tall"), "_m", "_mlow", "_mhigh").withColumn("_wx", intervals.level(F.col("_left"), F.col("_right")))
    width = F.lit(intervals.BASE) * F.pow(F.lit(2.0), F.col("_wx"))
    m = m.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("_left") / width).cast("long"), F.floor(F.col("_right") / width).cast("long"))))
    return s.drop("_flat", "_wide").join(m.drop("_tall"), [*page, "_l", "_b", "_wx", "_bx"]).where(intervals.once("_s", "_m"))


def struck(spans: DataFrame, marks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """``spans`` with ``revoked``: a stroke line or a strike-out annotation of its page covers enough of it.

    ``marks`` has kind 'line' or 'annotation'; coordinates that aren't finite strike nothing.
    """
    width, middle = F.col("x1") - F.col("x0"), (F.col("y0") + F.col("y1")) / 2
    band = (F.col("y1") - F.col("y0")) * config.strike_band
    level = (F.col("my0") + F.col("my1")) / 2
    overlap = F.greatest(F.lit(0.0), F.least("x1", "mx1") - F.greatest("x0", "mx0"))
    line = (F.col("kind") == "line") & (width > 0) & level.between(middle - band, middle + band) & (overlap / F.nullif(width, F.lit(0.0)) >= config.strike_coverage)
    touch = (F.col("mx1") >= F.col("x0")) & (F.col("mx0") <= F.col("x1")) & (F.col("my1") >= F.col("y0")) & (F.col("my0") <= F.col("y1"))
    note = (F.col("kind") == "annotation") & touch & (overlap / F.greatest(F.lit(1e-6), width) >= config.strike_coverage)
    keys = ["doc_id", "page_index", "line_no", "span_no"]
    own = spans.drop("revoked")
    hit = strike_pairs(own.select(*keys, "x0", "y0", "x1", "y1"), marks, config).where(line | note).select(*keys).distinct().withColumn("revoked", F.lit(True))
    return own.join(hit, keys, "left").withColumn("revoked", F.coalesce("revoked", F.lit(False)))


def spans_markdown(spans: DataFrame) -> DataFrame:
    """Text of each line with runs of revoked spans in strike-out marks; empty lines are dropped."""
    line = ["doc_id", "page_index", "line_no"]
    w = Window.partitionBy(*line).orderBy("span_no")
    same = F.lag("revoked").over(w) == F.col("revoked")
    runs = spans.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    joined = lambda *key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key))), lambda s: s[key[-1]]), "")
    runs = runs.groupBy(*line, "_run").agg(F.first("revoked").alias("revoked"), joined("span_no", "text").alias("text"))
    marked = F.when(F.col("revoked") & (F.length(strip(F.col("text"))) >= 3), F.concat(F.lit("~~"), F.col("text"), F.lit("~~"))).otherwise(F.col("text"))
    out = runs.withColumn("text", marked).groupBy(*line).agg(strip_end(joined("_run", "text")).alias("markdown"))
    return out.where("markdown <> ''")


def page_revoked(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "page_index").agg(F.bool_or("revoked").alias("has_revoked"))


def assembled(spans: DataFrame, tables: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """A row for each page of struck() spans: its text, tables, kind, flags and ``page_text``, the text followed by the tables."""
    page = ["doc_id", "page_index"]
    lines = spans_markdown(spans)
    text = lines.groupBy(*page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "markdown"))), lambda x: x.markdown), "\n").alias("text_markdown"))
    sizes = spans.groupBy(*page).agg(F.sum(F.length(strip(F.col("text")))).alias("char_count"), F.bool_or("revoked").alias("has_revoked"))
    rows = sizes.join(text, page, "left").join(tables_by_page(tables), page, "left")
    rows = rows.withColumns({"text_markdown": F.coalesce("text_markdown", F.lit("")), "tables_markdown": F.coalesce("tables_markdown", F.array().cast("array<string>"))})
    rows = rows.withColumn("classification", classify(F.col("char_count"), F.size("tables_markdown") > 0, config))
    rows = rows.withColumn("needs_vision", needs_vision(F.col("classification"), F.col("text_markdown"), F.col("tables_markdown")))
    return rows.withColumn("page_text", F.concat_ws("\n\n", F.nullif(strip(F.col("text_markdown")), F.lit("")), F.nullif(F.array_join("tables_markdown", "\n\n"), F.lit(""))))

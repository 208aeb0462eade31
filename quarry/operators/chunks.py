"""Chunks: structural blocks, overlapping windows of paragraphs, merging of small pieces."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.config import DEFAULT, Config
from quarry.functions.ids import chunk_id
from quarry.functions.text import approx_tokens, lines, strip, strip_end

#: Fixed patterns of headings and their kinds, in the order in which they are tried.
HEADINGS = (
    (r"(?iuU)^\s*CAP[IÍ]TULO\s+[IVXLCDM]+", "capitulo"),
    (r"(?iuU)^\s*SE[ÇC][AÃ]O\s+[IVXLCDM]+", "secao"),
    (r"(?iuU)^\s*TÍTULO\s+[IVXLCDM]+", "titulo"),
    (r"(?iuU)^\s*Art\.\s*\d+[ºo]?\b", "artigo"),
    (r"(?U)^\s*§\s*\d+[ºo]?\b", "paragrafo"),
    (r"(?iuU)^\s*Par[áa]grafo\s+[úu]nico\b", "paragrafo"),
)


def heading_kind(line: Column) -> Column:
    """Kind of the first pattern that a line matches; most lines fail a look at their first letters."""
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(HEADINGS):
        out = F.when(F.rlike(line, F.lit(pattern)), kind).otherwise(out)
    return F.when(F.rlike(line, F.lit(r"(?iuU)^\s*(?:CAP|SE[ÇC]|TÍT|ART|§|PAR)")), out)


def has_table(text: Column) -> Column:
    """A row of cells and a rule below it, behind a line end."""
    return F.rlike(text, F.lit(r"(?U)\n\s*\|[^\n]+\|\s*\n\s*\|\s*-{2,}"))


def has_revoked(text: Column) -> Column:
    return F.rlike(text, F.lit("~~[^~]+~~"))


def clean_text(text: Column) -> Column:
    """Without blank table rows, empty strike-outs and runs of blank lines.

    The pattern of blank rows is written so that it takes linear time.
    """
    text = F.regexp_replace(text, r"(?dmU)^\s*\|[\s|]*$", "")
    text = F.regexp_replace(text, r"(?U)~~\s*~~", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def page_lines(pages: DataFrame, text: str = "page_text") -> DataFrame:
    """(doc_id, page_index, line_no, line) with white space cut from the right."""
    return pages.select("doc_id", "page_index", F.posexplode(F.transform(lines(F.coalesce(text, F.lit(""))), strip_end)).alias("line_no", "line"))


def structural_blocks(rows: DataFrame) -> DataFrame:
    """Blocks of lines (doc_id, page_index, line_no, line), parted at headings.

    An article heading starts a block and becomes the current article; other
    headings start one and keep the article; blank lines before a block are
    dropped. ``page_end`` is the page of the last line that is neither blank nor
    such a heading.
    """
    kind = heading_kind(F.col("line"))
    rows = rows.withColumn("_kind", kind).withColumns({"_blank": F.col("line") == "", "_article": F.coalesce(F.col("_kind") == "artigo", F.lit(False)), "_head": F.coalesce(F.col("_kind").isin("capitulo", "secao", "titulo"), F.lit(False))})
    order = ["page_index", "line_no"]
    w = Window.partitionBy("doc_id").orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    first = F.sum(F.when(F.col("_blank"), 0).otherwise(1)).over(upto) == 1
    rows = rows.withColumn("_start", ~F.col("_blank") & (F.col("_article") | F.col("_head") | first))
    rows = rows.withColumn("block_no", F.sum(F.col("_start").cast("int")).over(upto)).withColumn("_ref", F.last(F.when(F.col("_article"), strip(F.col("line"))), True).over(upto))
    plain = ~F.col("_blank") & ~F.col("_article") & ~F.col("_head")
    at = F.struct(*order)
    blocks = rows.where("block_no > 0").groupBy("doc_id", "block_no").agg(
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda x: x.line), "\n")).alias("text"),
        F.min("page_index").alias("page_start"),
        F.coalesce(F.max(F.when(plain, F.col("page_index"))), F.min("page_index")).alias("page_end"),
        F.min_by("_ref", at).alias("article_ref"),
    )
    return blocks.where("text <> ''")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?U)\n\s*\n"), strip), lambda p: p != "")


def packed(lengths: Iterable[int], limit: int, overlap: int) -> list[tuple[int, int]]:
    """First paragraph and number of paragraphs of each piece, from the paragraphs' lengths."""
    out, first, size, every = [], 0, 0, list(lengths)
    for k, n in enumerate(every):
        if size + n > limit and k > first:
            out.append((first + 1, k - first))
            at, size = k, 0
            while at > first and size + every[at - 1] <= overlap:
                at -= 1
                size += every[at]
            first = at
        size += n
    return [*out, (first + 1, len(every) - first)]


def window_pieces(text: Column, config: Config = DEFAULT) -> Column:
    """``text`` itself, or if it is too long its paragraphs packed into overlapping pieces.

    A piece ends before the paragraph that would exceed the window; the next one
    repeats as many whole paragraphs from its end as the overlap allows. A
    longer paragraph is never parted. The fold over the paragraphs' lengths runs
    in Arrow batches, as one in SQL copies its state at every paragraph.
    """
    limit, overlap = config.max_tokens * 4, config.overlap_tokens * 4

    @F.pandas_udf("array<struct<first:int,size:int>>")
    def borders(parts: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else packed(x.tolist(), limit, overlap) for x in parts], dtype=object)

    long = approx_tokens(text) > config.max_tokens
    parts = F.when(long, paragraphs(text))
    # Through an array of one entry, so that the paragraphs are found once for all pieces.
    both = F.array(F.struct(parts.alias("parts"), borders(F.transform(parts, F.length)).alias("borders")))
    pieces_ = F.element_at(F.transform(both, lambda s: F.transform(s["borders"], lambda b: F.array_join(F.slice(s["parts"], b["first"], b["size"]), "\n\n"))), 1)
    return F.when(long & (F.size(parts) > 0), pieces_).otherwise(F.array(text))


def pieces(blocks: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Pieces of all blocks, numbered through each document (``piece_no``)."""
    out = blocks.select("doc_id", "block_no", "page_start", "page_end", "article_ref", F.posexplode(window_pieces(F.col("text"), config)).alias("in_block", "piece"))
    return out.withColumn("piece_no", F.row_number().over(Window.partitionBy("doc_id").orderBy("block_no", "in_block")) - 1).drop("in_block")


def merged(rows: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Chunks of pieces (doc_id, piece_no, piece, page_start, page_end, article_ref).

    A small piece without a table joins the chunk before it, if there is one.
    """
    table, small = has_table(F.col("piece")), approx_tokens(F.col("piece")) < config.min_tokens
    w = Window.partitionBy("doc_id").orderBy("piece_no")
    rows = rows.withColumns({"_table": table, "_start": (F.row_number().over(w) == 1) | table | ~small})
    rows = rows.withColumn("chunk_index", F.sum(F.col("_start").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    by = lambda f, c: f(c, "piece_no")
    out = rows.groupBy("doc_id", "chunk_index").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", clean_text(F.col("piece")).alias("t")))), lambda x: x.t), "\n\n").alias("text"),
        by(F.min_by, "piece").alias("_raw"), by(F.min_by, "article_ref").alias("article_ref"), by(F.min_by, "_table").alias("has_table"),
        F.bool_or(has_revoked(F.col("piece"))).alias("has_revoked"), by(F.min_by, "page_start").alias("page_start"), by(F.max_by, "page_end").alias("page_end"),
    )
    return out.withColumn("chunk_id", chunk_id(F.col("doc_id"), F.col("chunk_index"), F.col("_raw"))).drop("_raw")


def with_metadata(chunks: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Chunks with a document's metadata; documents that the catalog lacks have none."""
    return chunks.drop(*columns).join(catalog.select("doc_id", *columns), "doc_id", "left")

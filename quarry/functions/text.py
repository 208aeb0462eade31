"""Text columns with the semantics of Unicode-aware strip, line and pattern operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WS = r"[\s\x1C-\x1F]"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_WS}+|(?<!{_WS}){_WS}++\z", "")


def strip_end(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)(?<!{_WS}){_WS}++\z|\A{_WS}+\z", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def lines(c: Column) -> Column:
    """Lines at any Unicode line end; a last line end opens no further line."""
    parts = F.split(c, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]")
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def clean_value(c: Column, prefix: str | None = None) -> Column:
    """Stripped, without a leading label in any case; empty: null."""
    text = strip(c)
    if prefix:
        text = F.when(F.startswith(F.lower(text), F.lit(prefix.lower())), strip(F.substring(text, len(prefix) + 1, 2**31 - 1))).otherwise(text)
    return blank_to_null(text)


def approx_tokens(c: Column) -> Column:
    """A token for each 4 characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def snippet(c: Column, width: int) -> Column:
    """White space collapsed; cut to ``width`` characters with an ellipsis."""
    flat = strip(F.regexp_replace(c, rf"(?U){_WS}+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 1), F.lit("…"))).otherwise(flat)

"""Deterministic identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import strip

#: Namespace of our point ids.
NAMESPACE = "6f1c2d0e4b7a5d8f9a3e1b2c3d4e5f60"


def stem(c: Column) -> Column:
    """Last path component without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(c, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]+$", "")


def document_id(file_name: Column, url: Column) -> Column:
    base = F.when(strip(F.coalesce(file_name, F.lit(""))) != "", strip(file_name)).otherwise(strip(url))
    return F.concat(stem(base), F.lit("__"), F.substring(F.sha1(url), 1, 10))


def chunk_id(doc_id: Column, index: Column, raw_text: Column) -> Column:
    """Of a chunk's first, uncleaned piece; the index is padded to 4 digits and never cut."""
    seed = F.concat_ws("|", doc_id, index.cast("string"), F.substring(raw_text, 1, 200))
    return F.concat_ws("::", doc_id, F.format_string("%04d", index), F.substring(F.sha1(seed), 1, 16))


def point_id(name: Column, namespace: str = NAMESPACE) -> Column:
    """Name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

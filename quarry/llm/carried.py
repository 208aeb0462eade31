"""Columns that operators carry along under names of their own, so that no name of theirs clashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def renamed(names: list[str]) -> list[Column]:
    """Columns c0, c1, ... for ``names``."""
    return [F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)]


def restored(names: list[str]) -> list[Column]:
    """The inverse of renamed()."""
    return [F.col(f"c{i}").alias(n) for i, n in enumerate(names)]

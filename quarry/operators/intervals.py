"""Joins of intervals in equi-joins: both sides are cut into bands of fitting heights.

An interval lies in bands of BASE * 2 ** level, level being the first whose band is as
high as the interval, so it touches few of them. Two intervals that meet do so in a
band of the larger of their levels; each side therefore stands also in the bands
of those higher levels that the other side has in the same group. Tall and flat
intervals thus meet without either being cut into many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Height of the lowest bands, and the highest level; coordinates beyond LIMIT meet nothing.
BASE, LEVELS, LIMIT = 4.0, 40, 1e12


def level(low: Column, high: Column) -> Column:
    return F.least(F.lit(LEVELS), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(high - low, F.lit(BASE)) / BASE)))).cast("int")


def _band(value: Column, at: Column) -> Column:
    return F.floor(value / (F.lit(BASE) * F.pow(F.lit(2.0), at))).cast("long")


def levels(rows: DataFrame, keys: list[str], name: str, low: str, high: str) -> DataFrame:
    """The levels that occur in each group, as an array of LEVELS + 1 entries at most."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(level(F.col(low), F.col(high)))).alias(name))


def finite(*values: str) -> Column:
    """Not null, no NaN, and within the limit."""
    out = F.lit(True)
    for v in values:
        out &= F.coalesce(~F.isnan(v) & (F.abs(v) < LIMIT), F.lit(False))
    return out


def banded(rows: DataFrame, others: Column, prefix: str, low: str, high: str) -> DataFrame:
    """``rows`` once for each band that they stand in: _l (level), _b (band), and {prefix}_own and {prefix}_first of the interval.

    ``others`` are the levels of the other side.
    """
    own = level(F.col(low), F.col(high))
    at = rows.withColumn(f"{prefix}_own", own).withColumn("_l", F.explode(F.array_union(F.array(F.col(f"{prefix}_own")), F.filter(others, lambda x: x > F.col(f"{prefix}_own")))))
    first = _band(F.col(low), F.col("_l"))
    return at.withColumn(f"{prefix}_first", first).withColumn("_b", F.explode(F.sequence(F.col(f"{prefix}_first"), _band(F.col(high), F.col("_l")))))


def once(left: str, right: str) -> Column:
    """Of the bands in which two intervals stand together, the one that counts."""
    return (F.col("_l") == F.greatest(f"{left}_own", f"{right}_own")) & (F.col("_b") == F.greatest(f"{left}_first", f"{right}_first"))

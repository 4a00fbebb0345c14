"""Sets of non-negative integers as a column of values, and range questions about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains_range(x: Column, start: int, end: int) -> Column:
    """Aggregate: whether all of [start, end) are in the set. An empty range is."""
    return F.count_distinct(F.when((x >= max(start, 0)) & (x < end), x)) == max(end - start, 0)


def intersects_range(x: Column, start: int, end: int) -> Column:
    """Aggregate: whether any of [start, end) is in the set. An empty range isn't."""
    return F.coalesce(F.bool_or((x >= max(start, 0)) & (x < end)), F.lit(False))


def min_value(x: Column) -> Column:
    """Aggregate: the least member, null if there is none."""
    return F.min(F.when(x >= 0, x))


def max_value(x: Column) -> Column:
    return F.max(F.when(x >= 0, x))


def members(df: DataFrame, x: Column) -> DataFrame:
    """(value) of the set that a column's non-negative integers make; order by it for random access."""
    return df.select(x.cast("long").alias("value")).filter(F.col("value") >= 0).distinct()


def span(df: DataFrame, start: int, end: int) -> DataFrame:
    """(value) of the set [start, end)."""
    return df.sparkSession.range(max(start, 0), max(end, start, 0)).select(F.col("id").alias("value"))

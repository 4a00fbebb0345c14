"""Sorts with explicit places for null and NaN, permutations, top-k and search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import sequences as S


def nan_last(x: Column) -> Column:
    """Numbers, then NaN, then null."""
    return x.asc_nulls_last()


def nan_first(x: Column) -> list[Column]:
    """Null and NaN, then numbers."""
    return [(~(x.isNull() | F.isnan(x.cast("double")))).asc(), x.asc_nulls_first()]


def descending(x: Column) -> Column:
    return x.desc_nulls_last()


def sort(df: DataFrame, x: Column, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(nan_last(x), *ties)


def sort_by(df: DataFrame, keys: Sequence[Column], ties: Sequence[str] = ()) -> DataFrame:
    """Sorted by the keys as given (asc or desc); stable by ``ties``."""
    return df.orderBy(*keys, *ties)


def argsort(df: DataFrame, order: Sequence[str], x: Column) -> DataFrame:
    """(_pos, _index): the i-th smallest value stands at _index."""
    at = S.with_pos(df.withColumn("_x", x), order, "_index")
    return S.with_pos(at, [nan_last(F.col("_x")), F.col("_index")]).select(S.POS, "_index")


def binary_search(x: Column, value: Column) -> Column:
    """Aggregate over sorted values: the index of the first that is not less, so the insertion point."""
    return F.count_if(x < value)


def take_min(df: DataFrame, n: int, keys: Sequence[Column | str]) -> DataFrame:
    """The n smallest rows, by a bounded heap in each task."""
    return df.orderBy(*keys).limit(n)


def drop_min(df: DataFrame, n: int, keys: Sequence[Column | str]) -> DataFrame:
    return S.drop(df, keys, n)


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    return df.orderBy(F.rand(seed))

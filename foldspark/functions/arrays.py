"""The sequence operators on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def nth(a: Column, i: int) -> Column:
    """Element i; a negative one counts from the end; null outside."""
    return F.try_element_at(a, F.lit(i + 1 if i >= 0 else i))


def take(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.least(F.lit(max(n, 0)), F.size(a)))


def drop(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(max(n, 0) + 1), F.greatest(F.size(a) - max(n, 0), F.lit(0)))


def take_last(a: Column, n: int) -> Column:
    return drop_to(a, F.size(a) - max(n, 0))


def drop_to(a: Column, n: Column) -> Column:
    at = F.greatest(n, F.lit(0))
    return F.slice(a, at + 1, F.greatest(F.size(a) - at, F.lit(0)))


def drop_last(a: Column, n: int) -> Column:
    return F.slice(a, F.lit(1), F.greatest(F.size(a) - max(n, 0), F.lit(0)))


def subvec(a: Column, start: int, end: int) -> Column:
    return F.slice(a, F.lit(start + 1), F.lit(end - start))


def splice(a: Column, at: int, b: Column) -> Column:
    """``b`` inserted into ``a`` at index ``at``."""
    return F.concat(take(a, at), b, drop(a, at))


def add_constant(a: Column, at: int, count: int, value: Column) -> Column:
    return splice(a, at, F.array_repeat(value, count))


def reindex(a: Column, indexes: Column) -> Column:
    return F.transform(indexes, lambda i: F.get(a, i))


def shift(a: Column, n: int) -> Column:
    """Element i is a[i - n]; the ends repeat."""
    last = F.size(a) - 1
    return F.transform(a, lambda x, i: F.get(a, F.least(F.greatest(i - n, F.lit(0)), last)))


def map_indexed(a: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(index, value) of each element."""
    return F.transform(a, lambda x, i: f(i, x))


def every(a: Column, p: Callable[[Column], Column]) -> Column:
    return F.forall(a, lambda x: F.coalesce(p(x), F.lit(False)))


def keys(m: Column) -> Column:
    return F.map_keys(m)


def vals(m: Column) -> Column:
    return F.map_values(m)


def update_values(m: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(key, value) of each entry; a null result removes the entry."""
    return F.map_filter(F.transform_values(m, f), lambda k, v: v.isNotNull())

"""Maps and sets as keyed frames. Null is a key like others."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Both = Callable[[Column, Column], Column]


def keyed(df: DataFrame, key: Column, value: Column, pos: Column | None = None) -> DataFrame:
    """A map (k, v) of a frame's rows; of equal keys the row of the largest ``pos`` wins."""
    d = df.select(key.alias("k"), value.alias("v"), (F.lit(0) if pos is None else pos).alias("_p"))
    return d.select("k", "v") if pos is None else d.groupBy("k").agg(F.max_by("v", "_p").alias("v"))


def _joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    left = a.select(F.col("k").alias("_k1"), F.col("v").alias("_v1"), F.lit(True).alias("_in1"))
    right = b.select(F.col("k").alias("_k2"), F.col("v").alias("_v2"), F.lit(True).alias("_in2"))
    return left.join(right, F.col("_k1").eqNullSafe(F.col("_k2")), how)


def union(a: DataFrame, b: DataFrame, f: Both) -> DataFrame:
    """All keys; f(v of a, v of b) where both have one."""
    both = F.col("_in1").isNotNull() & F.col("_in2").isNotNull()
    key = F.when(F.col("_in1").isNotNull(), F.col("_k1")).otherwise(F.col("_k2"))
    value = F.when(both, f(F.col("_v1"), F.col("_v2"))).when(F.col("_in1").isNotNull(), F.col("_v1")).otherwise(F.col("_v2"))
    return _joined(a, b, "full_outer").select(key.alias("k"), value.alias("v"))


def intersection(a: DataFrame, b: DataFrame, f: Both = lambda x, y: y) -> DataFrame:
    """The keys of both with f of the values; a null value is a value."""
    return _joined(a, b, "inner").select(F.col("_k1").alias("k"), f(F.col("_v1"), F.col("_v2")).alias("v"))


def _without_or_with(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    keys = b.select(F.col("k").alias("_k2"))
    return a.join(keys, F.col("k").eqNullSafe(F.col("_k2")), how)


def difference(a: DataFrame, b: DataFrame | None) -> DataFrame:
    """``a`` without the keys of ``b``."""
    return a if b is None else _without_or_with(a, b, "left_anti")


def trimmed(a: DataFrame, keys: DataFrame) -> DataFrame:
    """``a`` with only the keys of a set."""
    return _without_or_with(a, keys, "left_semi")


def _stacked(maps: Sequence[DataFrame | None]) -> DataFrame:
    return reduce(DataFrame.unionByName, (m.select("k", "v", F.lit(i).alias("_src")) for i, m in enumerate(maps) if m is not None))


def merge(*maps: DataFrame | None) -> DataFrame:
    """All keys; the last map that has a key gives its value."""
    return _stacked(maps).groupBy("k").agg(F.max_by("v", "_src").alias("v"))


def merge_with(aggregate: Callable[[str], Column], *maps: DataFrame | None) -> DataFrame:
    """All keys; the values of a key go through an aggregate (F.sum, F.max, ...)."""
    return _stacked(maps).groupBy("k").agg(aggregate("v").alias("v"))


def update_values(m: DataFrame, f: Both) -> DataFrame:
    """f(key, value) as the values; a null result removes the key."""
    return m.withColumn("v", f(F.col("k"), F.col("v"))).filter(F.col("v").isNotNull())


def mapmap(m: DataFrame, key: Column, value: Column, pos: Column, keep: Column | None = None) -> DataFrame:
    """New entries from old ones; where ``keep`` is false there is none; the later of equal keys wins."""
    return keyed(m if keep is None else m.filter(keep), key, value, pos)


def invert(m: DataFrame) -> DataFrame:
    """Values as keys; of equal values the largest key stays."""
    return keyed(m, F.col("v"), F.col("k"), F.col("k"))


def upsert(m: DataFrame, changes: DataFrame, f: Both) -> DataFrame:
    """f(old or null, change) for the keys of ``changes``; a null result removes the key."""
    j = _joined(m, changes, "full_outer")
    value = F.when(F.col("_in2").isNotNull(), f(F.col("_v1"), F.col("_v2"))).otherwise(F.col("_v1"))
    key = F.when(F.col("_in1").isNotNull(), F.col("_k1")).otherwise(F.col("_k2"))
    out = j.select(key.alias("k"), value.alias("v"), F.col("_in2").isNotNull().alias("_new"))
    return out.filter(~(F.col("_new") & F.col("v").isNull())).drop("_new")


def set_union(*sets: DataFrame) -> DataFrame:
    return reduce(DataFrame.union, sets).distinct()


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def set_xor(a: DataFrame, b: DataFrame) -> DataFrame:
    """What one of both sets has, by one shuffle."""
    return a.distinct().union(b.distinct()).groupBy(*a.columns).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")


def intersect_sets(*sets: DataFrame) -> DataFrame:
    """What all sets have, by one shuffle for any number of sets."""
    union = reduce(DataFrame.union, (s.distinct() for s in sets))
    return union.groupBy(*union.columns).agg(F.count("*").alias("_n")).filter(F.col("_n") == len(sets)).drop("_n")


def cartesian(*frames: DataFrame) -> DataFrame:
    """All combinations of rows of the frames: the one operator whose meaning is a product."""
    return reduce(DataFrame.crossJoin, frames)


def compute_if_present(m: DataFrame, changes: DataFrame, f: Both) -> DataFrame:
    """f(old, change) for the keys that both have; a null result removes the key."""
    return upsert(m, trimmed(changes, m), f)


def compute_if_absent(m: DataFrame, fresh: DataFrame) -> DataFrame:
    """``m`` with the entries of ``fresh`` whose keys it lacks."""
    return m.select("k", "v").unionByName(difference(fresh.select("k", "v"), m))


def with_membership(df: DataFrame, x: Column, members: DataFrame, name: str = "member") -> DataFrame:
    """``df`` with whether ``x`` is in the set (a frame of one column); null may be a member."""
    held = members.select(F.col(members.columns[0]).alias("_m")).distinct().withColumn("_has", F.lit(True))
    return df.join(held, x.eqNullSafe(F.col("_m")), "left").withColumn(name, F.coalesce("_has", F.lit(False))).drop("_m", "_has")

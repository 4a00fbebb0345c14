"""Checked numeric casts: rules for null, NaN and booleans that differ from Spark's own casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cast_double(x: Column) -> Column:
    """Null is NaN; booleans are 1 and 0."""
    return F.coalesce(x.cast("double"), F.lit(float("nan")))


def cast_long(x: Column) -> Column:
    """Truncates; null, NaN and infinities raise an error (the latter two by ANSI casts)."""
    return F.when(x.isNull(), F.raise_error(F.lit("cannot cast null to long"))).otherwise(x.cast("long"))


def cast_bool(x: Column, numeric: bool = True) -> Column:
    """Null, NaN, 0 and false are false, all else is true."""
    if not numeric:
        return F.coalesce(x, F.lit(False))
    d = x.cast("double")
    return F.coalesce(F.when(F.isnan(d), False).otherwise(d != 0), F.lit(False))


def complement(p: Column) -> Column:
    """Logical not, with null as false."""
    return ~F.coalesce(p, F.lit(False))


def double_eq(a: Column, b: Column) -> Column:
    """Equality of numbers or lists of them, in which NaN equals NaN."""
    return a == b


def without_nan(x: Column, strategy: str = "remove") -> Column:
    """``x`` as an aggregate's input: NaN and null removed, kept (null is NaN then), or an error."""
    d = cast_double(x)
    if strategy == "remove":
        return F.when(~F.isnan(d), d)
    if strategy == "keep":
        return d
    if strategy == "exception":
        return F.when(F.isnan(d), F.raise_error(F.lit("NaN in the input"))).otherwise(d)
    raise ValueError(f"no NaN strategy {strategy!r}")


def re_matches(x: Column, pattern: str, group: int = 0) -> Column:
    """The group of a match of the whole string; null if it doesn't match."""
    whole = f"^(?:{pattern})$"
    return F.when(x.rlike(whole), F.regexp_extract(x, f"^({pattern})$" if group == 0 else whole, 1 if group == 0 else group))


#: Dtype names and their Spark types; each falls into one of three spaces.
DTYPES = {"int8": "tinyint", "int16": "smallint", "int32": "int", "int64": "bigint", "float32": "float", "float64": "double", "boolean": "boolean", "char": "string", "string": "string"}


def space_of(dtype: str) -> str:
    """int64, float64 or object."""
    return "int64" if dtype.startswith(("int", "uint")) else "float64" if dtype.startswith("float") else "object"

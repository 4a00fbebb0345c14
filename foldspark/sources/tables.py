"""Sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row (value) for each line of a text file."""
    return spark.read.text(path)


def numbers(spark: SparkSession, start: float, end: float, step: float = 1, ceil: bool = False, kind: str | None = None) -> DataFrame:
    """(_pos, value) of a range. Its length is (end - start) / step cut to an integer, or rounded up with ``ceil``."""
    n = max(0, int((end - start) / step))
    if ceil and start + n * step != end and (end - start) / step > 0:
        n += 1
    whole = all(isinstance(x, int) for x in (start, end, step))
    value = F.col("id") * F.lit(step) + F.lit(start)
    return spark.range(n).select(F.col("id").alias("_pos"), value.cast(kind or ("long" if whole else "double")).alias("value"))


def repeat(spark: SparkSession, n: int, value: Column) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("_pos"), value.alias("value"))


def repeatedly(spark: SparkSession, n: int, expression: Column) -> DataFrame:
    """n evaluations of an expression, anew each time the rows are read."""
    return repeat(spark, n, expression)


def entries(spark: SparkSession, data: dict | list, schema: str) -> DataFrame:
    """Rows of a map's entries or of a list of tuples."""
    return spark.createDataFrame(list(data.items()) if isinstance(data, dict) else data, schema)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def into(target: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of both, by column name."""
    return target.unionByName(rows)


class _Part(InputPartition):
    def __init__(self, number: int) -> None:
        self.number = number


def iterable(spark: SparkSession, parts: Callable[[int], Iterator[tuple[Any, ...]]], n: int, schema: str) -> DataFrame:
    """Rows of re-creatable iterators, one for each of n partitions, made where they are read."""

    class Reader(DataSourceReader):
        def partitions(self) -> list[_Part]:
            return [_Part(i) for i in range(n)]

        def read(self, part: _Part) -> Iterator[tuple[Any, ...]]:
            yield from parts(part.number)

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return "foldspark_iterable"

        def schema(self) -> str:
            return schema

        def reader(self, schema) -> DataSourceReader:
            return Reader()

    spark.dataSource.register(Source)
    return spark.read.format("foldspark_iterable").load()


def piped(df: DataFrame, command: str) -> DataFrame:
    """The lines that a command writes when it reads the column ``value``, one process a partition."""
    return df.select("value").rdd.map(lambda r: r.value).pipe(command).map(lambda x: (x,)).toDF("value string")

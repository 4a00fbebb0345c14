"""Maps of Python functions over partitions, and options of execution."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Options:
    """Hints. None leaves the matter to Spark; ``ordered`` and ``unmerged`` are up to the caller's columns."""

    parallelism: int | None = None
    min_n: int = 1000
    max_batch_size: int | None = None
    ordered: bool = True
    unmerged: bool = False

    def applied(self, df: DataFrame) -> DataFrame:
        return df if self.parallelism is None else df.repartition(self.parallelism)


def pmap(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: str, options: Options = Options()) -> DataFrame:
    """f of each batch of rows; an error of f ends the query with its message."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            size = options.max_batch_size or len(batch) or 1
            for a in range(0, len(batch), size):
                yield f(batch.iloc[a : a + size])

    return options.applied(df).mapInPandas(run, schema)


def pgroups(spark: SparkSession, n: int, size: int, f: Callable[[int, int], float], kind: str = "double") -> DataFrame:
    """(group, value): f(start, end) of each index range of ``size`` below n, one result a range."""
    starts = spark.range(0, -(-n // size)).select(F.col("id").alias("group"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["value"] = [f(int(g) * size, min(n, int(g) * size + size)) for g in batch["group"]]
            yield batch

    return starts.mapInPandas(run, f"group long, value {kind}")


def in_task() -> bool:
    """Whether this code runs in a task: jobs cannot be started there."""
    return TaskContext.get() is not None


def consume(df: DataFrame, make: Callable[[], Callable[[object], None]]) -> None:
    """Each partition's rows into a consumer of its own; for side effects only."""

    def run(rows: Iterator[object]) -> None:
        accept = make()
        for row in rows:
            accept(row)

    df.foreachPartition(run)

"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm import _frames as D


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """The rows (id, component) of every id in ``links`` (a, b): component is the smallest id that it reaches.

    Each round joins the links with the smallest neighbour of each end; nothing
    is collected but two numbers that say whether a round changed anything.
    Nulls and loops are no links; an empty table gives an empty one.
    """
    D.has_checkpoint_dir(links.sparkSession)
    edges = links.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = D.saved(edges)
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(edges.filter("false")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = D.saved(small.filter("u <> v").distinct())
        row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if row == before:
            break
        before = row
    else:
        raise RuntimeError(f"the components didn't settle in {rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())

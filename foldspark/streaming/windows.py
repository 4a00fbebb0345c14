"""Single-pass sources as streams, with event time (an extension: the algebra itself has no time)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream(spark: SparkSession, folder: str, schema: StructType, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def windowed(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Count and sum by window and key; rows later than ``late`` are ignored, so the state is bounded."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), key, "n", "total")


def run_once(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Everything that is there, through the stream, as a table in memory; for tests and small results."""
    df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)

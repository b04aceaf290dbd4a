"""Streaming forms of the incremental operators (2.10): a design extension, the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["available_now", "dedupe_entries", "parquet_stream", "windowed_counts"]


def parquet_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 16) -> DataFrame:
    """Files of a folder as a stream, a bounded number per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def dedupe_entries(df: DataFrame, key: str, at: str, late: str = "30 days") -> DataFrame:
    """The first of all entries with the same key within the watermark; state is bounded by it."""
    return df.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(df: DataFrame, at: str, by: str, value: str, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows and sum per tumbling window and group."""
    w = F.window(at, size)
    return df.withWatermark(at, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def available_now(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Process all that has arrived and stop; a restart goes on where the checkpoint ends."""
    return df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

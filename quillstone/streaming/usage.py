"""Structured Streaming delivery of the usage counts: the same aggregates, kept up to date as the log grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def log_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_batch: int = 8) -> DataFrame:
    """New Parquet files of a folder, with the columns of a batch table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def hourly_usage(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counts by hour and type; an hour is final when the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def run_available(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Processes what there is, writes finished hours to Parquet, and ends; a restart goes on from the checkpoint."""
    return df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start()

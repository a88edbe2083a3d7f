"""Structured Streaming over event tables: tumbling and session windows, bounded-state de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A table of Parquet files as a stream, with ``ts`` as a timestamp, which watermarks need."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(like.schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_seconds("session_window.start").alias("started"), "n")


def deduplicated(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark, so that state is dropped as time goes on."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys).select(*keys, "event_id")

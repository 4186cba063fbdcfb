"""Extras beyond the reference: event-time windows with watermarks, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """start, event_type, n, total of event-time windows; ``late`` sets a watermark on streams."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """user_id, begin, end, n: runs of a user's events no further apart than ``gap``."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("begin"), F.col("session_window.end").alias("end"), "n")


def event_stream(spark: SparkSession, path: str, schema, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)

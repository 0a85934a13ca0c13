"""Structured Streaming over event folders: windows, sessions, latest rows, incremental work. Additive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, late: str = "1 hour", files_per_trigger: int = 64) -> DataFrame:
    """The stream of a folder's events. Its watermark is set here, once; the operators below build on it."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path).withWatermark("ts", late)


def distinct_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums per window and type, tumbling or sliding. Works on streams and on tables."""
    span = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n", "total")


def incremental(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str):
    """Run ``work`` on each batch of what is new, then stop; the checkpoint remembers what was done."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Streams: windowed counts of an event stream, and change application by micro-batches.

The dialect has no streams of its own; these are the same operators on unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of parquet files as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, time: str, late: str, width: str, *keys: str, slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` in tumbling or sliding windows; rows later than ``late`` are dropped
    by the watermark."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    grouped = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("s"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "s")


def sessions(events: DataFrame, time: str, late: str, gap: str, *keys: str) -> DataFrame:
    """Session windows that end after ``gap`` without an event."""
    grouped = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")

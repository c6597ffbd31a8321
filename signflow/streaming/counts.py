"""Counts over a stream of events: windows with late data, as an extension of the batch counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under ``path``."""
    return spark.readStream.schema("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """start, event_type, n: tumbling windows; rows later than the watermark are dropped. Works on batches and streams alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """user_id, start, n: sessions of a user's events that follow each other within ``gap``."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")

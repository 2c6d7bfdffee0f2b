"""Structured-streaming forms of the event analytics."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, at: str, kind: str, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events by window and kind; on a stream, rows later than ``late`` are dropped."""
    x = events.withColumn(at, F.col(at).cast("timestamp"))
    x = x.withWatermark(at, late) if x.isStreaming else x
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return x.groupBy(w.alias("w"), kind).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, at: str, key: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs of a key's events no more than ``gap`` apart."""
    x = events.withColumn(at, F.col(at).cast("timestamp"))
    x = x.withWatermark(at, late) if x.isStreaming else x
    return x.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), "n")

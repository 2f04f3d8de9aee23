"""Event streams: a windowed report with late data, as a stream and over a table. No register operator needs this."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly_totals(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and their sum by hour and type. Over a stream, rows later than ``late`` are dropped and their state too."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    out = events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def new_records(stream: DataFrame, key: str, time: str = "ts", late: str = "1 day") -> DataFrame:
    """The first record of each key within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])

"""Streaming products over observation events (station, ts, pollutant, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skysieve.functions.aqi import clean, compute_aqi


def daily_index(events: DataFrame, pollutants: tuple[str, ...], *, late: str = "6 hours", window: str = "1 day") -> DataFrame:
    """Index by station and day: one watermarked window aggregation, then a projection. Late rows beyond the watermark are not counted."""
    w = F.window("ts", window)
    avg = [F.avg(F.when(F.col("pollutant") == p, clean(F.col("value")))).alias(p) for p in pollutants]
    daily = events.withWatermark("ts", late).groupBy("station", w).agg(*avg)
    return compute_aqi(daily.withColumn("day", F.to_date("window.start")).drop("window"))


def hourly_means(events: DataFrame, *, late: str = "2 hours", slide: str = "1 hour", window: str = "8 hours") -> DataFrame:
    """Sliding means, the streaming counterpart of the 8-hour product."""
    w = F.window("ts", window, slide)
    return events.withWatermark("ts", late).groupBy("station", "pollutant", w).agg(F.avg(clean(F.col("value"))).alias("mean"), F.count("value").alias("n"))


def to_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet, exactly once by the file sink's log; runs over what is there and stops."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()

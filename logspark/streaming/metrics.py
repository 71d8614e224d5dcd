"""Counter increases over sliding event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_increase(
    events: DataFrame, time: str, keys: list[str], sums: dict[str, Column], window: str, step: str, lateness: str
) -> DataFrame:
    """``keys, window_start, window_end`` and the sums; rows later than ``lateness`` are dropped in append mode."""
    grouped = events.withWatermark(time, lateness).groupBy(*keys, F.window(time, window, step))
    return grouped.agg(*[F.sum(e).alias(n) for n, e in sums.items()]).select(
        *keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *sums
    )

"""Structured Streaming: running positions per target. An extension; medians and clusters are not kept incrementally."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import weighted


def windowed_positions(estimates: DataFrame, time: str = "ts", window: str = "1 minute", watermark: str = "2 minutes", least_confidence: float = 0.4) -> DataFrame:
    """Weighted mean of every target in tumbling event-time windows; rows later than the watermark are dropped.

    Works on streaming and static DataFrames. State is four numbers for each open (window, target).
    """
    valid = estimates.where((F.col("confidence") > F.lit(least_confidence)) & F.col("est_lat").isNotNull())
    return (
        valid.withWatermark(time, watermark).groupBy(F.window(time, window), "flag_id")
        .agg(weighted("est_lat").alias("lat"), weighted("est_lon").alias("lon"), F.count("*").alias("n_frames"))
        .select(F.col("window.start").alias("window_start"), "flag_id", "lat", "lon", "n_frames")
    )

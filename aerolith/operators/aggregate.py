"""Grouped aggregation of per-frame estimates into positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import M_PER_DEG
from .quantile import quantiles


def _valid(df: DataFrame) -> DataFrame:
    return df.where(F.col("est_lat").isNotNull() & F.col("est_lon").isNotNull())


def weighted(x: str, w: str = "confidence") -> Column:
    """Weighted mean; null where the weights sum to 0."""
    return F.sum(F.col(w) * F.col(x)) / F.nullif(F.sum(w), F.lit(0.0))


def median_position(df: DataFrame, by: list[str], least_frames: int = 1, counted: DataFrame | None = None, at_most: int | None = None) -> DataFrame:
    """Exact median of each axis on its own; groups with fewer estimates have no row. For ``counted`` and ``at_most`` see :func:`quantiles`."""
    found = quantiles(_valid(df), by, {"lat": "est_lat", "lon": "est_lon"}, counted=counted, at_most=at_most)
    return found.withColumnRenamed("n", "n_frames").where(F.col("n_frames") >= least_frames).select(*by, "lat", "lon", "n_frames")


def weighted_position(df: DataFrame, by: list[str], least_confidence: float = 0.4, least_frames: int = 10) -> DataFrame:
    """Confidence-weighted mean over estimates strictly above ``least_confidence``; partial sums combine map-side."""
    return (
        _valid(df).where(F.col("confidence") > F.lit(least_confidence)).groupBy(*by)
        .agg(weighted("est_lat").alias("lat"), weighted("est_lon").alias("lon"), F.count("*").alias("n_frames"), F.avg("confidence").alias("mean_confidence"))
        .where(F.col("n_frames") >= least_frames)
    )


def count_and_confidence(df: DataFrame, by: list[str]) -> DataFrame:
    """Estimates of any confidence, and their mean confidence."""
    return _valid(df).groupBy(*by).agg(F.count("*").alias("n_frames"), F.avg("confidence").alias("mean_confidence"))


def first_frames(df: DataFrame, by: list[str], n: int, order: str = "frame_idx") -> DataFrame:
    """The first ``n`` rows of every group. Spark's group limit cuts each map task to n rows a group before the shuffle."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def prefix_medians(df: DataFrame, by: list[str], most: int = 30, order: str = "frame_idx") -> DataFrame:
    """For n = 1 to ``most`` the medians of a group's first n estimates, as columns ``n, lat, lon``."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = _valid(df).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select(*by, "n", F.percentile("est_lat", F.lit(0.5)).over(upto).alias("lat"), F.percentile("est_lon", F.lit(0.5)).over(upto).alias("lon"))


def local_metres(df: DataFrame, by: list[str], lat: str = "est_lat", lon: str = "est_lon") -> DataFrame:
    """Add ``x_m, y_m``: metres east and north of the group's mean position.

    The means are a partial aggregate joined back, not a window, so a hot group is not one task.
    """
    mean = df.groupBy(*by).agg(F.avg(lat).alias("_lat0"), F.avg(lon).alias("_lon0"))
    return df.join(mean, by).withColumns({
        "y_m": (F.col(lat) - F.col("_lat0")) * F.lit(M_PER_DEG),
        "x_m": (F.col(lon) - F.col("_lon0")) * F.lit(M_PER_DEG) * F.cos(F.radians(F.col("_lat0"))),
    }).drop("_lat0", "_lon0")

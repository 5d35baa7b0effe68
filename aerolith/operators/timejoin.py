"""Time joins of frames and telemetry: exact, nearest, interpolating. One sort, no cross product, no hot partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINEAR = ("lat", "lon", "alt_m", "roll_deg", "pitch_deg", "yaw_deg")


def exact_join(frames: DataFrame, telemetry: DataFrame, on: list[str], need: tuple = ()) -> DataFrame:
    """Frames with telemetry of the same key and all ``need`` fields; others go."""
    for c in need:
        telemetry = telemetry.where(F.col(c).isNotNull())
    return frames.join(telemetry, on)


def neighbours(frames: DataFrame, telemetry: DataFrame, by: str = "flight_id", time: str = "t_ms", bucket_ms: float = 60_000.0) -> DataFrame:
    """Frames with structs ``prev`` (last sample at or before) and ``next`` (first at or after); null where none.

    Rows meet inside (``by``, time bucket), so a flight that holds most rows is still many tasks. A bucket's
    first and last samples, one row per bucket, are carried over empty stretches by a window over those few rows.
    Of samples with one time the first in order of all fields serves an exact hit and any earlier frame,
    the last a later frame.
    """
    fields = [c for c in telemetry.columns if c not in (by,)]
    sample = F.struct(F.col(time).alias(time), *[F.col(c) for c in fields if c != time])
    bucket = F.floor(F.col(time) / F.lit(bucket_ms))
    f = frames.select(by, time, F.struct(*[c for c in frames.columns]).alias("frame"), F.lit(None).cast(telemetry.select(sample.alias("s")).schema["s"].dataType).alias("sample"))
    s = telemetry.select(by, time, F.lit(None).cast(frames.select(F.struct(*frames.columns).alias("f")).schema["f"].dataType).alias("frame"), sample.alias("sample"))
    both = f.unionByName(s).withColumn("_bucket", bucket)
    tie = F.col("frame").isNotNull().cast("int")
    w = Window.partitionBy(by, "_bucket").orderBy(time, tie.desc(), "sample")  # a frame comes before samples of its time
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    behind = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumns({"_next": F.first("sample", ignorenulls=True).over(ahead), "_prev": F.last("sample", ignorenulls=True).over(behind)}).where("frame is not null")
    edges = both.groupBy(by, "_bucket").agg(F.min("sample").alias("_low"), F.max("sample").alias("_high"))
    over = Window.partitionBy(by).orderBy("_bucket")
    edges = edges.withColumns({
        "_before": F.last("_high", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)),
        "_after": F.first("_low", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)),
    }).select(by, "_bucket", "_before", "_after")
    nxt = F.coalesce("_next", "_after")
    exact = nxt[time] == F.col(time)
    return inside.join(edges, [by, "_bucket"]).select(
        "frame.*", F.when(exact, nxt).otherwise(F.coalesce("_prev", "_before")).alias("prev"), nxt.alias("next"),
    )


def nearest_join(frames: DataFrame, telemetry: DataFrame, by: str = "flight_id", time: str = "t_ms", **more) -> DataFrame:
    """The sample nearest in time, the earlier one on a tie; frames of flights without samples go."""
    near = neighbours(frames, telemetry, by, time, **more)
    back, ahead = F.col(time) - F.col(f"prev.{time}"), F.col(f"next.{time}") - F.col(time)
    pick = F.when(F.col("next").isNull() | (back <= ahead), F.col("prev")).otherwise(F.col("next"))
    pick = F.when(F.col("prev").isNull(), F.col("next")).otherwise(pick)
    out = near.withColumn("_s", pick).where("_s is not null")
    rest = [c for c in telemetry.columns if c not in (by, time)]
    return out.select(*frames.columns, F.col(f"_s.{time}").alias("sample_ms"), *[F.col(f"_s.{c}").alias(c) for c in rest])


def _between(a: Column, b: Column, share: Column) -> Column:
    return a + share * (b - a)


def interpolating_join(
    frames: DataFrame, telemetry: DataFrame, by: str = "flight_id", time: str = "t_ms", columns: tuple = LINEAR,
    gap_ms: float | None = None, wrap: tuple = (), **more,
) -> DataFrame:
    """Linear interpolation between the samples around a frame, clamped at a flight's ends.

    Angles are interpolated as they are, as numbers; those named in ``wrap`` along the shorter arc, into
    [0, 360). With ``gap_ms``, frames whose two samples are further apart go. Flights without samples go.
    """
    near = neighbours(frames, telemetry, by, time, **more).where("prev is not null or next is not null")
    t0, t1 = F.col(f"prev.{time}"), F.col(f"next.{time}")
    if gap_ms is not None:
        near = near.where(t0.isNull() | t1.isNull() | (t1 - t0 <= F.lit(gap_ms)))
    near = near.withColumn("_share", F.when(t1 > t0, (F.col(time) - t0) / (t1 - t0)).otherwise(F.lit(0.0)))
    out = []
    for c in columns:
        a, b = F.col(f"prev.{c}"), F.col(f"next.{c}")
        v = _between(a, b, F.col("_share"))
        if c in wrap:
            arc = F.pmod(b - a + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)
            v = F.pmod(a + F.col("_share") * arc, F.lit(360.0))
        out.append(F.when(t0.isNull(), b).when(t1.isNull(), a).otherwise(v).alias(c))
    return near.select(*frames.columns, *out)


def last_known(df: DataFrame, by: str, order: str, values: dict[str, Column], bucket: float, before_row: bool = False) -> DataFrame:
    """Add each of ``values`` as it last was (not null) at or before a row, or before it, in ``order`` inside ``by``.

    Rows meet inside (``by``, bucket of ``order``), so a flight that holds most rows is still many tasks; what a bucket
    leaves is carried over by a window over one row a bucket. ``order`` is a number, unique in its ``by``.
    """
    named = df.withColumns({f"_v_{n}": c for n, c in values.items()}).withColumn("_bucket", F.floor(F.col(order) / F.lit(bucket)))
    w = Window.partitionBy(by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if before_row else 0)
    inside = named.withColumns({f"_i_{n}": F.last(f"_v_{n}", ignorenulls=True).over(w) for n in values})
    left = named.groupBy(by, "_bucket").agg(*[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}") for n in values])
    over = Window.partitionBy(by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    left = left.select(by, "_bucket", *[F.last(f"_e_{n}", ignorenulls=True).over(over).alias(f"_o_{n}") for n in values])
    joined = inside.join(left, [by, "_bucket"])
    return joined.select(*df.columns, *[F.coalesce(f"_i_{n}", f"_o_{n}").alias(n) for n in values])

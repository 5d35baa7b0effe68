"""From pixels and attitude to ground positions, one projection chain per frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.lens import undistort
from ..schemas import FIELD_CAMERA, FRAME_HEIGHT, FRAME_WIDTH, M_PER_DEG, NED, Camera, Convention


def localize(df: DataFrame, cam: Camera = FIELD_CAMERA, how: Convention = NED, steps: int = 5) -> DataFrame:
    """Add ``est_lat, est_lon`` to detections; both are null where the ray fails the guard.

    Reads ``u, v, altitude, lat_uav, lon_uav`` and ``roll_deg, pitch_deg, yaw_deg`` (missing angles count 0).
    Undistort, turn the ray by mount and attitude, meet the ground plane, offset the aircraft's position.
    """
    u, v = F.col("u"), F.col("v")
    if how.single_precision_pixel:
        u, v = u.cast("float").cast("double"), v.cast("float").cast("double")
    xd, yd = geo.pixel_to_ray(u, v, cam)
    df = undistort(df.withColumns({"_xd": xd, "_yd": yd}), "_xd", "_yd", cam, ("_xn", "_yn"), steps)
    angle = lambda c: F.radians(F.coalesce(F.col(c), F.lit(0.0)))
    yaw = F.radians(F.coalesce(F.col("yaw_deg"), F.lit(0.0)) + F.lit(how.declination_deg)) if how.declination_deg else angle("yaw_deg")
    df = df.withColumns({"_roll": angle("roll_deg"), "_pitch": angle("pitch_deg"), "_yaw": yaw})
    ray = (F.col("_xn"), F.col("_yn"), F.lit(1.0))
    r = geo.rotation(F.col("_roll"), F.col("_pitch"), F.col("_yaw"))
    df = df.withColumns({f"_b{i}": geo.linear(how.mount[i], ray) for i in range(3)} | {f"_{k}": c for k, c in r.items()})
    df = df.withColumns({f"_w{i}": F.col(f"_r{i}0") * F.col("_b0") + F.col(f"_r{i}1") * F.col("_b1") + F.col(f"_r{i}2") * F.col("_b2") for i in range(3)})
    ok = (F.col("_w2") if how.signed else F.abs("_w2")) >= F.lit(how.guard)
    t = F.col("altitude") / F.col("_w2")
    first, second = t * F.col("_w0"), t * F.col("_w1")
    north, east = (first, second) if how.north_first else (second, first)
    lat, lon = geo.offset_to_geodetic(F.col("lat_uav"), F.col("lon_uav"), north, east, how.lon_scale)
    return _settled(df, {"est_lat": F.when(ok, lat), "est_lon": F.when(ok, lon)})


def _settled(df: DataFrame, made: dict) -> DataFrame:
    """Keep the columns of ``df`` without its helpers, and add ``made`` as the output of a one-row generator.

    A filter on a projected column is rewritten in terms of the column's inputs, step by step, which grows
    exponentially over a chain of lens steps. A generator's output stops that rewriting, and other filters
    still go through to the scan; the generator is part of the codegen stage.
    """
    kept = [c for c in df.columns if not c.startswith("_")]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))))


def localize_nadir(df: DataFrame, cam: Camera = FIELD_CAMERA, m_per_deg: float = M_PER_DEG) -> DataFrame:
    """Baseline that takes the camera as looking straight down with north up; adds ``est_lat, est_lon``."""
    x, y = geo.pixel_to_ray(F.col("u"), F.col("v"), cam)
    lat, lon = geo.offset_to_geodetic(F.col("lat_uav"), F.col("lon_uav"), -y * F.col("altitude"), x * F.col("altitude"), None, m_per_deg)
    return df.withColumns({"est_lat": lat, "est_lon": lon})


def project_to_image(df: DataFrame, north: str, east: str, cam: Camera = FIELD_CAMERA, how: Convention = NED) -> DataFrame:
    """The inverse: pixel ``u, v`` of a ground offset; null behind the camera. No lens distortion is applied."""
    r = geo.rotation(*(F.radians(F.coalesce(F.col(c), F.lit(0.0))) for c in ("roll_deg", "pitch_deg", "yaw_deg")))
    df = df.withColumns({f"_{k}": c for k, c in r.items()})
    n, e, d = F.col(north), F.col(east), F.col("altitude")
    body = [F.col(f"_r0{i}") * n + F.col(f"_r1{i}") * e + F.col(f"_r2{i}") * d for i in range(3)]
    df = df.withColumns({f"_k{i}": b for i, b in enumerate(body)})
    back = [geo.linear([how.mount[k][i] for k in range(3)], [F.col(f"_k{k}") for k in range(3)]) for i in range(3)]
    df = df.withColumns({f"_c{i}": b for i, b in enumerate(back)})
    seen = (d > 0) & (F.col("_c2") > 0)
    df = df.withColumns({
        "u": F.when(seen, F.col("_c0") / F.col("_c2") * F.lit(cam.fx) + F.lit(cam.cx)),
        "v": F.when(seen, F.col("_c1") / F.col("_c2") * F.lit(cam.fy) + F.lit(cam.cy)),
    })
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def in_frame(df: DataFrame, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> DataFrame:
    return df.where((F.col("u") >= 0) & (F.col("u") < width) & (F.col("v") >= 0) & (F.col("v") < height))


def central_crop(df: DataFrame, share: float = 0.65, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> DataFrame:
    """Detections in the central ``share`` of the frame's width and height."""
    near = lambda c, size: F.abs(F.col(c) - F.lit(size / 2)) <= F.lit(size * share / 2)
    return df.where(near("u", width) & near("v", height))


def every_nth_frame(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("frame_idx") % n == 0)


def confident(df: DataFrame, least: float = 0.4, strict: bool = False) -> DataFrame:
    """By confidence: above ``least`` (strict) or from it on; the inclusive form takes a missing value as 1."""
    if strict:
        return df.where(F.col("confidence") > F.lit(least))
    return df.where(F.coalesce(F.col("confidence"), F.lit(1.0)) >= F.lit(least))


def detector_for(df: DataFrame, above_m: float = 90.0) -> DataFrame:
    """Tiled detection strictly above a height, plain detection else."""
    return df.withColumn("detector", F.when(F.col("altitude") > F.lit(above_m), "tiled").otherwise("plain"))


def without_tilt(df: DataFrame) -> DataFrame:
    """Ablation: roll and pitch 0, heading kept."""
    return df.withColumns({"roll_deg": F.lit(0.0), "pitch_deg": F.lit(0.0)})

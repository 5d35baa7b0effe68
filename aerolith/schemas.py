"""Constants, camera parameters and schemas shared by all operators."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

# Fixed values that results depend on.
M_PER_DEG = 111320.0
M_PER_DEG_COARSE = 111000.0
EARTH_RADIUS_M = 6371000.0
DECLINATION_DEG = 4.0
FRAME_WIDTH, FRAME_HEIGHT = 1920, 1080
SIGNED_GUARD, ABS_GUARD, CALIBRATION_GUARD = 0.17, 0.1, 0.05
DBSCAN_EPS_M, DBSCAN_MIN_POINTS = 15.0, 3
SCORE_BINS = ((20.0, 15), (30.0, 12), (40.0, 9), (50.0, 6), (60.0, 3))
BIN_LABELS = ("< 20 m", "20–30 m", "30–40 m", "40–50 m", "50–60 m", "> 60 m")
MOUNT_NED = ((0, -1, 0), (1, 0, 0), (0, 0, 1))
MOUNT_SWAPPED = ((0, 1, 0), (1, 0, 0), (0, 0, 1))
TELEMETRY_ALIASES = {
    "time": "timestamp_ms", "timestamp": "timestamp_ms", "latitude": "lat", "longitude": "lon", "lng": "lon",
    "altitude": "alt_m", "alt": "alt_m", "altitude_m": "alt_m", "roll": "roll_deg", "pitch": "pitch_deg",
    "yaw": "yaw_deg", "azimuth": "yaw_deg", "heading": "yaw_deg",
}
TELEMETRY_REQUIRED = ("timestamp_ms", "lat", "lon", "alt_m", "roll_deg", "pitch_deg", "yaw_deg")


@dataclass(frozen=True)
class Camera:
    """Pinhole intrinsics in pixels and Brown-Conrady coefficients k1, k2, p1, p2, k3."""

    fx: float
    fy: float
    cx: float
    cy: float
    dist: tuple = (0.0, 0.0, 0.0, 0.0, 0.0)

    @property
    def coefficients(self) -> tuple:
        return tuple(float(x) for x in (*self.dist, 0.0, 0.0, 0.0, 0.0, 0.0)[:5])


IDEAL_CAMERA = Camera(1500.0, 1500.0, 960.0, 540.0)
FIELD_CAMERA = Camera(1452.7, 1453.1, 963.2, 541.8, (-0.022, 0.008, 0.0003, -0.0001, 0.0))
FIELD_CAMERA_FLAT = Camera(1452.7, 1453.1, 963.2, 541.8)


@dataclass(frozen=True)
class Convention:
    """How attitude, guard and offsets combine.

    ``ned`` is self-consistent: north from the first rotated component, signed guard, one longitude scale.
    ``swapped`` keeps the older order: east from the first component, magnitude guard, longitude scale by row,
    pixel rounded to single precision, magnetic heading corrected by the declination.
    """

    name: str = "ned"
    mount: tuple = MOUNT_NED
    guard: float = SIGNED_GUARD
    signed: bool = True
    north_first: bool = True
    lon_reference_deg: float | None = 30.05
    declination_deg: float = 0.0
    single_precision_pixel: bool = False

    @property
    def lon_scale(self) -> float | None:
        return None if self.lon_reference_deg is None else M_PER_DEG * math.cos(math.radians(self.lon_reference_deg))


NED = Convention()
SWAPPED = Convention("swapped", MOUNT_SWAPPED, ABS_GUARD, False, False, None, DECLINATION_DEG, True)

_D = T.DoubleType()
TELEMETRY = T.StructType([T.StructField(n, _D) for n in ("time_s", "lat_uav", "lon_uav", "alt_agl", "roll_deg", "pitch_deg", "yaw_deg")])
GROUND_TRUTH = T.StructType([T.StructField("name", T.StringType()), T.StructField("lat", _D), T.StructField("lon", _D)])
RESULT = T.StructType([
    T.StructField("flag_id", T.LongType()), T.StructField("lat", _D), T.StructField("lon", _D),
    T.StructField("n_frames", T.LongType()), T.StructField("mean_confidence", _D),
])

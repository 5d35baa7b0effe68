"""Scalar geometry as Column functions; everything stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BIN_LABELS, EARTH_RADIUS_M, M_PER_DEG, SCORE_BINS, Camera


def rounded(x: Column, digits: int) -> Column:
    """Half-up rounding by floor, which every engine computes alike on doubles."""
    scale = F.lit(10.0**digits)
    return F.floor(x * scale + F.lit(0.5)) / scale


def bbox_center(x1: Column, y1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, (y1 + y2) / 2


def pixel_to_ray(u: Column, v: Column, cam: Camera) -> tuple[Column, Column]:
    return (u - F.lit(cam.cx)) / F.lit(cam.fx), (v - F.lit(cam.cy)) / F.lit(cam.fy)


def rotation(roll: Column, pitch: Column, yaw: Column) -> dict[str, Column]:
    """Nine elements of yaw * pitch * roll from angles in radians, in closed form."""
    sr, cr, sp, cp, sy, cy = F.sin(roll), F.cos(roll), F.sin(pitch), F.cos(pitch), F.sin(yaw), F.cos(yaw)
    return {
        "r00": cy * cp, "r01": cy * sp * sr - sy * cr, "r02": cy * sp * cr + sy * sr,
        "r10": sy * cp, "r11": sy * sp * sr + cy * cr, "r12": sy * sp * cr - cy * sr,
        "r20": -sp, "r21": cp * sr, "r22": cp * cr,
    }


def linear(row: Sequence[float], parts: Sequence[Column]) -> Column:
    """A literal matrix row times a vector, without its zero terms."""
    total = None
    for w, x in zip(row, parts):
        if w:
            term = x if w == 1 else -x if w == -1 else x * F.lit(float(w))
            total = term if total is None else total + term
    return F.lit(0.0) if total is None else total


def offset_to_geodetic(lat: Column, lon: Column, north: Column, east: Column, lon_scale: float | None, m_per_deg: float = M_PER_DEG) -> tuple[Column, Column]:
    """Flat-earth metres to degrees; without a fixed ``lon_scale`` the cosine of the row's latitude scales longitude."""
    scale = F.lit(lon_scale) if lon_scale is not None else F.lit(m_per_deg) * F.cos(F.radians(lat))
    return lat + north / F.lit(m_per_deg), lon + east / scale


def spherical_offset(lat: Column, north: Column, radius: float = 6378137.0) -> Column:
    """Latitude moved north on a sphere: metres over radius, in degrees."""
    return lat + F.degrees(north / F.lit(radius))


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    return a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, form: str = "asin") -> Column:
    """Great-circle metres; ``form`` is asin (canonical) or atan2."""
    h = _half_chord(lat1, lon1, lat2, lon2)
    if form == "atan2":
        return F.lit(2.0 * EARTH_RADIUS_M) * F.atan2(F.sqrt(h), F.sqrt(F.lit(1.0) - h))
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(h))


def planar_error(lat: Column, lon: Column, true_lat: Column, true_lon: Column) -> Column:
    n = (lat - true_lat) * F.lit(M_PER_DEG)
    e = (lon - true_lon) * F.lit(M_PER_DEG) * F.cos(F.radians(true_lat))
    return F.sqrt(n * n + e * e)


def course_over_ground(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Heading in radians from one fix to the next, clockwise from north, in (-pi, pi]."""
    north = (lat2 - lat1) * F.lit(M_PER_DEG)
    east = (lon2 - lon1) * F.lit(M_PER_DEG) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.atan2(east, north)


def true_heading(magnetic_deg: Column, declination_deg: float) -> Column:
    return magnetic_deg + F.lit(declination_deg)


def score(error_m: Column) -> Column:
    """Points of an error; edges are inclusive, a missing error scores 0."""
    out = F.lit(0)
    for edge, points in reversed(SCORE_BINS):
        out = F.when(error_m <= F.lit(edge), F.lit(points)).otherwise(out)
    return out


def bin_label(error_m: Column) -> Column:
    """The label of an error's bin; edges are inclusive, as in :func:`score`."""
    out = F.when(error_m.isNull(), F.lit("NOT DETECTED")).otherwise(F.lit(BIN_LABELS[-1]))
    for (edge, _), label in reversed(list(zip(SCORE_BINS, BIN_LABELS))):
        out = F.when(error_m <= F.lit(edge), F.lit(label)).otherwise(out)
    return out


def full_score(error_m: Column, identified: Column, bonus: Column) -> Column:
    """Location points, doubled for a bonus target, and 10 for identification (15 for a bonus target)."""
    return score(error_m) * F.when(bonus, 2).otherwise(1) + F.when(identified, F.when(bonus, 15).otherwise(10)).otherwise(0)


def pixels_per_metre(cam: Camera, height: Column) -> Column:
    return F.lit(cam.fx) / height


def ground_sample_distance(cam: Camera, height: Column) -> Column:
    return height / F.lit(cam.fx)


def footprint_half_width(cam: Camera, height: Column) -> Column:
    return F.lit(cam.cx) / F.lit(cam.fx) * height


def target_pixels(cam: Camera, height: Column, width_m: float) -> Column:
    return pixels_per_metre(cam, height) * F.lit(width_m)


def tilt_error(height: Column, tilt_deg: float) -> Column:
    return height * F.tan(F.radians(F.lit(tilt_deg)))


def expected_sigma(sigma_m: float, n: Column) -> Column:
    return F.lit(sigma_m) / F.sqrt(n)


def frame_time_ms(frame: Column, fps: float, start_ms: float = 0.0) -> Column:
    return F.lit(start_ms) + frame / F.lit(fps) * F.lit(1000.0)


def frame_at(time_s: Column, start_s: float, fps: float) -> Column:
    """The frame of a time; truncates toward zero."""
    return ((time_s - F.lit(start_s)) * F.lit(fps)).cast("long")


def blob_confidence(area: Column, full_area: float = 5000.0) -> Column:
    return F.least(F.lit(1.0), area / F.lit(full_area))


def straight_line_offset(distance: Column, heading_deg: Column) -> tuple[Column, Column]:
    return distance * F.cos(F.radians(heading_deg)), distance * F.sin(F.radians(heading_deg))

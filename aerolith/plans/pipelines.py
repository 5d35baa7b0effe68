"""End-to-end plans: detections and telemetry to one position for each target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregate import count_and_confidence, median_position, weighted_position
from ..operators.dbscan import clustered_position
from ..operators.localize import confident, detector_for, every_nth_frame, localize, localize_nadir
from ..operators.timejoin import exact_join, interpolating_join
from ..schemas import FIELD_CAMERA, NED, SWAPPED, Camera, Convention


def nadir_pipeline(detections: DataFrame, cam: Camera = FIELD_CAMERA, least_frames: int = 3) -> DataFrame:
    """Baseline: straight-down projection, median of each target."""
    return median_position(localize_nadir(detections, cam), ["flag_id"], least_frames, counted=detections)


def weighted_pipeline(detections: DataFrame, cam: Camera = FIELD_CAMERA, how: Convention = NED, least_frames: int = 10) -> DataFrame:
    return weighted_position(localize(detections, cam, how), ["flag_id"], least_frames=least_frames)


def clustered_pipeline(detections: DataFrame, cam: Camera = FIELD_CAMERA, how: Convention = NED, every: int = 1, least_frames: int = 10) -> DataFrame:
    return clustered_position(localize(every_nth_frame(detections, every), cam, how), least_frames=least_frames)


def median_pipeline(detections: DataFrame, cam: Camera = FIELD_CAMERA, how: Convention = NED, least_confidence: float = 0.4) -> DataFrame:
    """The flagship: confident detections, full geometry, median of each target."""
    return median_position(localize(confident(detections, least_confidence), cam, how), ["flag_id"], counted=detections)


def run_recording(detections: DataFrame, frames: DataFrame, telemetry: DataFrame, cam: Camera, how: Convention, every: int = 3, least_frames: int = 5) -> DataFrame:
    """Sampled frames, interpolated telemetry, localization, weighted mean, and the count and mean confidence of all estimates.

    ``detections`` has ``frame_idx, flag_id, u, v, confidence``; frames without telemetry go before anything heavy.
    """
    placed = interpolating_join(every_nth_frame(frames, every), telemetry)
    placed = placed.withColumnsRenamed({"lat": "lat_uav", "lon": "lon_uav", "alt_m": "altitude"})
    found = localize(detections.join(placed, "frame_idx"), cam, how)
    mean = weighted_position(found, ["flag_id"], least_frames=least_frames).select("flag_id", "lat", "lon")
    return mean.join(count_and_confidence(found, ["flag_id"]), "flag_id")


def run_video(
    frames: DataFrame, telemetry: DataFrame, detect: Callable[[DataFrame], DataFrame], cam: Camera = FIELD_CAMERA, how: Convention = SWAPPED,
    every: int = 5, above_m: float = 90.0, by: str = "flight_id", **more,
) -> DataFrame:
    """A video's one position: every fifth frame that has all telemetry, detector by height, magnetic heading corrected, all estimates pooled and clustered.

    ``frames`` has ``by, frame_idx``; ``telemetry`` ``lat, lon, h, roll_deg, pitch_deg, yaw_mag_deg`` of frames. ``detect`` gets the frames with
    telemetry and ``detector`` and adds ``det_id, u, v, confidence``, a row for each detection.
    """
    seen = exact_join(every_nth_frame(frames, every), telemetry, [by, "frame_idx"], ("lat", "lon", "h", "roll_deg", "pitch_deg", "yaw_mag_deg"))
    placed = seen.withColumnsRenamed({"lat": "lat_uav", "lon": "lon_uav", "h": "altitude", "yaw_mag_deg": "yaw_deg"})
    found = localize(confident(detect(detector_for(placed, above_m)), 0.5), cam, how)
    return clustered_position(found, by, "det_id", **more)


def pooled_position(estimates: DataFrame, **more) -> DataFrame:
    """All detections as one group, whatever their target."""
    return clustered_position(estimates.withColumn("flag_id", F.lit(0).cast("long")), **more)

"""The place of a detector in a plan: pluggable batch functions over frames, and a table-backed detector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import blob_confidence

DETECTION = "frame_idx long, flag_id int, u double, v double, confidence double"


def run_detector(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], schema: str = DETECTION) -> DataFrame:
    """Apply ``detect`` to Arrow batches of frames; it returns rows of ``schema``. Join telemetry before, not after."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield detect(part)

    return frames.mapInPandas(batches, schema)


def detect_by_height(frames: DataFrame, plain: Callable, tiled: Callable, schema: str = DETECTION, above_m: float = 90.0) -> DataFrame:
    """``tiled`` for frames strictly above a height, ``plain`` for the others, and for all where the tiled one's library is missing."""

    def detect(part: pd.DataFrame) -> pd.DataFrame:
        high = part["altitude"] > above_m
        try:
            found = [tiled(part[high])] if high.any() else []
        except ImportError:
            found = [plain(part[high])]
        return pd.concat([*found, plain(part[~high])], ignore_index=True)

    return run_detector(frames, detect, schema)


def detector(boxes: DataFrame | None, blobs: DataFrame | None, use_colour: bool = False) -> DataFrame:
    """``frame_idx, u, v, confidence`` of the chosen strategy: the model's boxes, or colour blobs if asked for or if there is no model."""
    if boxes is None and blobs is None:
        raise ValueError("neither boxes nor blobs")
    found = detections_from_boxes(boxes, 0.4) if boxes is not None and not (use_colour and blobs is not None) else blobs_to_detections(blobs)
    return found.select("frame_idx", "u", "v", "confidence")


def detections_from_boxes(boxes: DataFrame, least_confidence: float = 0.5) -> DataFrame:
    """Centres of boxes ``x1, y1, x2, y2`` with enough confidence; ``flag_id`` is the place in the frame's list."""
    kept = boxes.where(F.col("confidence") >= F.lit(least_confidence))
    listed = kept.groupBy("frame_idx").agg(F.sort_array(F.collect_list(F.struct("box_idx", "x1", "y1", "x2", "y2", "confidence"))).alias("boxes"))
    each = listed.select("frame_idx", F.posexplode("boxes").alias("flag_id", "b"))
    return each.select(
        "frame_idx", "flag_id", ((F.col("b.x1") + F.col("b.x2")) / 2).alias("u"), ((F.col("b.y1") + F.col("b.y2")) / 2).alias("v"), "b.confidence",
    )


def blobs_to_detections(blobs: DataFrame, least_area: float = 100.0, full_area: float = 5000.0) -> DataFrame:
    """Detections of colour blobs (``area, m00, m10, m01``): areas from ``least_area`` with mass, confidence by area."""
    kept = blobs.where((F.col("area") >= F.lit(least_area)) & (F.col("m00") != 0))
    return kept.withColumns({"u": F.col("m10") / F.col("m00"), "v": F.col("m01") / F.col("m00"), "confidence": blob_confidence(F.col("area"), full_area)})

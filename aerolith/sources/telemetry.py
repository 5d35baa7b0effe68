"""Readers and writers: phone CSV, decoded autopilot messages, camera files, ground truth, results."""

from __future__ import annotations

import csv
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import written
from ..operators.timejoin import last_known
from ..schemas import DECLINATION_DEG, GROUND_TRUTH, TELEMETRY_ALIASES, TELEMETRY_REQUIRED, Camera
from .jsonlist import JsonList

#: Most different headers in one folder.
MOST_HEADERS = 1000


def canonical_names(header: list[str]) -> list[str]:
    """The known names of a header's columns; others as they are. Two columns for one field, or a missing field, raise ValueError."""
    names = [TELEMETRY_ALIASES.get(c.strip().lower(), c.strip()) for c in header]
    twice = sorted(n for n in set(names) if names.count(n) > 1)
    if twice:
        raise ValueError(f"more than one column for {twice}")
    missing = sorted(set(TELEMETRY_REQUIRED) - set(names))
    if missing:
        raise ValueError(f"missing columns {missing}; available: {sorted(header)}")
    return names


def normalize_telemetry(raw: DataFrame) -> DataFrame:
    """Alias headers, demand the seven fields, drop rows that lack one, angles to radians.

    Unknown columns stay. Two headers for one field, or a missing field, raise ValueError. Rows keep no order;
    operators that need one sort for themselves.
    """
    df = raw.withColumnsRenamed(dict(zip(raw.columns, canonical_names(raw.columns))))
    df = df.withColumns({c: F.col(c).cast("double") for c in TELEMETRY_REQUIRED}).dropna(subset=list(TELEMETRY_REQUIRED))
    turned = {f"{a}_rad": F.radians(f"{a}_deg") for a in ("roll", "pitch", "yaw")}
    return df.withColumns(turned).drop("roll_deg", "pitch_deg", "yaw_deg")


def read_phone_csv(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """Telemetry of a CSV file or a folder of them, each with its own header: any known names in any order.

    Files are told apart by their first lines, which a pass over the text of their first blocks finds by partial aggregates. Then all
    files are one scan, in which every line is parsed by the layout of its file, so columns never swap. Only the different headers reach
    the driver (``MOST_HEADERS`` at most). Columns that only some files have are null in the rows of the others; unknown ones are text. A
    header without one of the seven fields, or with two columns for one, raises ValueError and names a file. ``file`` names a column
    for the file's path. Lines equal to their file's header are no rows; a value may be quoted, but not hold a line break.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    clean = F.regexp_replace(F.rtrim("value"), "^\ufeff", "")
    ranked = lines.where("_block = 0").select("_file", clean.alias("value"), F.monotonically_increasing_id().alias("_at")).where("value <> ''")
    heads = written(ranked.groupBy("_file").agg(F.min_by("value", "_at").alias("_header")))
    headers = sorted((r._header, r.example) for r in heads.groupBy("_header").agg(F.min("_file").alias("example")).limit(MOST_HEADERS + 1).collect())
    if len(headers) > MOST_HEADERS:
        raise ValueError(f"more than {MOST_HEADERS} different headers in {path}")
    layouts = []
    for header, example in headers:
        try:
            layouts.append(canonical_names(next(csv.reader([header]))))
        except ValueError as e:
            raise ValueError(f"{example}: {e}") from None
    every = list(dict.fromkeys((*TELEMETRY_REQUIRED, *(c for names in layouts for c in names))))
    quoted = lambda c: "`" + c.replace("`", "``") + "`"
    if not layouts:
        return normalize_telemetry(spark.createDataFrame([], ", ".join(f"{c} string" for c in (*every, *filter(None, [file])))))
    few = heads.count() * 512 <= 32 << 20  # paths and headers
    known = lines.join(F.broadcast(heads) if few else heads, "_file")
    row = F.lit(None)
    for (header, _), names in zip(headers, layouts):
        parsed = F.from_csv(clean, ", ".join(f"{quoted(c)} string" for c in names))
        whole = F.struct(*[(parsed[c] if c in names else F.lit(None).cast("string")).alias(c) for c in every])
        row = F.when((F.col("_header") == header) & (clean != header), whole).otherwise(row)  # a header's own fields stay null and go
    rows = known.select(row.alias("_row"), F.col("_file"))
    return normalize_telemetry(rows.select("_row.*", *([F.col("_file").alias(file)] if file else [])))


def number_frames(messages: DataFrame, fps: float, by: str = "flight_id", time: str = "t") -> DataFrame:
    """Set ``frame_idx`` from ``time`` (seconds) since the flight's first message, truncated."""
    start = messages.groupBy(by).agg(F.min(time).alias("_start"))
    return messages.drop("frame_idx").join(start, by).withColumn("frame_idx", ((F.col(time) - F.col("_start")) * F.lit(fps)).cast("long")).drop("_start")


def frames_from_messages(messages: DataFrame, by: str = "flight_id") -> DataFrame:
    """Last GPS, ATT and BARO values of every frame key, one sparse row a frame; partial frames stay partial.

    ``messages`` has ``frame_idx, t, type, lat_e7, lon_e7, roll, pitch, yaw, alt``; the last in the log's order wins, ``seq`` if
    there is such a column, else ``t``.
    """
    order = "seq" if "seq" in messages.columns else "t"
    last = lambda c, kind: F.max_by(F.when(F.col("type") == kind, F.col(c)), F.when(F.col("type") == kind, F.col(order)))
    return messages.groupBy(by, "frame_idx").agg(
        (last("lat_e7", "GPS") / F.lit(1e7)).alias("lat"), (last("lon_e7", "GPS") / F.lit(1e7)).alias("lon"), last("alt", "BARO").alias("h"),
        last("roll", "ATT").alias("roll_deg"), last("pitch", "ATT").alias("pitch_deg"), last("yaw", "ATT").alias("yaw_mag_deg"),
    )


def state_rows(messages: DataFrame, by: str = "flight_id", declination_deg: float = DECLINATION_DEG, order: str = "seq", bucket: float = 4096.0) -> DataFrame:
    """A row after every message once all three kinds were seen: last known position, attitude and height.

    ``order`` is the messages' number in the log, unique in a flight; state is carried over buckets of it, see :func:`last_known`.
    """
    of = lambda c, kind: F.when(F.col("type") == kind, F.col(c))
    known = last_known(messages.select(by, "t", order, "type", "lat_e7", "lon_e7", "alt", "roll", "pitch", "yaw"), by, order, {
        "lat": of("lat_e7", "GPS") / F.lit(1e7), "lon": of("lon_e7", "GPS") / F.lit(1e7), "alt_m": of("alt", "BARO"),
        "roll_deg": of("roll", "ATT"), "pitch_deg": of("pitch", "ATT"), "yaw_deg": of("yaw", "ATT") + F.lit(declination_deg)}, bucket)
    fields = ["lat", "lon", "alt_m", "roll_deg", "pitch_deg", "yaw_deg"]
    return known.select(by, "t", *fields).dropna(subset=fields)


def camera_from_mapping(spec: dict) -> Camera:
    """A camera from any of three layouts: K and dist, camera_matrix and dist_coeffs, or fx, fy, cx, cy and dist_coeffs."""
    k = spec.get("K") or spec.get("camera_matrix")
    if "fx" in spec:
        fx, fy, cx, cy = (float(spec[n]) for n in ("fx", "fy", "cx", "cy"))
    elif k:
        fx, fy, cx, cy = float(k[0][0]), float(k[1][1]), float(k[0][2]), float(k[1][2])
    else:
        raise ValueError(f"no intrinsics among {sorted(spec)}")
    dist = spec.get("dist", spec.get("dist_coeffs", []))
    if dist and isinstance(dist[0], (list, tuple)):
        dist = dist[0]
    return Camera(fx, fy, cx, cy, tuple(float(x) for x in dist))


def load_camera(path: str) -> Camera:
    import yaml

    return camera_from_mapping(yaml.safe_load(Path(path).read_text()))


def save_camera(cam: Camera, path: str) -> None:
    import yaml

    Path(path).write_text(yaml.safe_dump({"fx": cam.fx, "fy": cam.fy, "cx": cam.cx, "cy": cam.cy, "dist_coeffs": list(cam.coefficients)}))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(GROUND_TRUTH).csv(path)


def write_results(df: DataFrame, path: str) -> None:
    """One JSON file with the list of all rows, in the order of ``df``'s partitions: the whole list is there, or the old file as it was."""
    df.sparkSession.dataSource.register(JsonList)
    df.write.format("jsonlist").mode("append").save(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def checkerboard(spark: SparkSession, columns: int = 9, rows: int = 6, square_mm: float = 25.0) -> DataFrame:
    """Corner points of a calibration board, in its plane."""
    k = F.col("id")
    return spark.range(columns * rows).select(
        (k % columns * F.lit(square_mm)).alias("x"), (F.floor(k / columns) * F.lit(square_mm)).alias("y"), F.lit(0.0).alias("z"),
    )


def frame_table(spark: SparkSession, n_frames: int, fps: float, every: int = 1, start_ms: float = 0.0) -> DataFrame:
    """Frame numbers and times of a video, every n-th one, the first included."""
    return spark.range(0, n_frames, every).select(F.col("id").alias("frame_idx"), (F.lit(start_ms) + F.col("id") / F.lit(fps) * F.lit(1000.0)).alias("t_ms"))

"""The registered queries, each over whole tables; their names are those of the oracle SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo
from ..functions.geo import rounded
from ..functions.lens import distort, undistort, undistort_converged
from ..operators import aggregate as agg
from ..operators import calibrate
from ..operators.blobs import cleaned_blobs
from ..operators.calibrate import calibrate_mount as fit_mount
from ..operators.dbscan import clustered_position, dbscan
from ..operators.detect import blobs_to_detections, detections_from_boxes
from ..operators.localize import central_crop, confident, detector_for, every_nth_frame, in_frame, localize, localize_nadir, project_to_image, without_tilt
from ..operators.quantile import quantiles
from ..operators.running import LIMIT, running_medians
from ..operators.scratch import release, scratch_path, written
from ..operators.tiles import merge_boxes, with_tiles
from ..operators.timejoin import exact_join, interpolating_join, last_known, nearest_join
from ..schemas import ABS_GUARD, DECLINATION_DEG, FIELD_CAMERA, FIELD_CAMERA_FLAT, M_PER_DEG_COARSE, MOUNT_NED, NED, SIGNED_GUARD, SWAPPED
from ..sources.fixtures import view
from ..sources.flightlog import flight_messages, read_flight_log, write_flight_log
from ..sources.telemetry import frames_from_messages, normalize_telemetry, number_frames, read_phone_csv, state_rows
from . import pipelines, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _r(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), d) for c, d in digits.items()})


def _det(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "detections_v")


def _estimates(df: DataFrame) -> DataFrame:
    return _r(df.select("frame_idx", "flag_id", F.col("est_lat").alias("lat"), F.col("est_lon").alias("lon")), lat=7, lon=7)


def _positions(df: DataFrame, *more: str) -> DataFrame:
    return _r(df.select("flag_id", "lat", "lon", *more), lat=7, lon=7)


@query
def localize_ned_frame(spark, d):
    return _estimates(localize(_det(spark, d)))


@query
def localize_src_frame(spark, d):
    return _estimates(localize(_det(spark, d), how=SWAPPED))


@query
def localize_nadir_111320(spark, d):
    return _estimates(localize_nadir(_det(spark, d)))


@query
def localize_nadir_111000(spark, d):
    return _estimates(localize_nadir(_det(spark, d), m_per_deg=M_PER_DEG_COARSE))


@query
def undistort_pixel(spark, d):
    x, y = geo.pixel_to_ray(F.col("u"), F.col("v"), FIELD_CAMERA)
    df = undistort(_det(spark, d).withColumns({"xd": x, "yd": y}), "xd", "yd", FIELD_CAMERA)
    return _r(df.select("frame_idx", "xn", "yn"), xn=9, yn=9)


@query
def undistort_to_convergence(spark, d):
    """Pixels in single precision, straightened until the forward model gives them back."""
    x, y = geo.pixel_to_ray(F.col("u").cast("float").cast("double"), F.col("v").cast("float").cast("double"), FIELD_CAMERA)
    df = undistort_converged(in_frame(_det(spark, d)).withColumns({"xd": x, "yd": y}), "xd", "yd", FIELD_CAMERA)
    return _r(df.select("frame_idx", "xn", "yn"), xn=9, yn=9)


@query
def distort_roundtrip(spark, d):
    """Largest and mean distance, in millionths of the image plane's unit, after bending a ray and straightening it again; and how far it was bent."""
    df = in_frame(_det(spark, d))
    x, y = geo.pixel_to_ray(F.col("u"), F.col("v"), FIELD_CAMERA)
    df = df.withColumns({"x0": x, "y0": y})
    xd, yd = distort(F.col("x0"), F.col("y0"), FIELD_CAMERA)
    df = undistort(df.withColumns({"xd": xd, "yd": yd}), "xd", "yd", FIELD_CAMERA)
    off = lambda a, b: F.greatest(F.abs(F.col(a) - F.col("x0")), F.abs(F.col(b) - F.col("y0"))) * F.lit(1e6)
    out = df.agg(F.count("*").alias("n"), F.max(off("xn", "yn")).alias("max_off"), F.avg(off("xn", "yn")).alias("mean_off"), F.avg(off("xd", "yd")).alias("mean_bend"))
    return _r(out, max_off=3, mean_off=3, mean_bend=3)


@query
def inverse_projection(spark, d):
    df = project_to_image(_det(spark, d), "dn", "de", FIELD_CAMERA_FLAT)
    return _r(df.select("frame_idx", "u", "v"), u=5, v=5)


@query
def bbox_center(spark, d):
    df = _det(spark, d).withColumns({"x1": F.col("u") - 12.0, "x2": F.col("u") + 14.0, "y1": F.col("v") - 9.0, "y2": F.col("v") + 11.0})
    u, v = geo.bbox_center(*(F.col(c) for c in ("x1", "y1", "x2", "y2")))
    return df.select("frame_idx", rounded(u, 6).alias("cu"), rounded(v, 6).alias("cv"))


@query
def detector_boxes(spark, d):
    """Box centres listed by frame: four detections share a frame, weak ones go, numbers restart in each frame."""
    boxes = _det(spark, d).select(
        F.floor(F.col("frame_idx") / 4).cast("long").alias("frame_idx"), F.col("frame_idx").alias("box_idx"), "confidence",
        (F.col("u") - 5).alias("x1"), (F.col("u") + 5).alias("x2"), (F.col("v") - 5).alias("y1"), (F.col("v") + 5).alias("y2"))
    return _r(detections_from_boxes(boxes).select("frame_idx", F.col("flag_id").cast("long").alias("place"), "u", "v", "confidence"), u=6, v=6, confidence=6)


@query
def blob_detections(spark, d):
    blobs = _det(spark, d).select("frame_idx", (F.col("confidence") * 8000.0).alias("area"), F.floor(F.col("confidence") * 100).alias("m00"), (F.col("u") * 2).alias("m10"), (F.col("v") * 2).alias("m01"))
    return _r(blobs_to_detections(blobs).select("frame_idx", "u", "v", "confidence"), u=5, v=5, confidence=6)


@query
def tiled_detections(spark, d):
    """Boxes around the detections as tiles of their frame see them, cut at each tile's border and surer the more is seen; merged they are whole and once."""
    boxes = with_tiles(_det(spark, d).select(F.floor(F.col("frame_idx") / 4).cast("long").alias("frame_idx"), "confidence", "u", "v"))
    cut = boxes.select(
        "frame_idx", F.greatest(F.col("u") - 12, "left").alias("x1"), F.greatest(F.col("v") - 9, "top").alias("y1"), F.least(F.col("u") + 14, "right").alias("x2"), F.least(F.col("v") + 11, "bottom").alias("y2"),
        "confidence").where("x1 < x2 and y1 < y2")
    seen = F.col("confidence") * ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1")) / F.lit(520.0))
    return _r(merge_boxes(cut.withColumn("confidence", seen)), x1=5, y1=5, x2=5, y2=5, confidence=6)


@query
def colour_blobs(spark, d):
    """Thumbnails of frames, in which detections are painted as rectangles with a hole and a speck beside; closed, opened, labelled, and measured."""
    at = [F.floor(F.col(c) / 8).cast("long").alias(n) for c, n in (("u", "cx"), ("v", "cy"))]
    # as a generator's output (see localize), so that filters on pixels aren't rewritten through the projection
    c = _det(spark, d).select(F.floor(F.col("frame_idx") / 4).cast("long").alias("frame_idx"), (F.col("frame_idx") % 3 + 2).alias("size"), F.inline(F.array(F.struct(*at))))
    # a detection becomes some fifty pixels, so a small file of few splits is dealt to all cores first
    c = c.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    side = lambda: F.explode(F.sequence(F.lit(-4).cast("long"), F.lit(6).cast("long")))
    painted = c.withColumn("dx", side()).withColumn("dy", side()).where(
        ((F.abs("dx") <= F.col("size")) & (F.abs("dy") <= F.col("size")) & ((F.col("dx") != 0) | (F.col("dy") != 0))) | ((F.col("dx") == 6) & (F.col("dy") == 6)))
    pixels = painted.select("frame_idx", (F.col("cx") + F.col("dx")).alias("x"), (F.col("cy") + F.col("dy")).alias("y"))
    found = cleaned_blobs(pixels, width=240, height=135, tile=32)
    return _r(blobs_to_detections(found, least_area=10.0, full_area=200.0).select("frame_idx", "m00", "m10", "m01", "u", "v", "confidence"), u=5, v=5, confidence=6)


@query
def detector_choice(spark, d):
    return detector_for(_det(spark, d)).groupBy("detector").agg(F.count("*").alias("n"))


@query
def rotation_elements(spark, d):
    m = geo.rotation(*(F.radians(c) for c in ("roll_deg", "pitch_deg", "yaw_deg")))
    return _det(spark, d).select("frame_idx", *[rounded(c, 9).alias(k) for k, c in m.items()])


@query
def cog_heading(spark, d):
    t = view(spark, d, "telemetry_v").where("lat is not null").select("flight_id", "t_ms", "lat", "lon")
    t = last_known(t, "flight_id", "t_ms", {"lat0": F.col("lat"), "lon0": F.col("lon")}, 60_000.0, before_row=True)
    h = geo.course_over_ground(F.col("lat0"), F.col("lon0"), F.col("lat"), F.col("lon"))
    return t.select("flight_id", "t_ms", rounded(h, 6).alias("heading_rad"))


@query
def true_heading(spark, d):
    return _det(spark, d).select("frame_idx", geo.true_heading(F.col("yaw_deg"), DECLINATION_DEG).alias("true_yaw_deg"))


def _errors(spark, d, f):
    e = localize(_det(spark, d)).where("est_lat is not null")
    return e.select("frame_idx", f(*(F.col(c) for c in ("est_lat", "est_lon", "flag_lat", "flag_lon"))).alias("error_m"))


@query
def haversine_asin(spark, d):
    return _r(_errors(spark, d, geo.haversine), error_m=3)


@query
def haversine_atan2(spark, d):
    return _r(_errors(spark, d, lambda *x: geo.haversine(*x, form="atan2")), error_m=3)


@query
def planar_error(spark, d):
    return _r(_errors(spark, d, geo.planar_error), error_m=3)


@query
def score_bins(spark, d):
    return _errors(spark, d, geo.haversine).groupBy(geo.score(F.col("error_m")).alias("points")).agg(F.count("*").alias("n"))


@query
def bin_label(spark, d):
    return _errors(spark, d, geo.haversine).groupBy(geo.bin_label(F.col("error_m")).alias("bin")).agg(F.count("*").alias("n"))


@query
def full_score(spark, d):
    e = _errors(spark, d, geo.haversine)
    points = geo.full_score(F.col("error_m"), F.col("frame_idx") % 2 == 0, F.col("frame_idx") % 10 == 0)
    return e.groupBy(points.alias("points")).agg(F.count("*").alias("n"))


@query
def footprint_metrics(spark, d):
    h, cam = F.col("altitude"), FIELD_CAMERA
    df = _det(spark, d).select("altitude").distinct()
    return df.select("altitude", rounded(geo.pixels_per_metre(cam, h), 6).alias("px_per_m"), rounded(geo.ground_sample_distance(cam, h), 8).alias("gsd_m"),
                     rounded(geo.footprint_half_width(cam, h), 6).alias("half_width_m"), rounded(geo.target_pixels(cam, h, 2.0), 6).alias("target_px"), rounded(geo.tilt_error(h, 2.0), 6).alias("tilt_m"))


@query
def spherical_variant(spark, d):
    return _det(spark, d).select("frame_idx", rounded(geo.spherical_offset(F.col("lat_uav"), F.col("dn")), 7).alias("lat"))


@query
def sigma_expectation(spark, d):
    n = _det(spark, d).groupBy("flag_id").agg(F.count("*").alias("n"))
    return n.select("flag_id", "n", rounded(geo.expected_sigma(5.0, F.col("n")), 6).alias("sigma_m"))


@query
def frame_sampling(spark, d):
    return every_nth_frame(_det(spark, d), 5).select("frame_idx", "flag_id")


@query
def frame_time_mapping(spark, d):
    k = F.col("frame_idx")
    ms = geo.frame_time_ms(k, 30.0, 1000.0)
    return _det(spark, d).select("frame_idx", rounded(ms, 4).alias("t_ms"), geo.frame_at(k / F.lit(7.0), 3.0, 60.0).alias("frame_of_time"))


@query
def conf_filter_strict(spark, d):
    return confident(_det(spark, d), 0.5, strict=True).select("frame_idx", "flag_id")


@query
def conf_filter_inclusive(spark, d):
    c = F.when(F.col("frame_idx") % 10 == 0, F.lit(0.5)).when(F.col("frame_idx") % 10 == 1, F.lit(None)).otherwise(F.col("confidence"))
    return confident(_det(spark, d).withColumn("confidence", c), 0.5).select("frame_idx", "flag_id")


@query
def guard_abs_vs_signed(spark, d):
    det = _det(spark, d)
    ok = lambda how, name: localize(det, FIELD_CAMERA_FLAT, how).groupBy().agg(F.count("est_lat").alias(name))
    from dataclasses import replace

    signed, magnitude = ok(NED, "signed"), ok(replace(NED, guard=ABS_GUARD, signed=False), "magnitude")
    return signed.crossJoin(magnitude).withColumn("guard", F.lit(SIGNED_GUARD))  # one row each


@query
def in_frame_filter(spark, d):
    return in_frame(_det(spark, d)).select("frame_idx", "flag_id")


@query
def central_crop_filter(spark, d):
    return central_crop(_det(spark, d)).select("frame_idx", "flag_id")


@query
def first_n_frames(spark, d):
    return agg.first_frames(_det(spark, d), ["flag_id"], 5).select("flag_id", "frame_idx")


@query
def agg_median(spark, d):
    return _positions(pipelines.median_pipeline(_det(spark, d)), "n_frames")


@query
def agg_weighted_mean(spark, d):
    return _r(_positions(pipelines.weighted_pipeline(_det(spark, d)), "n_frames", "mean_confidence"), mean_confidence=6)


@query
def agg_min_frames(spark, d):
    return _positions(pipelines.weighted_pipeline(_det(spark, d), least_frames=55), "n_frames")


@query
def count_mean_confidence(spark, d):
    return _r(agg.count_and_confidence(localize(_det(spark, d)), ["flag_id"]), mean_confidence=6)


def _cluster_points(spark, d):
    return localize(confident(_det(spark, d), 0.4, strict=True), FIELD_CAMERA_FLAT)


@query
def dbscan_labels(spark, d):
    points = written(_cluster_points(spark, d).select("flag_id", "frame_idx", "est_lat", "est_lon"))
    return dbscan(points).select("flag_id", "frame_idx", "cluster")


@query
def agg_dbscan(spark, d):
    return _positions(clustered_position(_cluster_points(spark, d)), "n_frames", "n_used", "cluster")


@query
def dbscan_no_cluster_fallback(spark, d):
    """No point has ten thousand neighbours, so every target falls back to the mean of all."""
    return _positions(clustered_position(_cluster_points(spark, d), least=10_000), "n_frames", "n_used", "cluster")


@query
def pooled_weighted_mean(spark, d):
    """One group of all detections: their weighted mean, which is what clustering falls back to; see ``pooled_all_flags``."""
    pooled = localize(_det(spark, d), FIELD_CAMERA_FLAT).withColumn("flag_id", F.lit(0).cast("long"))
    return _positions(agg.weighted_position(pooled, ["flag_id"]), "n_frames")


@query
def pooled_all_flags(spark, d):
    """All detections as one group, clustered: the weighted mean of the largest cluster. Its size takes the grid from a few thousand detections on."""
    return _positions(pipelines.pooled_position(localize(_det(spark, d), FIELD_CAMERA_FLAT)), "n_frames", "n_used", "cluster")


@query
def telemetry_exact_join(spark, d):
    """Frames of twenty seconds with telemetry of the same number, if position, attitude and height are all there."""
    sparse = frames_from_messages(number_frames(view(spark, d, "messages_v").withColumn("t", F.col("t") / F.lit(1000.0)), 0.05))
    keys = view(spark, d, "frames_v").select("flight_id", F.floor(F.col("t_ms") / 20_000).cast("long").alias("frame_idx")).distinct()
    return _r(exact_join(keys, sparse, ["flight_id", "frame_idx"], ("lat", "roll_deg", "h")).select("flight_id", "frame_idx", "lat", "h", "roll_deg"), lat=7)


@query
def telemetry_nearest_join(spark, d):
    out = nearest_join(view(spark, d, "frames_v"), view(spark, d, "telemetry_v"))
    return _r(out.select("frame_idx", "flight_id", "sample_ms", "lat", "yaw_deg"), lat=7)


@query
def telemetry_interp_join(spark, d):
    out = interpolating_join(view(spark, d, "frames_v"), view(spark, d, "telemetry_v"))
    return _r(out.drop("t_ms"), lat=7, lon=7, alt_m=6, roll_deg=6, pitch_deg=6, yaw_deg=6)


@query
def telemetry_gap_limit(spark, d):
    out = interpolating_join(view(spark, d, "frames_v"), view(spark, d, "telemetry_v"), gap_ms=5000.0)
    return _r(out.select("frame_idx", "flight_id", "lat", "lon"), lat=7, lon=7)


@query
def telemetry_wrapped_yaw(spark, d):
    out = interpolating_join(view(spark, d, "frames_v"), view(spark, d, "telemetry_v"), columns=("yaw_deg",), wrap=("yaw_deg",))
    return _r(out.select("frame_idx", "yaw_deg"), yaw_deg=5)


@query
def telemetry_pivot_by_frame(spark, d):
    return _r(frames_from_messages(view(spark, d, "messages_v")), lat=7, lon=7)


@query
def telemetry_by_time(spark, d):
    """Messages numbered into frames of twenty seconds by their time, and pivoted."""
    messages = view(spark, d, "messages_v").withColumn("t", F.col("t") / F.lit(1000.0))
    return _r(frames_from_messages(number_frames(messages, 0.05)), lat=7, lon=7)


@query
def telemetry_forward_fill(spark, d):
    return _r(state_rows(view(spark, d, "messages_v")), lat=7, lon=7)


@query
def telemetry_from_log(spark, d):
    """The messages written as binary logs, one for each flight, read back in splits, numbered into frames and pivoted: as ``telemetry_by_time``."""
    path = scratch_path(spark)
    write_flight_log(view(spark, d, "messages_v").withColumn("time_us", (F.col("t") * 1000).cast("long")), path)
    return _r(frames_from_messages(number_frames(flight_messages(read_flight_log(spark, path, split=1 << 20)), 0.05)), lat=7, lon=7)


@query
def telemetry_folder(spark, d):
    """Telemetry written as files of two headers, whose columns differ in name and order and one of which has a column more, and read as one folder."""
    t, path = view(spark, d, "telemetry_v"), scratch_path(spark)
    first = t.where("flight_id % 2 = 0").select(F.col("t_ms").alias("time"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("alt_m").alias("altitude"),
                                               F.col("roll_deg").alias("roll"), F.col("pitch_deg").alias("pitch"), F.col("yaw_deg").alias("azimuth"))
    second = t.where("flight_id % 2 = 1").select(F.col("flight_id").alias("flight"), F.col("yaw_deg").alias("heading"), "pitch_deg", "roll_deg", F.col("lon").alias("lng"), "lat", F.col("alt_m").alias("alt"),
                                                F.col("t_ms").alias("timestamp"))
    for part in (first, second):
        part.write.mode("append").option("header", True).csv(path)
    out = read_phone_csv(spark, path)
    return _r(out.withColumn("flight", F.coalesce(F.col("flight").cast("long"), F.lit(-1))), lat=7, lon=7, roll_rad=9, pitch_rad=9, yaw_rad=9)


@query
def alias_normalize(spark, d):
    t = view(spark, d, "telemetry_v")
    raw = t.select("flight_id", F.col("t_ms").alias("time"), F.when(F.pmod(F.col("t_ms") / 100, F.lit(50)) != 0, F.col("lat")).alias("latitude"), F.col("lon").alias("longitude"),
                   F.col("alt_m").alias("altitude"), F.col("roll_deg").alias("roll"), F.col("pitch_deg").alias("pitch"), F.col("yaw_deg").alias("azimuth"))
    out = normalize_telemetry(raw)
    return _r(out, lat=7, lon=7, roll_rad=9, pitch_rad=9, yaw_rad=9)


def _report(spark, d):
    return reports.against_truth(pipelines.median_pipeline(_det(spark, d)), view(spark, d, "truth_v"))


@query
def truth_left_join_report(spark, d):
    return _r(_report(spark, d).select("flag_id", "error_m", "points", "bin"), error_m=3)


@query
def report_summary(spark, d):
    return _r(reports.summary(_report(spark, d)), mean_error_m=3, max_error_m=3, share_20m=6)


@query
def mission_total(spark, d):
    return _r(reports.mission_total(_report(spark, d)), share=6)


@query
def error_vs_n_prefix_median(spark, d):
    m = agg.prefix_medians(localize(confident(_det(spark, d))), ["flag_id"])
    return _r(m, lat=7, lon=7)


def _running(spark, d, by, limit):
    e = localize(confident(_det(spark, d))).where("est_lat is not null")
    return _r(running_medians(e, by, {"lat": "est_lat", "lon": "est_lon"}, "frame_idx", limit), lat=7, lon=7)


@query
def running_median_by_target(spark, d):
    """The medians of every prefix of every target's estimates, without an end."""
    return _running(spark, d, ["flag_id"], LIMIT)


@query
def running_median_pooled(spark, d):
    """The same of all detections as one group, which is cut into buckets: of 1,024 rows here, as the tables are small."""
    return _running(spark, d, [], 1024)


@query
def imu_ablation(spark, d):
    det = confident(_det(spark, d))
    full, flat = (agg.median_position(localize(x), ["flag_id"], counted=det) for x in (det, without_tilt(det)))
    truth = view(spark, d, "truth_v")
    err = lambda e, n: reports.against_truth(e, truth).select("flag_id", F.col("error_m").alias(n))
    return _r(err(full, "with_m").join(err(flat, "without_m"), "flag_id"), with_m=3, without_m=3)


@query
def telemetry_stats_pop(spark, d):
    out = view(spark, d, "telemetry_v").groupBy("flight_id").agg(
        F.count("*").alias("n"), F.avg("alt_m").alias("alt_mean"), F.stddev_pop("alt_m").alias("alt_std"), F.stddev_pop("roll_deg").alias("roll_std"), F.min("alt_m").alias("alt_min"), F.max("alt_m").alias("alt_max"))
    return _r(out, alt_mean=6, alt_std=6, roll_std=6)


@query
def detection_rate(spark, d):
    seen = F.count(F.when((F.col("u") >= 0) & (F.col("u") < 1920) & (F.col("v") >= 0) & (F.col("v") < 1080), 1))
    out = _det(spark, d).groupBy("flag_id").agg((seen / F.count("*")).alias("rate"), F.min("u").alias("u_min"), F.max("u").alias("u_max"))
    return _r(out, rate=6, u_min=5, u_max=5)


@query
def experiment_metrics(spark, d):
    """Spread over frames: 95th percentile and sample deviation of errors, mean bias, share within 20 m."""
    e = _errors(spark, d, geo.haversine)
    p95 = quantiles(e, [], {"p95_m": "error_m"}, 0.95, counted=_det(spark, d)).drop("n")
    out = e.agg(F.stddev_samp("error_m").alias("sd_m"), F.avg("error_m").alias("bias_m"), F.avg((F.col("error_m") <= 20.0).cast("double")).alias("share_20m"))
    out = p95.crossJoin(out)  # one row each
    return _r(out, p95_m=3, sd_m=3, bias_m=3, share_20m=6)


@query
def error_sensitivity(spark, d):
    """How far a change of each input moves the localization error of the given detections."""
    return _r(reports.sensitivity(_det(spark, d)), err_m=5)


@query
def error_sensitivity_rss(spark, d):
    """The changes together: root of the summed squares, and with the pixel's averaged over ten frames."""
    return _r(reports.root_sum_square(reports.sensitivity(_det(spark, d))), rss_m=4, rss_averaged_m=4)


@query
def straight_line_offsets(spark, d):
    """Where an aircraft at 18 m/s would be, in metres north and east of its flight's first sample, had it kept each sample's heading since."""
    t = view(spark, d, "telemetry_v")
    first = t.groupBy("flight_id").agg(F.min("t_ms").alias("t0"))
    north, east = geo.straight_line_offset((F.col("t_ms") - F.col("t0")) / F.lit(1000.0) * F.lit(18.0), F.col("yaw_deg"))
    return _r(t.join(first, "flight_id").select("flight_id", "t_ms", north.alias("north_m"), east.alias("east_m")), north_m=4, east_m=4)


@query
def inject_false_alarms(spark, d):
    mixed = reports.with_false_alarms(_det(spark, d))
    return _positions(pipelines.median_pipeline(mixed), "n_frames")


@query
def filter_matrix(spark, d):
    """Median error of each target under six filters of the given detections, of all headings."""
    table = F.broadcast(spark.createDataFrame(reports.FILTERS, "scenario string, height double, least double, attitude boolean, frames int"))
    det = _det(spark, d).join(table, (F.coalesce("confidence", F.lit(1.0)) >= F.col("least")) & (F.abs(F.col("altitude") - F.col("height")) <= 10.0))
    for c in ("roll_deg", "pitch_deg"):
        det = det.withColumn(c, F.when(F.col("attitude"), F.col(c)).otherwise(F.lit(0.0)))
    w = Window.partitionBy("scenario", "flag_id").orderBy("frame_idx")
    first = det.withColumn("_rn", F.row_number().over(w)).where("_rn <= frames").drop("_rn")
    est = agg.median_position(localize(first), ["scenario", "flag_id"], at_most=max(f[-1] for f in reports.FILTERS))
    truth = view(spark, d, "truth_v")
    err = geo.haversine(*(F.col(c) for c in ("lat", "lon", "flag_lat", "flag_lon")))
    out = est.join(truth, "flag_id").withColumn("error_m", err).groupBy("scenario").agg(
        F.count("*").alias("n"), F.avg("error_m").alias("mean_error_m"), F.sum(geo.score(F.col("error_m"))).cast("long").alias("points"))
    return _r(out, mean_error_m=3)


@query
def stress_limits(spark, d):
    """Per heading: median error of all frames flown at it, and whether it is within 20 m."""
    e = localize(confident(_det(spark, d))).where("est_lat is not null")
    err = geo.haversine(*(F.col(c) for c in ("est_lat", "est_lon", "flag_lat", "flag_lon")))
    out = quantiles(e.select("yaw_deg", err.alias("e")), ["yaw_deg"], {"error_m": "e"}, counted=_det(spark, d)).drop("n")
    return _r(out, error_m=3).withColumn("passes", F.col("error_m") <= 20.0)


@query
def residuals_en(spark, d):
    return _r(reports.residuals(localize(_det(spark, d)), NED.lon_scale).select("frame_idx", "east_m", "north_m"), east_m=4, north_m=4)


def _scored(spark, d, positions):
    return _r(reports.against_truth(positions, view(spark, d, "truth_v")).select("flag_id", "error_m", "points"), error_m=3)


@query
def full_pipeline_approach1(spark, d):
    return _scored(spark, d, pipelines.nadir_pipeline(_det(spark, d)))


@query
def full_pipeline_approach2(spark, d):
    return _scored(spark, d, pipelines.weighted_pipeline(_det(spark, d)))


@query
def full_pipeline_swapped(spark, d):
    """The weighted plan in the older axis order, as flown; ``video_run`` is the clustered one."""
    return _scored(spark, d, pipelines.weighted_pipeline(_det(spark, d), how=SWAPPED))


@query
def full_pipeline_approach3(spark, d):
    return _scored(spark, d, pipelines.clustered_pipeline(_det(spark, d), FIELD_CAMERA_FLAT))


@query
def video_run(spark, d):
    """Each flight as a video: frames of twenty seconds, every fifth taken, exact telemetry, detector by height, one pooled and clustered position."""
    messages = view(spark, d, "messages_v").withColumn("t", F.col("t") / F.lit(1000.0))
    numbered = number_frames(messages, 0.05)
    det = _det(spark, d).select((F.col("flag_id") % 10).alias("flight_id"), F.floor(F.col("frame_idx") / 200).cast("long").alias("frame_idx"), F.col("frame_idx").alias("det_id"), "u", "v", "confidence")
    found = pipelines.run_video(numbered.select("flight_id", "frame_idx").distinct(), frames_from_messages(numbered), lambda f: f.join(det, ["flight_id", "frame_idx"]))
    return _r(found.select("flight_id", "lat", "lon", "n_frames", "n_used", "cluster"), lat=7, lon=7)


@query
def recording_run(spark, d):
    """Detections on frames, telemetry interpolated, three frames at least and every frame: the runner's plan, on data too thin for its own 5 and 3."""
    frames = view(spark, d, "frames_v")
    det = _det(spark, d).select("frame_idx", "flag_id", "u", "v", "confidence")
    return _r(pipelines.run_recording(det, frames, view(spark, d, "telemetry_v"), FIELD_CAMERA_FLAT, NED, every=1, least_frames=3), lat=7, lon=7, mean_confidence=6)


def _observations(spark, d):
    return in_frame(_det(spark, d)).where("pitch_deg < 80").withColumns({
        "true_lat": F.col("lat_uav") + F.col("dn") / F.lit(111320.0), "true_lon": F.col("lon_uav") + F.col("de") / (F.lit(111320.0) * F.cos(F.radians("lat_uav")))})


@query
def calibrate_mount(spark, d):
    """Recovers a planted mount offset; an iteration is no SQL, so tests hold it against the planted angles and a simplex search; for one step see ``mount_step``."""
    return fit_mount(_observations(spark, d))


@query
def mount_step(spark, d):
    """The normal equations that a step of the fit solves, per observation and in metres a degree, at two offsets."""
    obs = _observations(spark, d)
    rows = written(obs.select(*calibrate.COLUMNS))  # computed once for the sums and the count; rows with nulls count too
    out = calibrate.normal_sums(rows, [(0.0, 0.0, 0.0), (4.0, -0.5, 1.0)]).withColumn("n", F.lit(rows.count()))
    release(rows)
    turn = F.lit(math.pi / 180)
    return out.select("roll_deg", "pitch_deg", "yaw_deg", "row", *[rounded(F.col(c) / F.col("n") * turn * turn, 4).alias(c) for c in ("a1", "a2", "a3")], rounded(F.col("g") / F.col("n") * turn, 4).alias("g"))


@query
def mount_objective(spark, d):
    """What the fit minimizes, per observation and at given offsets; and the older order's, which applies offsets twice."""
    obs = _observations(spark, d)
    rows = written(obs.select(*calibrate.COLUMNS))  # computed once for both forms, the means and the count; rows with nulls count too
    offsets = [(0.0, 0.0, 0.0), (1.0, -2.0, 3.0), (-0.5, 0.5, 10.0)]
    out = None
    for name, mount in (("mount", MOUNT_NED), ("older", None)):
        part = calibrate.mount_objective(rows, offsets, mount=mount).withColumn("form", F.lit(name))
        out = part if out is None else out.unionByName(part)
    n = rows.count()
    release(rows)
    return out.withColumn("n", F.lit(n)).select("form", "roll_deg", "pitch_deg", "yaw_deg", rounded(F.sqrt(F.col("squared_m2") / F.col("n")), 4).alias("rms_m"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truth_left_join_report(spark, sf_dir)

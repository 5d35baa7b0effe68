"""Closed-form truths of the geometry, clamps of the time joins, scores, clustering and calibration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.functions import geo
from aerolith.functions.lens import distort, undistort
from aerolith.operators.aggregate import median_position, prefix_medians, weighted_position
from aerolith.operators.calibrate import euler_matrix, simplex_minimum
from aerolith.operators.dbscan import clustered_position, dbscan
from aerolith.operators.localize import confident, detector_for, every_nth_frame, localize, localize_nadir, project_to_image, without_tilt
from aerolith.operators.timejoin import interpolating_join, nearest_join
from aerolith.schemas import FIELD_CAMERA, FIELD_CAMERA_FLAT, IDEAL_CAMERA, M_PER_DEG, NED, SWAPPED
from aerolith.sources.telemetry import camera_from_mapping, checkerboard, normalize_telemetry, read_phone_csv, write_results

DET = "frame_idx long, flag_id long, u double, v double, altitude double, lat_uav double, lon_uav double, roll_deg double, pitch_deg double, yaw_deg double, confidence double"


def det(spark, *rows):
    return spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], DET)


def metres(row, lat=30.0, lon=31.0):
    return (row.est_lat - lat) * M_PER_DEG, (row.est_lon - lon) * NED.lon_scale


@pytest.mark.parametrize("yaw", [0.0, 45.0, 90.0, 180.0, 270.0])
def test_nadir_pixel_is_below_the_aircraft_at_every_heading(spark, yaw):
    r = localize(det(spark, (960.0, 540.0, 80.0, 30.0, 31.0, 0.0, 0.0, yaw, 1.0)), IDEAL_CAMERA).first()
    assert metres(r) == pytest.approx((0, 0), abs=1e-6)


@pytest.mark.parametrize("yaw,north,east", [(0, 0, 16), (90, -16, 0), (180, 0, -16), (270, 16, 0)])
def test_a_pixel_to_the_right_turns_with_the_heading(spark, yaw, north, east):
    r = localize(det(spark, (1260.0, 540.0, 80.0, 30.0, 31.0, 0.0, 0.0, float(yaw), 1.0)), IDEAL_CAMERA).first()
    assert metres(r) == pytest.approx((north, east), abs=1e-3)


def test_offset_doubles_with_altitude_and_flat_rays_are_refused(spark):
    a, b, c = localize(det(spark, (960.0, 240.0, 80.0, 30.0, 31.0, 0.0, 0.0, 0.0, 1.0), (960.0, 240.0, 160.0, 30.0, 31.0, 0.0, 0.0, 0.0, 1.0), (960.0, 540.0, 80.0, 30.0, 31.0, 0.0, 85.0, 0.0, 1.0)), IDEAL_CAMERA).orderBy("frame_idx").collect()
    assert metres(b)[0] / metres(a)[0] == pytest.approx(2, abs=1e-3)
    assert c.est_lat is None and c.est_lon is None


def test_missing_angles_and_nulls(spark):
    rows = localize(det(spark, (960.0, 540.0, 80.0, 30.0, 31.0, None, None, None, None), (None, 540.0, 80.0, 30.0, 31.0, 0.0, 0.0, 0.0, 1.0)), IDEAL_CAMERA).orderBy("frame_idx").collect()
    assert metres(rows[0]) == pytest.approx((0, 0), abs=1e-6) and rows[1].est_lat is None


def test_projection_is_the_inverse_of_localization(spark):
    rows = [(0.0, 0.0, 90.0, 30.0, 31.0, r, p, y, 1.0) for r in (-3.0, 2.0) for p in (0.0, 4.0) for y in (0.0, 30.0, 200.0)]
    ground = det(spark, *rows).withColumns({"n": F.lit(12.0), "e": F.lit(-7.0)})
    for r in localize(project_to_image(ground, "n", "e", IDEAL_CAMERA), IDEAL_CAMERA).collect():
        assert metres(r) == pytest.approx((12, -7), abs=1e-6)


def test_lens_round_trip(spark):
    df = spark.range(200).select((F.col("id") / 400 - 0.25).alias("x"), (F.col("id") % 7 / 20 - 0.15).alias("y"))
    xd, yd = distort(F.col("x"), F.col("y"), FIELD_CAMERA)
    out = undistort(df.withColumns({"xd": xd, "yd": yd}), "xd", "yd", FIELD_CAMERA)
    assert out.select(F.max(F.abs(F.col("xn") - F.col("x")) + F.abs(F.col("yn") - F.col("y")))).first()[0] < 1e-7


def test_rotation_is_orthonormal(spark):
    m = geo.rotation(F.lit(0.1), F.lit(-0.2), F.lit(2.5))
    r = np.array(spark.range(1).select(*m.values()).first()).reshape(3, 3)
    assert np.allclose(r @ r.T, np.eye(3)) and np.allclose(r, euler_matrix(0.1, -0.2, 2.5))


def test_conventions_differ_and_baseline(spark):
    d = det(spark, (1200.0, 400.0, 80.0, 30.0, 31.0, 1.0, 2.0, 30.0, 1.0))
    a, b, c = localize(d).first(), localize(d, how=SWAPPED).first(), localize_nadir(d).first()
    assert len({round(x.est_lat, 6) for x in (a, b, c)}) == 3


def test_scores_and_labels(spark):
    e = spark.createDataFrame([(x,) for x in (10.0, 20.0, 25.0, 35.0, 45.0, 55.0, 70.0, None)], "e double")
    assert [r[0] for r in e.select(geo.score(F.col("e"))).collect()] == [15, 15, 12, 9, 6, 3, 0, 0]
    assert [r[0] for r in e.select(geo.bin_label(F.col("e"))).collect()][-2:] == ["> 60 m", "NOT DETECTED"]
    assert [r[0] for r in e.select(geo.bin_label(F.col("e"))).collect()][1:3] == ["< 20 m", "20–30 m"]


def test_haversine_forms_agree(spark):
    x = [F.lit(v) for v in (30.0, 31.0, 30.001, 31.002)]
    a, b = spark.range(1).select(geo.haversine(*x), geo.haversine(*x, form="atan2")).first()
    assert a == pytest.approx(b) and a == pytest.approx(222.8, abs=0.5)


PHONE = [(0, 30.0, 31.0, 80.0, 0.0, 0.0, 0.0), (1000, 30.0001, 31.0001, 80.5, 1.0, 0.5, 90.0), (2000, 30.0002, 31.0002, 81.0, 2.0, 1.0, 180.0)]


def test_phone_csv_and_interpolation(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("time,latitude,longitude,altitude,roll,pitch,azimuth\n" + "\n".join(",".join(map(str, r)) for r in PHONE) + "\n,30,31,80,0,0,0\n")
    t = read_phone_csv(spark, str(path))
    assert t.count() == 3 and t.orderBy("timestamp_ms").collect()[1].yaw_rad == pytest.approx(math.pi / 2)
    tel = t.select(F.lit(1).alias("flight_id"), F.col("timestamp_ms").alias("t_ms"), "lat", "lon", "alt_m")
    frames = spark.createDataFrame([(1, x) for x in (500.0, -100.0, 9999.0, 1000.0)], "flight_id int, t_ms double")
    for bucket in (60_000.0, 700.0):  # inside one bucket, and over bucket edges
        out = {r.t_ms: r for r in interpolating_join(frames, tel, columns=("lat", "lon", "alt_m"), bucket_ms=bucket).collect()}
        assert out[500.0].lat == pytest.approx(30.00005, abs=1e-8) and out[500.0].alt_m == pytest.approx(80.25)
        assert (out[-100.0].lat, out[9999.0].lat, out[1000.0].lat) == (30.0, 30.0002, 30.0001)
    near = {r.t_ms: r.sample_ms for r in nearest_join(frames, tel).collect()}
    assert near == {500.0: 0.0, -100.0: 0.0, 9999.0: 2000.0, 1000.0: 1000.0}


def test_wrapped_yaw_and_gap(spark):
    tel = spark.createDataFrame([(1, 0.0, 359.0), (1, 1000.0, 1.0)], "flight_id int, t_ms double, yaw_deg double")
    f = spark.createDataFrame([(1, 500.0)], "flight_id int, t_ms double")
    assert interpolating_join(f, tel, columns=("yaw_deg",)).first().yaw_deg == pytest.approx(180)
    assert interpolating_join(f, tel, columns=("yaw_deg",), wrap=("yaw_deg",)).first().yaw_deg == pytest.approx(0, abs=1e-9)
    assert interpolating_join(f, tel, columns=("yaw_deg",), gap_ms=200.0).count() == 0


def test_header_errors(spark):
    with pytest.raises(ValueError, match="missing columns"):
        normalize_telemetry(spark.createDataFrame([(1, 2)], "time int, latitude int"))
    with pytest.raises(ValueError, match="more than one"):
        normalize_telemetry(spark.createDataFrame([(1, 2)], "yaw int, azimuth int"))


def test_filters(spark):
    d = det(spark, *[(960.0, 540.0, h, 30.0, 31.0, 1.0, 1.0, 0.0, c) for h, c in ((80.0, 0.4), (90.0, 0.41), (91.0, None))])
    assert confident(d, 0.4).count() == 3 and confident(d, 0.4, strict=True).count() == 1
    assert [r.detector for r in detector_for(d).orderBy("frame_idx").collect()] == ["plain", "plain", "tiled"]
    assert every_nth_frame(d, 2).count() == 2 and without_tilt(d).first().roll_deg == 0.0


def estimates(spark, pts):
    return spark.createDataFrame([(1, i, 30.0 + n / M_PER_DEG, 31.0 + e / NED.lon_scale, c) for i, (n, e, c) in enumerate(pts)], "flag_id long, frame_idx long, est_lat double, est_lon double, confidence double")


def test_medians_and_means(spark):
    e = estimates(spark, [(1, 0, 0.9), (2, 0, 0.9), (4, 0, 0.5), (10, 0, 0.3)])
    assert (median_position(e, ["flag_id"]).first().lat - 30) * M_PER_DEG == pytest.approx(3, abs=1e-4)
    assert median_position(e, ["flag_id"], 5).count() == 0 and weighted_position(e, ["flag_id"]).count() == 0
    m = weighted_position(e, ["flag_id"], least_frames=3).first()
    assert (m.lat - 30) * M_PER_DEG == pytest.approx((0.9 + 1.8 + 2.0) / 2.3, abs=1e-4) and m.n_frames == 3
    assert [round((r.lat - 30) * M_PER_DEG, 3) for r in prefix_medians(e, ["flag_id"]).orderBy("n").collect()] == [1, 1.5, 2, 3]


@pytest.mark.parametrize("share", [0.5, 0.95])
def test_quantiles_of_large_groups_are_those_of_small_ones(spark, share):
    from aerolith.operators.quantile import quantiles

    rng = np.random.default_rng(4)
    rows = [("big", float(v), float(v * 2)) for v in rng.normal(30, 1e-3, 3001)] + [("even", float(v), float(-v)) for v in rng.integers(0, 5, 2000)]
    rows += [("same", 7.0, 7.0)] * 500 + [(None, float(v), 1.0) for v in rng.normal(0, 1e6, 400)] + [("few", 1.0, None), ("few", 4.0, 2.0), ("big", None, 1e9)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    plain = {r.g: (r.n, r.a, r.b) for r in quantiles(df, ["g"], {"a": "x", "b": "y"}, share).collect()}
    zoomed = {r.g: (r.n, r.a, r.b) for r in quantiles(df, ["g"], {"a": "x", "b": "y"}, share, limit=20).collect()}
    assert set(plain) == set(zoomed) == {"big", "even", "same", None, "few"}
    for g, want in plain.items():
        assert zoomed[g] == pytest.approx(want, rel=1e-14)
    one = quantiles(df, [], {"a": "x"}, share, limit=20).first()
    assert one.a == pytest.approx(quantiles(df, [], {"a": "x"}, share).first().a, rel=1e-14)


def test_clusters_both_ways(spark):
    rng = np.random.default_rng(4)
    pts = [(*rng.normal(0, 4, 2), 0.9) for _ in range(30)] + [(*rng.normal(200, 4, 2), 0.9) for _ in range(12)] + [(1000 + 100 * i, 0, 0.9) for i in range(4)]
    e = estimates(spark, [tuple(map(float, p)) for p in pts])
    one, two = ({r.frame_idx: r.cluster for r in dbscan(e, method=m).collect()} for m in ("groups", "grid"))
    assert one == two and set(one.values()) == {0, 30, -1}
    best = clustered_position(e).first()
    assert best.cluster == 0 and best.n_used == 30 and abs(best.lat - 30) * M_PER_DEG < 3


def test_simplex_search():
    x, v = simplex_minimum(lambda p: float(((p - [0.1, -0.2, 0.3]) ** 2).sum()), np.zeros(3))
    assert np.allclose(x, [0.1, -0.2, 0.3], atol=1e-3) and v < 1e-6


def test_camera_layouts_and_board(spark, tmp_path):
    k = [[1432.0, 0, 960.0], [0, 1431.0, 540.0], [0, 0, 1]]
    assert camera_from_mapping({"K": k, "dist": [1, 2, 3, 4]}).coefficients == (1, 2, 3, 4, 0)
    assert camera_from_mapping({"camera_matrix": k, "dist_coeffs": [[0, 0, 0, 0, 5]]}).coefficients[-1] == 5
    with pytest.raises(ValueError):
        camera_from_mapping({"x": 1})
    assert checkerboard(spark).count() == 54
    write_results(checkerboard(spark), str(tmp_path / "out"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "out")).count() == 54


def test_planted_mount_offset_is_recovered(spark, sf):
    from aerolith.operators.calibrate import calibrate_mount
    from aerolith.schemas import FIELD_CAMERA_FLAT
    from aerolith.sources.fixtures import view

    d = view(spark, sf, "detections_v").where("pitch_deg < 80 and abs(u - 960) < 900")
    # pixels as a mount that is turned by 3 degrees about the lens axis would see the same ground
    a = math.radians(3.0)
    x, y = (F.col("u") - FIELD_CAMERA_FLAT.cx) / FIELD_CAMERA_FLAT.fx, (F.col("v") - FIELD_CAMERA_FLAT.cy) / FIELD_CAMERA_FLAT.fy
    truth = localize(d, FIELD_CAMERA_FLAT).where("est_lat is not null")
    lon = F.col("lon_uav") + (F.col("est_lon") - F.col("lon_uav")) * F.lit(NED.lon_scale) / (F.lit(M_PER_DEG) * F.cos(F.radians("lat_uav")))
    obs = truth.withColumns({"true_lat": F.col("est_lat"), "true_lon": lon}).withColumns({
        "u": (x * math.cos(a) + y * math.sin(a)) * FIELD_CAMERA_FLAT.fx + FIELD_CAMERA_FLAT.cx, "v": (y * math.cos(a) - x * math.sin(a)) * FIELD_CAMERA_FLAT.fy + FIELD_CAMERA_FLAT.cy})
    r = calibrate_mount(obs).first()
    assert abs(abs(r.yaw_deg) - 3.0) < 0.05 and abs(r.roll_deg) < 0.05 and abs(r.pitch_deg) < 0.05 and r.rms_m < 0.1


def test_every_observation_takes_part_in_the_mount_fit(spark):
    from aerolith.operators.calibrate import calibrate_mount, squared_error
    from aerolith.schemas import FIELD_CAMERA_FLAT as cam
    from aerolith.schemas import MOUNT_NED

    n = 20_500
    h = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)).cast("double")
    obs = spark.range(n).select(
        (h(1, 1200) + 360).alias("u"), (h(2, 700) + 190).alias("v"), (h(3, 20) + 70).alias("altitude"), F.lit(30.0).alias("lat_uav"), F.lit(31.0).alias("lon_uav"),
        (h(4, 5) - 2).alias("roll_deg"), h(5, 4).alias("pitch_deg"), (h(6, 8) * 45).alias("yaw_deg"), (F.lit(30.0) + (h(7, 21) - 10) / 111320).alias("true_lat"), (F.lit(31.0) + (h(8, 21) - 10) / 96360).alias("true_lon"))
    r = calibrate_mount(obs).first()
    a = np.array(obs.collect(), dtype=float)
    rays = np.stack([(a[:, 0] - cam.cx) / cam.fx, (a[:, 1] - cam.cy) / cam.fy, np.ones(n)], axis=1)
    x, v = simplex_minimum(lambda p: squared_error(p, rays, np.radians(a[:, 5:8]), a[:, 2], a[:, 3:5], a[:, 8:10], np.array(MOUNT_NED, dtype=float)), np.zeros(3))
    assert r.n_rows == n and r.rms_m == pytest.approx(math.sqrt(v / n), abs=1e-9)
    assert np.allclose([r.roll_deg, r.pitch_deg, r.yaw_deg], np.degrees(x), atol=1e-3)


def test_pool_of_all_targets_gives_its_largest_cluster(spark, sf):
    from aerolith.operators.dbscan import labels_in_memory
    from aerolith.plans.queries import QUERIES
    from aerolith.schemas import FIELD_CAMERA_FLAT
    from aerolith.sources.fixtures import view

    e = localize(view(spark, sf, "detections_v"), FIELD_CAMERA_FLAT).where("confidence > 0.4 and est_lat is not null").select("frame_idx", "est_lat", "est_lon", "confidence")
    o, lat, lon, c = (np.array(x) for x in zip(*e.collect()))
    label = labels_in_memory((lon - lon.mean()) * M_PER_DEG * math.cos(math.radians(lat.mean())), (lat - lat.mean()) * M_PER_DEG, o, 15.0, 3)
    sizes = {int(k): int((label == k).sum()) for k in set(label[label >= 0].tolist())}
    best = min(sizes, key=lambda k: (-sizes[k], k))
    used = label == best
    r = QUERIES["pooled_all_flags"](spark, sf).first()
    assert (r.n_frames, r.n_used, r.cluster) == (len(o), int(used.sum()), best) and r.n_used < r.n_frames
    assert r.lat == pytest.approx((lat * c)[used].sum() / c[used].sum(), abs=2e-7) and r.lon == pytest.approx((lon * c)[used].sum() / c[used].sum(), abs=2e-7)
    pool = e.withColumn("flag_id", F.lit(0).cast("long"))
    assert {x.frame_idx: x.cluster for x in dbscan(pool, method="grid").collect()} == dict(zip(o.tolist(), label.tolist()))


@pytest.mark.parametrize("least", [3, 12])
def test_dense_cells_link_as_points_do(spark, least):
    from aerolith.operators.dbscan import labels_in_memory, touch

    rng = np.random.default_rng(least)
    # two dense bands that meet, if at all, by a point in the middle of a side; loose points and a border point
    band = lambda n, e0: [(float(a), float(b)) for a, b in zip(rng.uniform(-20, 20, n), rng.uniform(e0, e0 + 6, n))]
    pts = band(400, 0) + band(400, 20.7) + band(400, 46) + [(3.0, 30.0)] + [(float(a), float(b)) for a, b in rng.uniform(-150, 150, (80, 2))]
    e = estimates(spark, [(*p, 0.9) for p in pts])
    got = dbscan(e, method="grid", least=least).orderBy("frame_idx").collect()
    x, y = np.array([r.x_m for r in got]), np.array([r.y_m for r in got])
    assert [r.cluster for r in got] == labels_in_memory(x, y, np.arange(len(pts)), 15.0, least).tolist()
    for k in range(60):
        a, b = rng.normal(0, 3, (150, 2)), rng.normal(0, 3, (150, 2)) + [14 + k / 4, 0]
        assert touch(a, b, 15.0) == bool((((a[:, None] - b[None]) ** 2).sum(axis=2) <= 225.0).any())


@pytest.mark.parametrize("least", [3, 40])
def test_cells_in_memory_label_as_all_distances_do(least):
    from aerolith.operators.dbscan import labels_in_memory

    rng = np.random.default_rng(least)
    for n, spread in ((1, 1.0), (300, 120.0), (700, 400.0), (900, 30.0)):
        x, y = np.concatenate([rng.normal(0, spread, n), rng.uniform(-500, 500, 60)]), np.concatenate([rng.normal(0, spread, n), rng.uniform(-500, 500, 60)])
        order = rng.permutation(n + 60).astype(np.int64)
        assert labels_in_memory(x, y, order, 15.0, least, small=0).tolist() == labels_in_memory(x, y, order, 15.0, least, small=10_000).tolist()


def test_a_dense_cell_of_100_000_points_and_small_groups_together(spark):
    n = 100_000
    at = lambda k: (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 1000.0 - 0.5) * 8.0 / 111320.0
    dense = spark.range(n).select(F.lit(1).cast("long").alias("flag_id"), F.col("id").alias("frame_idx"), (F.lit(30.0) + at(1)).alias("est_lat"), (F.lit(31.0) + at(2)).alias("est_lon"), F.lit(0.9).alias("confidence"))
    few = spark.createDataFrame([(g, k, 30.0 + (0.01 if k == 9 else 0.0), 31.0, 0.9) for g in (2, 3) for k in range(10)], "flag_id long, frame_idx long, est_lat double, est_lon double, confidence double")
    got = {r.flag_id: (r.n_frames, r.n_used, r.cluster) for r in clustered_position(dense.unionByName(few)).collect()}
    assert got == {1: (n, n, 0), 2: (10, 9, 0), 3: (10, 9, 0)}


def test_last_known_values_cross_buckets(spark):
    from aerolith.operators.timejoin import last_known

    rows = [(f, float(k), k * 10 if k % 37 == 3 else None) for f in ("a", "b") for k in range(200)]
    for before in (False, True):
        got = last_known(spark.createDataFrame(rows, "f string, k double, v long"), "f", "k", {"x": F.col("v")}, 8.0, before_row=before).collect()
        assert len(got) == len(rows)
        for r in got:
            seen = [k for k in range(200) if k % 37 == 3 and (k < r.k or (k == r.k and not before))]
            assert r.x == (seen[-1] * 10 if seen else None)


def test_detectors_by_height_and_strategy(spark):
    import pandas as pd

    from aerolith.operators.detect import DETECTION, detect_by_height, detector

    frames = spark.createDataFrame([(k, 80.0 + 5 * k) for k in range(5)], "frame_idx long, altitude double")

    def found(conf):
        def f(part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"frame_idx": part["frame_idx"], "flag_id": 0, "u": 1.0, "v": 2.0, "confidence": conf})
        return f

    def missing(part):
        raise ImportError("no tiler here")

    assert {r.frame_idx: r.confidence for r in detect_by_height(frames, found(0.5), found(0.9), DETECTION).collect()} == {0: 0.5, 1: 0.5, 2: 0.5, 3: 0.9, 4: 0.9}
    assert {r.confidence for r in detect_by_height(frames, found(0.5), missing, DETECTION).collect()} == {0.5}
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 4.0, 0.8)], "frame_idx long, box_idx long, x1 double, y1 double, x2 double, y2 double, confidence double")
    blobs = spark.createDataFrame([(1, 200.0, 10.0, 50.0, 60.0)], "frame_idx long, area double, m00 double, m10 double, m01 double")
    assert detector(boxes, blobs).first().confidence == 0.8 and detector(None, blobs).first().u == detector(boxes, blobs, use_colour=True).first().u == 5.0


def test_sinks_and_truth_files(spark, tmp_path):
    from aerolith.sources.telemetry import load_camera, read_ground_truth, save_camera, write_csv

    save_camera(FIELD_CAMERA, str(tmp_path / "c.yaml"))
    assert load_camera(str(tmp_path / "c.yaml")) == FIELD_CAMERA
    write_csv(spark.createDataFrame([("a", 1.5, 2.5), ("b", None, 3.5)], "name string, lat double, lon double"), str(tmp_path / "t"))
    assert sorted(map(tuple, read_ground_truth(spark, str(tmp_path / "t")).collect()), key=str) == [("a", 1.5, 2.5), ("b", None, 3.5)]


def test_the_older_mount_form_applies_offsets_twice(spark, sf):
    from aerolith.plans.queries import QUERIES

    got = {(r.form, r.roll_deg): r.rms_m for r in QUERIES["mount_objective"](spark, sf).collect()}
    assert len(got) == 6 and got[("mount", 1.0)] != got[("older", 1.0)]


def test_normal_equations_find_what_the_simplex_finds(spark, sf):
    """The same offsets in a few passes, also for the older order; sums over all rows and any partitions."""
    from aerolith.operators import calibrate as c
    from aerolith.plans.queries import _observations

    obs = _observations(spark, sf)
    for mount in (c.MOUNT_NED, None):
        quick, slow = c.calibrate_mount(obs, mount=mount).first(), c.calibrate_mount(obs, mount=mount, simplex=True).first()
        assert quick.rms_m <= slow.rms_m + 1e-6 and quick.n_rows == slow.n_rows
        assert all(abs(quick[k] - slow[k]) < 5e-3 for k in range(3))
    rows = c.observed(obs, c.MOUNT_NED)
    one, many = (c.normal_equations(rows.repartition(p), np.zeros(3), c.FIELD_CAMERA_FLAT, c.MOUNT_NED) for p in (1, 7))
    assert np.allclose(one[0], many[0], rtol=1e-9) and np.allclose(one[1], many[1], rtol=1e-6) and math.isclose(one[2], many[2], rel_tol=1e-9)
    passes = c.least_squares(lambda x: c.normal_equations(rows, x, c.FIELD_CAMERA_FLAT, c.MOUNT_NED), np.zeros(3))[2]
    assert passes <= 10


def test_least_squares_of_a_curved_valley():
    from aerolith.operators.calibrate import least_squares

    def equations(x):
        r = np.array([10 * (x[1] - x[0] ** 2), 1 - x[0], 0.5 * (x[2] + 2)])
        j = np.array([[-20 * x[0], 10, 0], [-1, 0, 0], [0, 0, 0.5]])
        return j.T @ j, j.T @ r, float(r @ r), np.diag([-20 * r[0], 0, 0])

    x, value, passes = least_squares(equations, np.array([-1.2, 1.0, 0.0]))
    assert np.allclose(x, [1, 1, -2], atol=1e-4) and value < 1e-8 and passes < 50


def test_converged_lens_inverse_is_exact(spark, sf):
    """The forward model gives every pixel of a frame back, for the field camera and for a strong lens."""
    from aerolith.functions.lens import undistort_converged
    from aerolith.schemas import Camera

    strong = Camera(900.0, 900.0, 960.0, 540.0, (-0.12, 0.03, 0.001, -0.002, -0.004))
    pixels = spark.range(0, 1921, 60).select(F.col("id").cast("double").alias("u")).crossJoin(spark.range(0, 1081, 60).select(F.col("id").cast("double").alias("v")))
    for cam, most in ((FIELD_CAMERA, 1e-14), (strong, 1e-14)):
        df = pixels.withColumns({"xd": (F.col("u") - cam.cx) / cam.fx, "yd": (F.col("v") - cam.cy) / cam.fy})
        for steps in (4 if cam is FIELD_CAMERA else 8, 8):
            found = undistort_converged(df, "xd", "yd", cam, steps=steps)
            x, y = distort(F.col("xn"), F.col("yn"), cam)
            assert found.agg(F.max(F.greatest(F.abs(x - F.col("xd")), F.abs(y - F.col("yd"))))).first()[0] <= most
        coarse = undistort(df, "xd", "yd", cam)
        x, y = distort(F.col("xn"), F.col("yn"), cam)
        assert coarse.agg(F.max(F.abs(x - F.col("xd")))).first()[0] > most


@pytest.mark.parametrize("share", [0.0, 0.3, 0.5, 1.0])
def test_zoom_ends_with_infinities(spark, share):
    from aerolith.operators.quantile import quantiles

    values = [float("-inf")] * 40 + [float("inf")] * 30 + [1.7e308, -1.7e308] * 20 + [float(k) for k in range(200)]
    df = spark.createDataFrame([("a", v) for v in values], "g string, x double").repartition(3)
    zoom, plain = quantiles(df, ["g"], {"q": "x"}, share, limit=16).first(), quantiles(df, ["g"], {"q": "x"}, share).first()
    assert zoom.n == plain.n == 310 and zoom.q == plain.q


def counted_observations(spark):
    """Twelve observations, three of which lack a value (one as NaN), and how many times a row of them was computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def rows(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    data = [(500.0 + 90 * k, 300.0 + 40 * k, 80.0 + k, 30.0, 31.0, k / 5 - 1, 2.0, 45.0 * k, 30.0002, 31.0001 + k / 1e5) for k in range(12)]
    data[3], data[5], data[8] = (None, *data[3][1:]), (*data[5][:9], None), (*data[8][:2], math.nan, *data[8][3:])
    schema = ", ".join(f"{c} double" for c in ("u", "v", "altitude", "lat_uav", "lon_uav", "roll_deg", "pitch_deg", "yaw_deg", "true_lat", "true_lon"))
    return spark.createDataFrame(data, schema).mapInPandas(rows, schema), seen


def test_observations_of_the_mount_objective_are_computed_once(spark, monkeypatch):
    """Both forms, the means and the count read what was computed once; rows that lack a value count only in the mean's number."""
    from aerolith.operators import calibrate as c
    from aerolith.plans import queries
    from aerolith.schemas import FIELD_CAMERA_FLAT

    obs, seen = counted_observations(spark)
    a = np.array([[math.nan if x is None else x for x in r] for r in obs.collect()])
    before = seen.value
    monkeypatch.setattr(queries, "_observations", lambda *_: obs)
    got = {(r.form, r.roll_deg): r.rms_m for r in queries.QUERIES["mount_objective"](spark, "").collect()}
    assert seen.value - before == 12 and len(got) == 6
    a = a[~np.isnan(a).any(axis=1)]
    assert len(a) == 9
    rays = np.stack([(a[:, 0] - FIELD_CAMERA_FLAT.cx) / FIELD_CAMERA_FLAT.fx, (a[:, 1] - FIELD_CAMERA_FLAT.cy) / FIELD_CAMERA_FLAT.fy, np.ones(9)], axis=1)
    means = np.broadcast_to(a[:, 2:5].mean(axis=0), (9, 3))
    for o in ((0.0, 0.0, 0.0), (1.0, -2.0, 3.0), (-0.5, 0.5, 10.0)):
        for form, mount, place in (("mount", np.array(c.MOUNT_NED, dtype=float), a[:, 2:5]), ("older", None, means)):
            value = c.squared_error(np.radians(o), rays, np.radians(a[:, 5:8]), place[:, 0], place[:, 1:], a[:, 8:], mount)
            assert got[(form, o[0])] == pytest.approx(math.sqrt(value / 12), abs=1e-4)


def test_observations_of_the_mount_step_are_computed_once_and_read_in_one_pass(spark, monkeypatch):
    """The sums at both offsets come from one pass; rows that lack a value count only in the mean's number."""
    from aerolith.operators import calibrate as c
    from aerolith.plans import queries
    from aerolith.schemas import FIELD_CAMERA_FLAT

    obs, seen = counted_observations(spark)
    offsets = [np.radians(o) for o in ((0.0, 0.0, 0.0), (4.0, -0.5, 1.0))]
    want = [c.normal_equations(obs.dropna(), o, FIELD_CAMERA_FLAT, c.MOUNT_NED) for o in offsets]
    before = seen.value
    both = c.normal_equations(c.observed(obs, c.MOUNT_NED), offsets, FIELD_CAMERA_FLAT, c.MOUNT_NED)
    assert seen.value - before == 12 and all(np.allclose(x, y, rtol=1e-12) for p, q in zip(want, both) for x, y in zip(p, q))
    monkeypatch.setattr(queries, "_observations", lambda *_: obs)
    before, turn = seen.value, math.pi / 180
    got = {(r.roll_deg, r.row): r for r in queries.QUERIES["mount_step"](spark, "").collect()}
    assert seen.value - before == 12 and len(got) == 6
    for o, (a, g, _, _) in zip((0.0, 4.0), want):
        for k in range(3):
            r = got[(o, k)]
            assert np.allclose([r.a1, r.a2, r.a3, r.g], [*a[k] / 12 * turn**2, g[k] / 12 * turn], atol=1e-4)


def test_no_observations_and_no_offsets_of_the_mount(spark):
    from aerolith.operators import calibrate as c

    obs = spark.createDataFrame([(None, *[1.0] * 9)], ", ".join(f"{x} double" for x in c.COLUMNS))
    for mount in (c.MOUNT_NED, None):
        assert [tuple(r) for r in c.mount_objective(obs, [(1.0, 0.0, 0.0)], mount=mount).collect()] == [(1.0, 0.0, 0.0, 0.0)]
        assert [tuple(r) for r in c.normal_sums(obs, [(1.0, 0.0, 0.0)], mount=mount).collect()] == [(1.0, 0.0, 0.0, k, 0.0, 0.0, 0.0, 0.0) for k in range(3)]
    assert c.normal_sums(obs, []).count() == 0

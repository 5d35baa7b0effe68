"""Streams in order behind the watermark against the plans over whole tables."""

import random

import pytest
from pyspark.sql import functions as F

from aerolith.operators.timejoin import interpolating_join
from aerolith.sources.fixtures import view
from aerolith.sources.telemetry import state_rows
from aerolith.streaming.inorder import streamed_interpolation, streamed_states


@pytest.fixture(autouse=True)
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset(name)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def parts(spark, rows, schema, time, path, end, seed=1, n=3):
    """``rows`` as ``n`` files, out of order by up to four seconds each way, and a last file far ahead, which moves the watermark past them."""
    rng = random.Random(seed)
    mixed = sorted(rows, key=lambda r: r[time] + rng.uniform(-4000, 4000))
    size = -(-len(mixed) // n)
    for k in range(n):
        some = mixed[k * size : (k + 1) * size]
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{path}/{k}")
    spark.createDataFrame([end], schema).coalesce(1).write.parquet(f"{path}/{n}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{path}/*")


def run(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    assert q.awaitTermination(400)
    return q


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


def test_states_of_shuffled_messages_are_those_of_the_table(spark, sf, tmp_path):
    table = view(spark, sf, "messages_v").where("flight_id < 4").select("flight_id", "t", F.col("seq").cast("long").alias("seq"), "type", "lat_e7", "lon_e7", "roll", "pitch", "yaw", "alt")
    end = (-1, 1e9, 0, "NONE", None, None, None, None, None, None)
    stream = parts(spark, table.collect(), table.schema, "t", tmp_path / "in", end)
    out = streamed_states(stream)
    run(out, tmp_path, "states")
    want = state_rows(table).select("flight_id", "t", "lat", "lon", "alt_m", "roll_deg", "pitch_deg", "yaw_deg")
    got = spark.table("states").collect()
    assert rounded(map(tuple, got)) == rounded(map(tuple, want.collect())) and len(got) > 50


def test_frames_wait_for_the_sample_after_them(spark, sf, tmp_path):
    later = (F.col("t_ms") + 1e6).alias("t_ms")  # not at the epoch, where the first watermark stands
    frames = view(spark, sf, "frames_v").where("flight_id < 4").select("frame_idx", "flight_id", later)
    samples = view(spark, sf, "telemetry_v").where("flight_id < 4").withColumn("t_ms", later)
    f = parts(spark, frames.collect(), frames.schema, "t_ms", tmp_path / "f", (-1, -1, 1e9), seed=2)
    s = parts(spark, samples.collect(), samples.schema, "t_ms", tmp_path / "s", (-1, 1e9, *[0.0] * 6), seed=3, n=2)
    run(streamed_interpolation(f, s), tmp_path, "placed")
    want = interpolating_join(frames, samples)
    got = spark.table("placed").where("flight_id >= 0")
    assert rounded(map(tuple, got.select(*want.columns).collect())) == rounded(map(tuple, want.collect())) and got.count() > 50


def test_late_frames_are_dropped_and_counted(spark, tmp_path):
    schema, values = "flight_id long, frame_idx long, t_ms double", "flight_id long, t_ms double, lat double, lon double, alt_m double, roll_deg double, pitch_deg double, yaw_deg double"
    files = [[(1, 0, 1099.8), (1, 1, 1599.7)], [(1, 2, 500_000.0)], [(1, 4, 490_000.0 + 9_000)], [(1, 3, 2000.0), (1, 5, 5e8)]]
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/f/{k}")
    for k, rows in enumerate([[(1, 100.0, *[0.0] * 6)], [(1, 500_000.0, *[50.0] * 6)], [(1, 500_500.0, *[51.0] * 6)], [(1, 5e8, *[0.0] * 6)]]):
        spark.createDataFrame(rows, values).coalesce(1).write.parquet(f"{tmp_path}/s/{k}")
    read = lambda x, ddl: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{x}/*")
    q = run(streamed_interpolation(read("f", schema), read("s", values)), tmp_path, "late")
    got = {r.frame_idx: round(r.lat, 4) for r in spark.table("late").collect()}
    assert got[0] == 0.1 and got[1] == 0.15 and got[2] == 50.0 and got[4] == 49.9 and 3 not in got
    assert sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in q.recentProgress if p["stateOperators"]) == 1

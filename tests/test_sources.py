"""Folders of unlike CSV files, binary flight logs, and results written as one list."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aerolith.sources.telemetry import read_phone_csv

A = "time,latitude,longitude,altitude,roll,pitch,azimuth"
B = "timestamp,lon,lat,battery,alt,yaw,roll,pitch"


def phone_folder(tmp_path):
    rng, want = random.Random(4), []
    for k in range(6):
        rows = [(1000.0 * k + i, 30 + rng.random(), 31 + rng.random(), 80 + i, rng.random(), 2.0, 90.0 * (i % 4)) for i in range(40)]
        want += rows
        if k % 2:
            body = [A] + [",".join(map(str, r)) for r in rows]
        else:
            body = [("﻿" if k == 2 else "") + B] + [",".join(map(str, (t, lon, lat, f'"{k},5"', alt, yaw, roll, pitch))) for t, lat, lon, alt, roll, pitch, yaw in rows]
        (tmp_path / f"f{k}.csv").write_text(("\r\n" if k == 3 else "\n").join(body) + "\n")
    return want


def test_each_file_of_a_folder_has_its_own_header(spark, tmp_path):
    want = phone_folder(tmp_path)
    (tmp_path / "empty.csv").write_text("")
    out = read_phone_csv(spark, str(tmp_path), file="from")
    got = sorted((r.timestamp_ms, r.lat, r.lon, r.alt_m, math.degrees(r.roll_rad), math.degrees(r.yaw_rad)) for r in out.collect())
    assert got == [pytest.approx((t, lat, lon, alt, roll, yaw)) for t, lat, lon, alt, roll, _, yaw in sorted(want)]
    assert {(r["from"][-6:], r.battery) for r in out.collect()} == {(f"f{k}.csv", None if k % 2 else f"{k},5") for k in range(6)}


def test_files_of_many_blocks_keep_their_layout(spark, tmp_path):
    """Splits far from the header are parsed by it."""
    want = phone_folder(tmp_path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        out = read_phone_csv(spark, str(tmp_path))
        assert out.rdd.getNumPartitions() > 12
        assert sorted((r.timestamp_ms, r.lat, r.lon) for r in out.collect()) == [r[:3] for r in sorted(want)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_bad_header_names_its_file(spark, tmp_path):
    (tmp_path / "good.csv").write_text(A + "\n1,30,31,80,0,0,0\n")
    (tmp_path / "bad.csv").write_text("time,latitude,longitude,altitude,roll,pitch\n1,30,31,80,0,0\n")
    with pytest.raises(ValueError, match=r"bad\.csv: missing columns \['yaw_deg'\]"):
        read_phone_csv(spark, str(tmp_path))
    (tmp_path / "bad.csv").write_text(A + ",yaw\n1,30,31,80,0,0,0,0\n")
    with pytest.raises(ValueError, match=r"bad\.csv: more than one column"):
        read_phone_csv(spark, str(tmp_path))


def test_no_files_with_lines(spark, tmp_path):
    (tmp_path / "empty.csv").write_text("\n\n")
    assert read_phone_csv(spark, str(tmp_path)).count() == 0


def messages(spark, sf):
    from aerolith.sources.fixtures import view

    return view(spark, sf, "messages_v").withColumn("time_us", (F.col("t") * 1000).cast("long"))


@pytest.fixture(scope="module")
def logs(spark, sf, tmp_path_factory):
    from aerolith.sources.flightlog import write_flight_log

    path = tmp_path_factory.mktemp("logs") / "all"
    write_flight_log(messages(spark, sf), f"file://{path}")
    return path


def read(spark, path, split):
    from aerolith.sources.flightlog import read_flight_log

    return read_flight_log(spark, str(path), split)


@pytest.mark.parametrize("split", [97, 1000, 1 << 20])
def test_logs_read_back_in_any_splits(spark, sf, logs, split):
    """Each message once, wherever splits cut; values bit by bit, in the log's order."""
    from aerolith.sources.flightlog import flight_messages

    found = flight_messages(read(spark, logs, split))
    assert found.rdd.getNumPartitions() >= (10 if split > 3000 else 20)
    columns = ("lat_e7", "lon_e7", "roll", "pitch", "yaw", "alt")
    of = {"GPS": columns[:2], "ATT": columns[2:5], "BARO": columns[5:]}
    got = {}
    for r in sorted(found.collect(), key=lambda r: r.seq):
        got.setdefault(r.flight_id, []).append((r.t, r.type, *(r[c] for c in of[r.type])))
    want = {}
    for r in sorted(messages(spark, sf).collect(), key=lambda r: r.seq):
        want.setdefault(r.flight_id, []).append((r.t / 1000, r.type, *(r[c] for c in of[r.type])))
    assert got == want


@pytest.mark.parametrize("split", [211, 1 << 20])
def test_a_damaged_block_costs_only_its_messages(spark, logs, tmp_path, split):
    log = bytearray((logs / "4.bin").read_bytes())
    whole = {r.offset: r.numbers for r in read(spark, logs / "4.bin", 1 << 20).collect()}
    lengths = sorted(whole) + [len(log)]
    log[900:1200] = bytes(random.Random(1).choices(range(256), k=300))
    log[1000:1003] = b"\xa3\x95\x01"  # a mark that no message follows
    (tmp_path / "4.bin").write_bytes(log)
    got = {r.offset: r.numbers for r in read(spark, tmp_path / "4.bin", split).collect()}
    sound = {a: whole[a] for a, b in zip(lengths, lengths[1:]) if b <= 900 or a >= 1200}
    assert {a: got[a] for a in sound} == sound and len(got) - len(sound) <= 1  # one may begin before the damage and keep its mark


def test_cut_empty_and_foreign_files(spark, logs, tmp_path):
    log = (logs / "4.bin").read_bytes()
    (tmp_path / "a.bin").write_bytes(log[:-5])
    (tmp_path / "b.bin").write_bytes(b"")
    (tmp_path / "c.bin").write_bytes(b"no log at all " * 500)
    (tmp_path / "_d.bin").write_bytes(log)
    assert read(spark, tmp_path, 500).count() == read(spark, logs / "4.bin", 500).count() - 1
    with pytest.raises(Exception, match="FileNotFoundError|none.bin"):
        read(spark, tmp_path / "none.bin", 500).count()


def test_formats_come_from_the_log(spark, tmp_path):
    """Codes of all kinds; hundredths are scaled, texts are texts, a format after others' messages counts from there."""
    import struct

    from aerolith.sources.flightlog import MARK, Format, format_message

    f = Format("MIX", 3 + 8 + 2 + 4 + 4 + 16 + 1, "QcEfNM", ("TimeUS", "A", "B", "C", "Name", "Mode"))
    g = Format("LATE", 3 + 1, "b", ("X",))
    body = MARK + b"\x05" + struct.pack("<QhIf16sB", 7_000_000, -123, 456, 1.5, b"abc", 3)
    late = MARK + b"\x09" + struct.pack("<b", -7)
    (tmp_path / "x.bin").write_bytes(format_message(5, f) + body * 3 + format_message(9, g) + late * 4 + body)
    rows = read(spark, tmp_path / "x.bin", 1 << 20).orderBy("offset").collect()
    assert [r.type for r in rows] == ["MIX"] * 3 + ["LATE"] * 4 + ["MIX"]
    assert rows[0].numbers == {"TimeUS": 7e6, "A": -1.23, "B": 4.56, "C": 1.5, "Mode": 3.0} and rows[0].texts == {"Name": "abc"} and rows[0].time_us == 7_000_000
    assert rows[3].numbers == {"X": -7.0} and rows[3].time_us is None


def test_a_failed_write_leaves_no_log(spark, sf, tmp_path):
    from aerolith.sources.flightlog import write_flight_log

    bad = messages(spark, sf).withColumn("lat_e7", F.when(F.col("seq") % 50 == 0, F.lit(2**40)).otherwise(F.col("lat_e7")))  # beyond the field
    with pytest.raises(Exception, match="argument out of range|format requires"):
        write_flight_log(bad, str(tmp_path / "out"))
    assert not list((tmp_path / "out").glob("*"))


def test_two_threads_keep_each_others_tables(spark):
    from concurrent.futures import ThreadPoolExecutor

    from aerolith.operators.scratch import settled, written

    def work(k):
        def make():
            a = written(spark.range(1000 * (k + 1)))
            b = settled(lambda: written(a.where("id % 2 = 0")))
            return a.join(b, "id")

        return settled(make).count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, range(4))) == [500, 1000, 1500, 2000]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_results_are_one_list(spark, tmp_path):
    import json

    from aerolith.sources.telemetry import write_results

    path = tmp_path / "out.json"
    df = spark.range(0, 100, 1, 7).select("id", F.when(F.col("id") % 3 == 0, F.lit('é "q"')).alias("name"), F.struct((F.col("id") / 7).alias("x")).alias("s"))
    write_results(df.where("id % 5 <> 1"), f"file://{path}")
    assert json.loads(path.read_text()) == [{"id": i, "name": None if i % 3 else 'é "q"', "s": {"x": i / 7}} for i in range(100) if i % 5 != 1]
    write_results(df.where("id < 0"), str(path))
    assert json.loads(path.read_text()) == [] and [p.name for p in tmp_path.iterdir()] == ["out.json"]


def test_a_failed_task_leaves_the_old_list(spark, tmp_path):
    from aerolith.sources.telemetry import write_results

    path = tmp_path / "out.json"
    write_results(spark.range(3), str(path))
    old = path.read_text()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        write_results(spark.range(0, 1000, 1, 8).select((F.lit(1) / (F.col("id") - 777)).alias("x")), str(path))
    assert path.read_text() == old and [p.name for p in tmp_path.iterdir()] == ["out.json"]

"""Flights, detections and truth derived from the ``events`` table, as portable SQL; only reading JSON differs by engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK_K = "get_json_object(props, '$.k')"
DUCKDB_K = "json_extract_string(props, '$.k')"


def ctes(k: str, events: str) -> str:
    """Common table expressions up to ``detections_v``, ``truth_v``, ``telemetry_v``, ``frames_v`` and ``messages_v``."""
    return f"""
raw as (select event_id, event_type, user_id as flag_id, cast({k} as int) as k, value from {events}),
tel as (select *,
  30.05e0 + (150e0 + 90e0 * (flag_id % 4)) / 111320e0 as flag_lat,
  31.25e0 + (100e0 + 60e0 * (flag_id % 7)) / 96360e0 as flag_lon,
  75e0 + (k % 26) as h, ((event_id * 7) % 41 - 20) / 10e0 as roll, 2e0 + ((event_id * 11) % 41 - 20) / 10e0 as pitch,
  45e0 * (event_id % 8) as yaw,
  ((event_id * 37) % 61 - 30) * 1e0 as dn, ((event_id * 53) % 61 - 30) * 1e0 as de,
  ((event_id * 17) % 13 - 6) * 1e0 as nn, ((event_id * 29) % 13 - 6) * 1e0 as ne,
  value / (value + 20e0) as confidence from raw),
ang as (select *, radians(roll) as r, radians(pitch) as p, radians(yaw) as y from tel),
rot as (select *,
  cos(y)*cos(p) as r00, cos(y)*sin(p)*sin(r)-sin(y)*cos(r) as r01, cos(y)*sin(p)*cos(r)+sin(y)*sin(r) as r02,
  sin(y)*cos(p) as r10, sin(y)*sin(p)*sin(r)+cos(y)*cos(r) as r11, sin(y)*sin(p)*cos(r)-cos(y)*sin(r) as r12,
  -sin(p) as r20, cos(p)*sin(r) as r21, cos(p)*cos(r) as r22 from ang),
body as (select *, r00*dn+r10*de+r20*h as bx, r01*dn+r11*de+r21*h as b_y, r02*dn+r12*de+r22*h as bz from rot),
detections_v as (select event_id as frame_idx, flag_id, flag_lat, flag_lon, h as altitude, dn, de, roll as roll_deg,
  case when event_id % 97 = 0 then 85e0 else pitch end as pitch_deg, yaw as yaw_deg, confidence,
  b_y/bz*1452.7e0+963.2e0 + case when event_type = 'error' then 900e0 else (event_id % 7) - 3e0 end as u,
  -bx/bz*1453.1e0+541.8e0 as v,
  flag_lat-dn/111320e0+nn/111320e0 as lat_uav, flag_lon-de/96360e0+ne/96360e0 as lon_uav from body),
truth_v as (select distinct flag_id, flag_lat, flag_lon from detections_v union all select -1, 30.0e0, 31.0e0),
telemetry_v as (select flag_id % 10 as flight_id, event_id * 100e0 as t_ms, flag_lat-dn/111320e0 as lat, flag_lon-de/96360e0 as lon,
  h as alt_m, roll as roll_deg, pitch as pitch_deg, yaw as yaw_deg from tel where event_type = 'view'),
frames_v as (select event_id as frame_idx, flag_id % 10 as flight_id, event_id * 100e0 as t_ms from tel where event_type = 'purchase'),
messages_v as (select flag_id % 10 as flight_id, cast(floor(event_id / 10e0) as bigint) as frame_idx, event_id * 100e0 as t, event_id as seq,
  case event_type when 'click' then 'GPS' when 'view' then 'ATT' else 'BARO' end as type,
  cast(floor(flag_lat * 1e7) as bigint) as lat_e7, cast(floor(flag_lon * 1e7) as bigint) as lon_e7, roll, pitch, yaw, h as alt
  from tel where event_type in ('click', 'view', 'signup'))"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type", "user_id", "value", "props")
    return spark.sql(f"with {ctes(SPARK_K, '{events}')} select * from {name}", events=events)

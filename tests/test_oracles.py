"""Every registered query with SQL against DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from aerolith.plans.oracles import ORACLES
from aerolith.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f.split('.')[0]} as select * from '{sf}/{f}'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(repr(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in frame[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    assert rows(QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


def test_columns_are_pruned_at_the_scan(spark, sf):
    plan = QUERIES["agg_median"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double,props:string>" in plan


def test_streaming_window(spark, sf, tmp_path):
    from pyspark.sql import functions as F

    from aerolith.operators.localize import localize
    from aerolith.sources.fixtures import view
    from aerolith.streaming.running import windowed_positions

    est = localize(view(spark, sf, "detections_v")).withColumn("ts", F.timestamp_millis(F.col("frame_idx") * 1000))
    est.select("ts", "flag_id", "est_lat", "est_lon", "confidence").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = windowed_positions(stream).writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    fixed = windowed_positions(spark.read.parquet(str(tmp_path / "in")))
    assert spark.table("w").count() == fixed.count() > 0

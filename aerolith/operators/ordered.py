"""Positions in an order, without a task that orders a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import release, written

#: Rows that one range of the order is meant to hold, and most ranges.
RANGE_ROWS, MOST_RANGES = 1 << 16, 1 << 14


def ordered_index(df: DataFrame, group: str, order: list[str], name: str = "i", rows_name: str = "n", range_rows: int | None = None) -> DataFrame:
    """Add ``name``, gapless from 0 in the order of ``order`` (nulls first) inside ``group`` (not null), and ``rows_name``, the group's rows.

    Rows are dealt into ranges of the whole order, numbered inside (group, range), and shifted by the counts of the group's
    earlier ranges. So neither a group nor a value that holds most rows is one task: rows equal in all of ``order`` are
    told apart by where they were read, and are interchangeable.
    """
    table = written(df)
    ranges = max(1, min(-(-table.count() // (range_rows or RANGE_ROWS)), MOST_RANGES))
    told = table.withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    dealt = written(told.repartitionByRange(ranges, group, *order, "_at").withColumn("_range", F.spark_partition_id()))
    release(table)
    counts = dealt.groupBy(group, "_range").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shift = counts.select(group, "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_shift"), F.sum("_k").over(Window.partitionBy(group)).alias(rows_name))
    inside = Window.partitionBy(group, "_range").orderBy(*order, "_at")
    numbered = dealt.withColumn("_r", F.row_number().over(inside) - 1).join(shift, [group, "_range"])
    out = written(numbered.withColumn(name, (F.col("_shift") + F.col("_r")).cast("long")).drop("_at", "_range", "_r", "_shift"))
    release(dealt)
    return out

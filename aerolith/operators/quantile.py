"""Exact quantiles of groups of any size: small groups by Spark's own, large ones by zooming histograms."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import release, written

#: Values of one group that one task may hold, and cells of one zoom.
LIMIT, BINS = 1 << 20, 1024
_MOST = sys.float_info.max


def quantiles(df: DataFrame, by: list[str], columns: dict[str, str], share: float = 0.5, counted: DataFrame | None = None, at_most: int | None = None, limit: int = LIMIT) -> DataFrame:
    """``by``, ``n`` and for each item of ``columns`` (name: column) its exact quantile, interpolated as Spark's ``percentile`` does.

    Groups with more than ``limit`` rows take :func:`zoomed`, which never gathers a group; they are found by counting ``counted``
    (default ``df``), which may be any table that has at least the rows of ``df`` and is cheaper to count: all of it first, which reads
    no column, then by group. Where no group can have more than ``at_most`` rows, nothing is counted. Null values are left out.
    """
    plain = lambda x: x.groupBy(*by).agg(F.count("*").alias("n"), *[F.percentile(c, F.lit(share)).alias(n) for n, c in columns.items()])
    counted = df if counted is None else counted
    if (at_most is not None and at_most <= limit) or counted.count() <= limit:
        return plain(df)
    if counted.groupBy(*by).agg(F.count("*").alias("_n")).agg(F.max("_n")).first()[0] <= limit:
        return plain(df)
    rows = written(df.select(*by, *dict.fromkeys(columns.values())))
    large = written(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > limit))
    match = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by] or [F.lit(True)]
    few = rows.alias("r").join(F.broadcast(large).alias("l") if not by else large.alias("l"), match, "left_anti")
    out = plain(few) if by else None
    found = large
    for n, c in columns.items():
        q = zoomed(rows, large.drop("n"), by, c, share, limit).select(*[F.col(k).alias(f"_{k}") for k in by], F.col("q").alias(n))
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] or [F.lit(True)]
        found = found.join(q, on, "left").drop(*[f"_{k}" for k in by])
    return found if out is None else out.unionByName(found)


def zoomed(rows: DataFrame, groups: DataFrame, by: list[str], column: str, share: float, limit: int = LIMIT) -> DataFrame:
    """``by, q`` for each of ``groups``: the two values around the quantile are each looked for in a shrinking interval of real values.

    A turn counts the interval's values in ``BINS`` cells, by partial aggregates, and goes on in the cell that holds the wanted rank, between
    the least and the largest value there, until it has at most ``limit`` values or one value. So no task holds more than ``limit`` values.
    Infinities and NaN, which counts as the largest value, have cells of their own.
    """
    keyed = lambda df: df.withColumn("_g", F.struct(*[F.col(k).alias(k) for k in by]) if by else F.lit(0))
    x = keyed(rows.join(groups, [rows[k].eqNullSafe(groups[k]) for k in by], "left_semi") if by else rows).select("_g", F.col(column).cast("double").alias("x")).where("x is not null")
    at = F.lit(share) * (F.col("n") - 1)
    ends = x.groupBy("_g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("t"), r.cast("long").alias("rank")) for k, r in enumerate((F.floor(at), F.ceil(at)))]))
    goal = written(ends.select("_g", "lo", "hi", F.col("n").alias("left"), (at - F.floor(at)).alias("part"), wanted.alias("w")).select("_g", "lo", "hi", "left", "part", "w.t", "w.rank"))
    inside = lambda df, goals: df.join(goals, "_g").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))
    while not goal.where((F.col("left") > limit) & (F.col("lo") < F.col("hi"))).isEmpty():
        a, b = (F.greatest(F.least(F.when(F.isnan(c), F.lit(_MOST)).otherwise(F.col(c)), F.lit(_MOST)), F.lit(-_MOST)) / 2 for c in ("lo", "hi"))  # halves, as their difference can't overflow
        cell = F.when(b > a, F.least(F.floor((F.col("x") / 2 - a) / (b - a) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
        cell = F.when(F.isnan("x"), F.lit(BINS + 1)).when(F.col("x") == float("inf"), F.lit(BINS)).when(F.col("x") == float("-inf"), F.lit(-1)).otherwise(cell)
        cells = inside(x, goal).groupBy("_g", "t", "part", "rank", cell.alias("cell")).agg(F.count("*").alias("k"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = Window.partitionBy("_g", "t").orderBy("cell")  # at most BINS rows
        counted = cells.withColumn("c", F.sum("k").over(upto))
        nxt = written(counted.where((F.col("c") > F.col("rank")) & (F.col("c") - F.col("k") <= F.col("rank"))).select(
            "_g", "lo", "hi", F.col("k").alias("left"), "part", "t", (F.col("rank") - F.col("c") + F.col("k")).alias("rank")))
        release(goal)
        goal = nxt
    held = inside(x, goal.where("lo < hi")).groupBy("_g", "t", "part", "rank").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    value = held.select("_g", "t", "part", F.get("xs", F.col("rank").cast("int")).alias("v")).unionByName(goal.where("lo = hi").select("_g", "t", "part", F.col("lo").alias("v")))
    low, high = (F.max(F.when(F.col("t") == k, F.col("v"))) for k in (0, 1))
    return value.groupBy("_g", "part").agg(F.when(low == high, low).otherwise(low + F.col("part") * (high - low)).alias("q")).select(*[F.col(f"_g.{k}").alias(k) for k in by], "q")

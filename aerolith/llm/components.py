"""Connected components over a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a, b`` longs): the smallest node it reaches.

    Large stars join each node's larger neighbours to its smallest one, small stars the smaller neighbours
    and itself; both keep connectivity, and after about log(n) rounds every tree is a star. Neighbourhoods
    are aggregated and joined, never gathered; a hub's join may be split by AQE. Each round is written to
    the shared scratch folder. Self loops and repeated edges are harmless; null ends are left out; without
    edges there are no rows.
    """
    edges = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    while not _stars(edges):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now points from a node to a smaller one
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        release(edges)
        edges = nxt
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node or is such a smaller node itself."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")),
    )).alias("e")).select("e.*")
    return ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down + up > 1").isEmpty()


def relabelled(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """A written table ``node, component``: the components of ``before``, joined as ``after`` joins their names."""
    if before is None:
        return materialize(after)
    new = after.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
    moved = before.join(new, F.col("component") == F.col("_n"), "left").select("node", F.coalesce("_c", "component").alias("component"))
    out = materialize(moved.unionByName(after.join(before.select("node"), "node", "left_anti").select("node", "component")))
    release(before)
    return out

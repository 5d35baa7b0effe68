"""Sharding by a K-d tree: split at distributed weighted medians along the widest metadata dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import dense_index, materialize, release, small_or_not

#: Cells of one node's histogram; a zoom divides a cell by as many again.
BINS = 1024


def _number(df: DataFrame, name: str) -> Column:
    """An order for any metadata column: numbers as they are, other types by a hash of their text; null is 0."""
    kind = dict(df.dtypes)[name]
    c = F.col(name)
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        v = F.nanvl(c.cast("double"), F.lit(0.0))
    elif kind in ("timestamp", "date", "timestamp_ntz"):
        v = F.unix_seconds(c.cast("timestamp")).cast("double")
    else:
        v = F.crc32(c.cast("string").cast("binary")).cast("double")
    return F.coalesce(v, F.lit(0.0))


def kd_shards(
    docs: DataFrame, dims: list[str], id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, target_bytes: int | None = None, carry: dict | None = None,
) -> DataFrame:
    """Every row of ``docs`` in a leaf of a K-d tree: ``id_col, size, shard, slot`` and ``carry``'s columns.

    The leaf count is ``shards``, or total bytes / ``target_bytes`` rounded up. A node of k leaves splits
    its bytes as floor(k/2) to the rest, at the weighted quantile of its widest dimension (range over the
    root's range; the first listed on a tie). Equal values are told apart by a hash of the row's id and
    text hash, so hot values split as well as any. The quantile is found by three zooming histograms: by value, inside the
    cell by value again, inside that by the hash. Nodes, histograms and cuts are tables; the driver only counts levels,
    log2 of the leaves, so their number is not bounded by it.

    Size is the UTF-8 bytes of the text (null: none; however long) plus 1. Null dimensions count as 0, null ids hash
    like any value, repeated rows stay together or apart but are all kept, an empty table gives no rows, columns of ``docs``
    that neither ``dims`` nor ``carry`` names are not read, whatever their names.
    Shards are numbered in tree order; ``slot`` is gapless from 0 in every shard.
    """
    size = (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long")
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), size.alias("_size"),
        (F.pmod(F.xxhash64(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), F.lit(1 << 40)) / float(1 << 40)).alias("_tie"),
        *[_number(docs, d).alias(f"_d{i}") for i, d in enumerate(dims)],
        *[e.alias(f"_c_{n}") for n, e in (carry or {}).items()],
    ))
    ends = [f(f"_d{i}").alias(f"{m}{i}") for i in range(len(dims)) for m, f in (("lo", F.min), ("hi", F.max))]
    root = rows.agg(F.sum("_size").alias("bytes"), F.count("*").alias("rows"), *ends).first()
    leaves = shards or max(1, -(-(root["bytes"] or 0) // (target_bytes or 512 << 20)))
    ranges = [max((root[f"hi{i}"] or 0.0) - (root[f"lo{i}"] or 0.0), 1e-300) for i in range(len(dims))]
    nodes = docs.sparkSession.range(1).select(F.col("id").alias("_node"), F.lit(leaves).cast("long").alias("leaves"), F.lit(0).cast("long").alias("first"))
    placed = rows.withColumn("_node", F.lit(0).cast("long"))
    for _ in range((leaves - 1).bit_length()):
        cuts = _cuts(placed, nodes, ends, ranges)
        right = F.struct("_b1", "_b2", "_b3") >= F.struct(F.col("_a1").alias("_b1"), F.col("_a2").alias("_b2"), F.col("_a3").alias("_b3"))
        after = materialize(
            _binned(placed, cuts, len(dims), "left")
            .withColumn("_node", F.col("_node") * 2 + F.when(F.col("_a1").isNotNull() & right, 1).otherwise(0))
            .select(placed.columns)
        )
        release(placed, cuts)
        placed = after
        half = F.floor(F.col("leaves") / 2).cast("long")
        child = lambda k, n, at: F.struct((F.col("_node") * 2 + k).alias("_node"), n.alias("leaves"), at.alias("first"))
        children = F.when(F.col("leaves") == 1, F.array(child(0, F.col("leaves"), F.col("first")))).otherwise(
            F.array(child(0, half, F.col("first")), child(1, F.col("leaves") - half, F.col("first") + half)))
        nodes = materialize(nodes.select(F.explode(children).alias("c")).select("c.*"))
    named = placed.join(small_or_not(nodes.select("_node", F.col("first").cast("int").alias("_shard")), 24), "_node")
    carried = [f"_c_{n}" for n in carry or {}]
    placed = materialize(named.select("_id", "_size", "_shard", "_tie", *carried))
    out = dense_index(placed, root["rows"], "_shard", ["_id", "_tie"])
    return out.select(
        F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_shard").alias("shard"), "slot",
        *[F.col(f"_c_{n}").alias(n) for n in carry or {}],
    )


def _binned(placed: DataFrame, cuts: DataFrame, dims: int, how: str = "inner") -> DataFrame:
    """``placed`` with the cuts of its nodes and each row's cells: of the value, inside that cell, and of the tie."""
    joined = placed.join(small_or_not(cuts, 64), "_node", how)
    value = F.col("_d0")
    for i in range(1, dims):
        value = F.when(F.col("_dim") == i, F.col(f"_d{i}")).otherwise(value)
    scaled = (value - F.col("_lo")) / F.col("_w") * BINS
    last = F.lit(BINS - 1)
    joined = joined.withColumn("_b1", F.least(F.floor(scaled), last).cast("int"))
    return joined.withColumns({
        "_b2": F.least(F.floor((scaled - F.col("_b1")) * BINS), last).cast("int"), "_b3": F.floor(F.col("_tie") * BINS).cast("int"),
    })


def _cuts(placed: DataFrame, nodes: DataFrame, ends: list[Column], ranges: list[float]) -> DataFrame:
    """For every node of several leaves that has rows: its dimension and range, and the first cells ``_a1, _a2, _a3`` of its right side."""
    dims = range(len(ranges))
    here = placed.groupBy("_node").agg(F.sum("_size").alias("b"), *ends).join(nodes.where("leaves > 1"), "_node")
    wide = [(F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(ranges[i]) for i in dims]
    most = F.greatest(*wide) if len(wide) > 1 else wide[0]
    dim, lo, hi = F.lit(0), F.col("lo0"), F.col("hi0")
    for i in reversed(dims):
        dim, lo, hi = (F.when(wide[i] == most, x).otherwise(y) for x, y in ((F.lit(i), dim), (F.col(f"lo{i}"), lo), (F.col(f"hi{i}"), hi)))
    cuts = materialize(here.select(
        "_node", dim.alias("_dim"), lo.alias("_lo"), F.greatest(hi - lo, F.lit(1e-300)).alias("_w"),
        (F.col("b") * F.floor(F.col("leaves") / 2) / F.col("leaves")).alias("_goal"),
    ))
    for level in (1, 2, 3):
        found = _binned(placed, cuts, len(ranges))
        for k in range(1, level):
            found = found.where(F.col(f"_b{k}") == F.col(f"_a{k}"))
        cells = found.groupBy("_node", "_goal", F.col(f"_b{level}").alias("at")).agg(F.sum("_size").alias("w"))
        upto = Window.partitionBy("_node").orderBy("at")  # at most BINS rows a node
        reached = cells.withColumn("c", F.sum("w").over(upto)).where(F.col("c") >= F.col("_goal"))
        picked = reached.groupBy("_node").agg(F.min("at").alias("at"), F.min_by(F.col("c") - F.col("w"), F.col("at")).alias("before"), F.min_by("w", "at").alias("w"))
        rest = F.col("_goal") - F.col("before")
        at = F.col("at") if level < 3 else F.col("at") + F.when(rest > F.col("w") / 2, 1).otherwise(0)  # the nearer end of the last cell
        nxt = materialize(cuts.join(picked, "_node").select(
            "_node", "_dim", "_lo", "_w", rest.alias("_goal"), *[f"_a{k}" for k in range(1, level)], at.cast("int").alias(f"_a{level}")))
        release(cuts)
        cuts = nxt
    return cuts

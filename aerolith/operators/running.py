"""Running medians: the median of every prefix of a group, exact, for groups of any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import ordered_index
from .scratch import written

#: Rows of a bucket of a large group, most buckets of a group, and parts into which a bucket's rows are dealt when they are sent on.
LIMIT, MOST_BUCKETS, PARTS = 1 << 14, 1 << 10, 32


def prefix_medians_of(arriving: np.ndarray, held: np.ndarray, before: int, below: int) -> np.ndarray:
    """Median after each of ``arriving``, when ``before`` values came earlier, of which ``below`` lie under all of ``held``.

    ``held`` has the earlier values that can be a median, and may have more. Worked backwards: all values are sorted once and linked, and
    while the last arrival is taken out again the median moves by at most one place. Linear after the sort.
    """
    values = np.concatenate([held, arriving])
    order = np.argsort(values, kind="stable")
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    x = values[order].tolist()
    ahead, back = list(range(1, len(x) + 1)), list(range(-1, len(x) - 1))
    out = np.empty(len(arriving))
    at = rank = (before + len(arriving) - 1) // 2 - below
    taken = place[len(held) :].tolist()
    for j in range(len(arriving), 0, -1):
        m = before + j
        goal = (m - 1) // 2 - below
        while rank < goal:
            at, rank = ahead[at], rank + 1
        while rank > goal:
            at, rank = back[at], rank - 1
        out[j - 1] = x[at] if m % 2 else (x[at] + x[ahead[at]]) / 2
        q = taken[j - 1]
        a, b = back[q], ahead[q]
        if a >= 0:
            ahead[a] = b
        if b < len(x):
            back[b] = a
        if q == at:
            at, rank = (b, rank) if b < len(x) else (a, rank - 1)
        elif q < at:
            rank -= 1
    return out


def running_medians(df: DataFrame, by: list[str], columns: dict[str, str], order: str, limit: int = LIMIT) -> DataFrame:
    """``by, n`` and for each item of ``columns`` (name: column) the median of the group's first n rows by ``order``, for every n.

    Groups of up to ``limit`` rows are a task's sorted list each. Larger ones are cut by order into buckets, and each bucket needs of
    all rows before it only those whose rank can still be a median, about as many as it has rows itself: counts of (bucket of order, bucket of
    rank) say where they are, and a join sends them. So a task holds a few buckets of rows, whatever a group holds, and work is n log n.
    ``order`` should be unique in a group; ties are taken in the order of the values. Rows with a null value are left out, from all columns.
    """
    key = F.to_json(F.struct(*[F.col(c).alias(c) for c in by]), {"ignoreNullFields": "false"}) if by else F.lit("")
    rows = written(df.select(*by, F.col(order).alias("_o"), *[F.col(c).cast("double").alias(f"_x_{n}") for n, c in columns.items()], key.alias("_g")).dropna(subset=[f"_x_{n}" for n in columns]))
    sizes = written(rows.groupBy("_g", *by).agg(F.count("*").alias("_rows")))
    large = sizes.where(F.col("_rows") > limit)
    values = [f"_x_{n}" for n in columns]

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_o", *values], kind="stable")
        none = np.zeros(0)
        return pd.DataFrame({"_g": part["_g"], "n": np.arange(1, len(part) + 1), **{n: prefix_medians_of(part[f"_x_{n}"].to_numpy(), none, 0, 0) for n in columns}})

    schema = "_g string, n long, " + ", ".join(f"`{n}` double" for n in columns)
    few = rows.join(large.select("_g"), "_g", "left_anti")
    out = few.select("_g", "_o", *values).groupBy("_g").applyInPandas(whole, schema)
    if not large.isEmpty():
        width = F.greatest(F.lit(limit), F.ceil(F.col("_rows") / MOST_BUCKETS)).cast("long")
        many = rows.join(large.select("_g", width.alias("_width")), "_g").select("_g", "_o", "_width", *values)
        placed = ordered_index(many, "_g", ["_o", *values])
        parts = None
        for n in columns:
            one = _large(placed.select("_g", "i", "_width", F.col(f"_x_{n}").alias("x")), n)
            parts = one if parts is None else parts.join(one, ["_g", "n"])
        out = out.unionByName(parts)
    return out.join(sizes.select("_g", *by), "_g").select(*by, "n", *columns)


def _large(rows: DataFrame, name: str) -> DataFrame:
    """``_g, n, name`` for groups cut into buckets of ``_width`` rows; ``rows`` has ``_g, i, _width, x``."""
    ranked = ordered_index(rows, "_g", ["x", "i"], "r", "_rows")
    bucket = lambda c: F.floor(F.col(c) / F.col("_width")).cast("long")
    ranked = written(ranked.withColumns({"k": bucket("i"), "v": bucket("r")}))
    cells = ranked.groupBy("_g", "k", "v").agg(F.count("*").alias("c"), F.first("_width").alias("_width"))

    def wanted(part: pd.DataFrame) -> pd.DataFrame:
        """For each bucket the buckets of rank that its medians can lie in, and how many earlier rows lie under them."""
        k, v = part["k"].to_numpy(), part["v"].to_numpy()
        grid = np.zeros((k.max() + 1, v.max() + 1), dtype=np.int64)
        grid[k, v] = part["c"].to_numpy()
        size = grid.sum(axis=1)
        earlier = np.cumsum(grid, axis=0) - grid
        out = []
        for b in range(1, len(grid)):
            m, upto = int(size[:b].sum()), np.cumsum(earlier[b])
            first, last = max(0, (m - int(size[b]) - 1) // 2), min(m - 1, (m + int(size[b])) // 2)
            lo, hi = (int(np.searchsorted(upto, r, "right")) for r in (first, last))
            out += [(part["_g"].iloc[0], b, q, m, int(upto[lo - 1]) if lo else 0) for q in range(lo, hi + 1)]
        return pd.DataFrame(out, columns=["_g", "k", "v", "before", "below"])

    asked = written(cells.groupBy("_g").applyInPandas(wanted, "_g string, k long, v long, before long, below long"))
    dealt = asked.withColumnRenamed("k", "_for").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    sent = ranked.select("_g", "k", "v", "x", F.pmod("i", F.lit(PARTS)).cast("int").alias("_part")).join(dealt, ["_g", "v", "_part"]).where("k < _for")
    arriving = ranked.join(asked.groupBy("_g", "k").agg(F.first("before").alias("before"), F.first("below").alias("below")), ["_g", "k"], "left")
    both = arriving.select("_g", "k", "i", "x", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("below", F.lit(0)).alias("below")).unionByName(
        sent.select("_g", F.col("_for").alias("k"), F.lit(-1).cast("long").alias("i"), "x", "before", "below"))

    def medians(part: pd.DataFrame) -> pd.DataFrame:
        own = part["i"].to_numpy() >= 0
        mine = part[own].sort_values("i")
        found = prefix_medians_of(mine["x"].to_numpy(), part["x"].to_numpy()[~own], int(part["before"].iloc[0]), int(part["below"].iloc[0]))
        return pd.DataFrame({"_g": mine["_g"], "n": mine["i"] + 1, name: found})

    return both.groupBy("_g", "k").applyInPandas(medians, f"_g string, n long, `{name}` double")

"""Density clustering per group: a grid join and label propagation, or one numpy pass per group of checked size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DBSCAN_EPS_M, DBSCAN_MIN_POINTS
from .aggregate import local_metres, weighted
from .scratch import release, written

#: Groups up to this many points are clustered in one task each; larger ones take the grid. Up to SMALL a table of all distances serves.
GROUP_LIMIT, SMALL = 5000, 512
_NONE = np.iinfo(np.int64).max


def labels_in_memory(x: np.ndarray, y: np.ndarray, order: np.ndarray, eps: float, least: int, small: int = SMALL) -> np.ndarray:
    """Labels of one group: the smallest ``order`` of the cluster's core points, -1 for noise.

    A point counts itself; a border point takes the smallest label among its core neighbours. Groups above ``small`` points are
    clustered by cells, whose points are all neighbours, in memory linear in the points.
    """
    if len(x) > small:
        return _labels_by_cells(np.stack([x, y], axis=1), order, eps, least)
    near = (x[:, None] - x[None, :]) ** 2 + (y[:, None] - y[None, :]) ** 2 <= eps * eps
    core = near.sum(axis=1) >= least
    label = np.where(core, order, _NONE)
    links = near & core[None, :]
    while True:
        low = np.where(links, label[None, :], _NONE).min(axis=1, initial=_NONE)
        new = np.where(core, np.minimum(low, label), label)
        if (new == label).all():
            break
        label = new
    low = np.where(links, label[None, :], _NONE).min(axis=1, initial=_NONE)
    label = np.where(core, label, low)
    return np.where(label == _NONE, -1, label)


def _labels_by_cells(xy: np.ndarray, order: np.ndarray, eps: float, least: int) -> np.ndarray:
    cells, of = np.unique(np.floor(xy / (0.7071 * eps)).astype(np.int64), axis=0, return_inverse=True)
    of = of.ravel()
    sizes = np.bincount(of)
    members = np.split(np.argsort(of, kind="stable"), np.cumsum(sizes)[:-1])
    at = {(int(i), int(j)): k for k, (i, j) in enumerate(cells)}
    around = [[k for i in range(-2, 3) for j in range(-2, 3) if (k := at.get((a + i, b + j))) is not None] for a, b in cells.tolist()]
    core = sizes[of] >= least

    def near(these: np.ndarray, those: np.ndarray):
        """(rows of ``these``, which of ``those`` are within eps), some rows at a time."""
        step = max(1, (1 << 20) // max(1, len(those)))
        for lo in range(0, len(these), step):
            some = these[lo : lo + step]
            yield some, ((xy[some][:, None] - xy[those][None, :]) ** 2).sum(axis=2) <= eps * eps

    for k in np.flatnonzero(sizes < least):
        for some, close in near(members[k], np.concatenate([members[m] for m in around[k]])):
            core[some] = close.sum(axis=1) >= least
    cores = [m[core[m]] for m in members]
    up = list(range(len(cells)))

    def root(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for k, mine in enumerate(cores):
        for m in around[k]:
            if m > k and len(mine) and len(cores[m]) and root(k) != root(m) and touch(xy[mine], xy[cores[m]], eps):
                up[root(m)] = root(k)
    lowest = np.full(len(cells), _NONE)
    for k, mine in enumerate(cores):
        if len(mine):
            lowest[root(k)] = min(lowest[root(k)], order[mine].min())
    label = np.full(len(xy), -1, dtype=np.int64)
    for k, mine in enumerate(cores):
        label[mine] = lowest[root(k)]
    for k, m in enumerate(members):
        loose, those = m[~core[m]], np.concatenate([cores[j] for j in around[k]])
        if len(loose) and len(those):
            for some, close in near(loose, those):
                low = np.where(close, label[those][None, :], _NONE).min(axis=1)
                label[some] = np.where(low == _NONE, -1, low)
    return label


def _by_group(points: DataFrame, by: str, order: str, eps: float, least: int, groups: int | None = None, together: int = 64) -> DataFrame:
    """About ``together`` groups, by hash, are one call into Python; each is clustered on its own."""
    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.LongType())])
    calls = max(1, -(-(points.select(by).distinct().count() if groups is None else groups) // together))

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        found = np.empty(len(pdf), dtype=np.int64)
        x, y, o = (pdf[c].to_numpy() for c in ("x_m", "y_m", order))
        for rows in pdf.groupby(by, dropna=False, sort=False).indices.values():
            found[rows] = labels_in_memory(x[rows], y[rows], o[rows], eps, least)
        return pdf.drop(columns="_call").assign(cluster=found)

    return points.withColumn("_call", F.pmod(F.hash(by), F.lit(calls))).groupBy("_call").applyInPandas(some, schema)


def touch(a: np.ndarray, b: np.ndarray, eps: float) -> bool:
    """Whether a point of ``a`` and one of ``b`` (n x 2) are within ``eps``: halves by median, decided by boxes where these suffice."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        (al, ah), (bl, bh) = (a.min(axis=0), a.max(axis=0)), (b.min(axis=0), b.max(axis=0))
        gap, far = np.maximum(np.maximum(bl - ah, al - bh), 0.0), np.maximum(ah - bl, bh - al)
        if (gap * gap).sum() > eps * eps:
            continue
        if (far * far).sum() <= eps * eps:
            return True
        if len(a) * len(b) <= 4096 or max((ah - al).max(), (bh - bl).max()) == 0:
            if (((a[:, None] - b[None, :]) ** 2).sum(axis=2) <= eps * eps).any():
                return True
            continue
        if (ah - al).max() < (bh - bl).max():
            a, b, al, ah = b, a, bl, bh
        k = int((ah - al).argmax())
        low = a[:, k] < (al[k] + ah[k]) / 2
        if not 0 < low.sum() < len(a):  # neighbouring doubles have no middle
            low = a[:, k] == al[k]
        todo += [(a[low], b), (a[~low], b)]
    return False


def components(nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """``by, a, label``: the smallest node that each node is linked with; ``links`` has both directions."""
    links = written(links.unionByName(nodes.select(by, "a", F.col("a").alias("b"))))
    label = written(nodes.select(by, "a", F.col("a").alias("label")))
    while True:
        spread = links.join(label.withColumnsRenamed({"a": "b", "label": "low"}), [by, "b"]).groupBy(by, "a").agg(F.min("low").alias("low"))
        # the label's own node has a label that is as good: halves the way of long chains
        jump = label.withColumnsRenamed({"a": "low", "label": "lower"})
        new = written(spread.join(jump, [by, "low"], "left").select(by, "a", F.least("low", "lower").alias("label")))
        same = new.join(label.withColumnRenamed("label", "was"), [by, "a"]).where("label <> was").isEmpty()
        release(label)
        label = new
        if same:
            release(links)
            return label


def _around(df: DataFrame, half: bool = False) -> DataFrame:
    """Rows once for each of the 5 x 5 cells about their own, ``cx, cy`` moved; ``half`` takes each pair of two cells once."""
    steps = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if not half or (i, j) > (0, 0)]
    moved = df.withColumn("_s", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps])))
    return moved.withColumns({"cx": F.col("cx") + F.col("_s.i"), "cy": F.col("cy") + F.col("_s.j")}).drop("_s")


def _by_grid(points: DataFrame, by: str, order: str, eps: float, least: int) -> DataFrame:
    """Cells so small that all their points are neighbours: pairs of points are made only for points in cells of fewer than ``least``.

    All points of a fuller cell are core points of one cluster, so clusters spread over cells, not points.
    Two cells are linked by their outermost core points; where these are too far apart and nothing else
    links the cells, all of their core points near each other are tested.
    """
    key, side, e2 = [by, "cx", "cy"], 0.7071 * eps, F.lit(eps * eps)
    cell = written(points.select(by, F.col(order).alias("id"), "x_m", "y_m", F.floor(F.col("x_m") / side).alias("cx"), F.floor(F.col("y_m") / side).alias("cy")))
    size = written(cell.groupBy(*key).agg(F.count("*").alias("n")))
    within = lambda ax, ay, bx, by_: (ax - bx) * (ax - bx) + (ay - by_) * (ay - by_) <= e2
    sparse = written(cell.join(size.where(F.col("n") < least).select(*key), key, "left_semi"))
    asks = lambda df: _around(df.select(by, F.col("id").alias("a"), F.col("x_m").alias("ax"), F.col("y_m").alias("ay"), "cx", "cy"))
    close = within(F.col("ax"), F.col("ay"), F.col("x_m"), F.col("y_m"))
    reach = _around(size).groupBy(*key).agg(F.sum("n").alias("r")).where(F.col("r") >= least)
    counted = asks(sparse.join(reach.select(*key), key, "left_semi")).join(cell, key).where(close).groupBy(by, "a").agg(F.count("*").alias("n"))
    lone = counted.where(F.col("n") >= least).select(by, F.col("a").alias("id"))
    core = written(cell.join(size.where(F.col("n") >= least).select(*key), key, "left_semi").unionByName(sparse.join(lone, [by, "id"], "left_semi")))
    border = written(sparse.join(core.select(by, "id"), [by, "id"], "left_anti"))

    x, y = F.col("x_m"), F.col("y_m")
    outer = F.array(*[f(F.struct("x_m", "y_m"), v) for v in (x, y, x + y, x - y) for f in (F.min_by, F.max_by)])
    cells = written(core.groupBy(*key).agg(F.min("id").alias("a"), F.min("x_m").alias("x0"), F.max("x_m").alias("x1"), F.min("y_m").alias("y0"), F.max("y_m").alias("y1"), outer.alias("outer")))
    other = cells.select(*key, *[F.col(c).alias(f"o_{c}") for c in ("a", "x0", "x1", "y0", "y1", "outer")])
    gap = lambda c: F.greatest(F.col(f"o_{c}0") - F.col(f"{c}1"), F.col(f"{c}0") - F.col(f"o_{c}1"), F.lit(0.0))
    met = F.exists("outer", lambda p: F.exists("o_outer", lambda q: within(p["x_m"], p["y_m"], q["x_m"], q["y_m"])))
    near = written(
        _around(cells.withColumns({"ax": F.col("cx"), "ay": F.col("cy")}), half=True).join(other, key).where(gap("x") * gap("x") + gap("y") * gap("y") <= e2)
        .select(by, "a", F.col("o_a").alias("b"), F.col("ax").alias("acx"), F.col("ay").alias("acy"), F.col("cx").alias("bcx"), F.col("cy").alias("bcy"),
                *[c for o in ("", "o_") for c in (f"{o}x0", f"{o}x1", f"{o}y0", f"{o}y1")], met.alias("met")))
    both = lambda df: df.select(by, "a", "b").unionByName(df.select(by, F.col("b").alias("a"), F.col("a").alias("b")))
    label = components(cells.select(by, "a"), both(near.where("met")), by)
    la, lb = label.withColumnRenamed("label", "la"), label.withColumnsRenamed({"a": "b", "label": "lb"})
    apart = written(near.where("not met").join(la, [by, "a"]).join(lb, [by, "b"]).where("la <> lb"))
    if apart.limit(1).count():

        def part(own: str, box: str) -> DataFrame:
            dx, dy = (F.greatest(F.col(f"{box}{c}0") - F.col(f"{c}_m"), F.col(f"{c}_m") - F.col(f"{box}{c}1"), F.lit(0.0)) for c in "xy")
            at = apart.withColumnsRenamed({f"{own}cx": "cx", f"{own}cy": "cy"}).select(*key, "a", "b", *[f"{box}{c}" for c in ("x0", "x1", "y0", "y1")])
            return at.join(core.drop("id"), key).where(dx * dx + dy * dy <= e2).select(by, "a", "b", F.lit(own == "a").alias("first"), "x_m", "y_m")

        def test(pdf: pd.DataFrame) -> pd.DataFrame:
            xy, first = pdf[["x_m", "y_m"]].to_numpy(), pdf["first"].to_numpy()
            joined = first.any() and not first.all() and touch(xy[first], xy[~first], eps)
            return pdf[[by, "a", "b"]].head(1 if joined else 0)

        kinds = T.StructType([f for f in apart.select(by, "a", "b").schema.fields])
        more = part("a", "o_").unionByName(part("b", "")).groupBy(by, "a", "b").applyInPandas(test, kinds)
        label = components(cells.select(by, "a"), both(near.where("met").select(by, "a", "b").unionByName(more)), by)
    labelled = core.join(cells.select(*key, "a").join(label, [by, "a"]).select(*key, F.col("label").alias("cluster")), key)
    edge = asks(border).join(labelled, key).where(close).groupBy(by, "a").agg(F.min("cluster").alias("cluster"))
    found = labelled.select(by, F.col("id").alias(order), "cluster").unionByName(edge.withColumnRenamed("a", order))
    return points.join(found, [by, order], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-1)).cast("long"))


def dbscan(
    df: DataFrame, by: str = "flag_id", order: str = "frame_idx", eps: float = DBSCAN_EPS_M, least: int = DBSCAN_MIN_POINTS, method: str = "auto",
) -> DataFrame:
    """Add ``x_m, y_m, cluster`` to estimates (rows without one go); noise is -1.

    ``order`` is a long, unique in its group; a cluster's number is its smallest core ``order``. ``df`` is read a few times, so hand in
    something cheap to read. ``auto`` counts groups first: those up to ``GROUP_LIMIT`` points are one task's arrays each, larger ones take the grid.
    Both give the same labels.
    """
    points = local_metres(df.where("est_lat is not null and est_lon is not null"), [by])
    groups = None
    if method == "auto":
        sizes = df.groupBy(by).agg(F.count("*").alias("n"))
        most, fewest, groups = sizes.agg(F.max("n"), F.min("n"), F.count("*")).first()
        method = "groups" if (most or 0) <= GROUP_LIMIT else "grid" if fewest > GROUP_LIMIT else "both"
    if method == "both":
        large = written(sizes.where(F.col("n") > GROUP_LIMIT).select(F.col(by).alias("_large")))
        on = F.col(by).eqNullSafe(F.col("_large"))
        return _by_grid(written(points.join(large, on, "left_semi")), by, order, eps, least).unionByName(_by_group(points.join(large, on, "left_anti"), by, order, eps, least, groups))
    return _by_group(points, by, order, eps, least, groups) if method == "groups" else _by_grid(points, by, order, eps, least)


def clustered_position(
    df: DataFrame, by: str = "flag_id", order: str = "frame_idx", least_confidence: float = 0.4, least_frames: int = 10, **more,
) -> DataFrame:
    """Weighted mean of each group's largest cluster, the lowest number on a tie; of all points where none is a cluster.

    Estimates strictly above ``least_confidence`` count, and a group needs ``least_frames`` of them.
    """
    # six narrow columns, written once: sizes, centres, clusters and means all read them, and geometry runs once
    valid = written(
        df.where((F.col("confidence") > F.lit(least_confidence)) & F.col("est_lat").isNotNull() & F.col("est_lon").isNotNull())
        .select(by, order, "est_lat", "est_lon", "confidence")
    )
    enough = valid.groupBy(by).agg(F.count("*").alias("n_frames")).where(F.col("n_frames") >= least_frames)
    labelled = written(dbscan(valid.join(enough.select(by), by, "left_semi"), by, order, **more).select(by, "cluster", "est_lat", "est_lon", "confidence"))
    sizes = labelled.groupBy(by, "cluster").agg(F.count("*").alias("n_used"), weighted("est_lat").alias("lat"), weighted("est_lon").alias("lon"))
    everyone = labelled.groupBy(by).agg(F.max(F.col("cluster")).alias("_any"), weighted("est_lat").alias("_lat"), weighted("est_lon").alias("_lon"))
    best = sizes.where("cluster >= 0").groupBy(by).agg(F.max_by(F.struct("cluster", "n_used", "lat", "lon"), F.struct("n_used", -F.col("cluster"))).alias("b"))
    return (
        enough.join(everyone, by).join(best, by, "left")
        .select(by, F.coalesce("b.lat", "_lat").alias("lat"), F.coalesce("b.lon", "_lon").alias("lon"), "n_frames",
                F.coalesce("b.n_used", "n_frames").alias("n_used"), F.coalesce("b.cluster", F.lit(-1).cast("long")).alias("cluster"))
    )

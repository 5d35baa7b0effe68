"""Running medians against numpy, small and large groups."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from aerolith.operators.running import prefix_medians_of, running_medians


@pytest.mark.parametrize("seed", range(4))
def test_one_list(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, 300) / 4 if seed % 2 else rng.normal(size=301)
    want = [np.median(x[: k + 1]) for k in range(len(x))]
    assert np.array_equal(prefix_medians_of(x, np.zeros(0), 0, 0), want)
    for cut in (40, 150, 290):
        # all earlier values held, or only those that can be a median yet
        early = np.sort(x[:cut])
        size = len(x) - cut
        low, high = max(0, (cut - size - 1) // 2), min(cut, (cut + size) // 2 + 1)
        for below, held in ((0, early), (low, early[low:high])):
            assert np.array_equal(prefix_medians_of(x[cut:], held, cut, below), want[cut:])


def test_groups_of_any_size(spark):
    """Cut into buckets or not, with ties, nulls, a null group, and a value that is most of a group."""
    rng = np.random.default_rng(7)
    rows = []
    for g, n in (("a", 700), ("b", 3), (None, 260), ("c", 1)):
        for k in rng.permutation(n).tolist():
            rows.append((g, k, float(rng.integers(0, 9)) if g == "a" and k % 2 else 5.0 if g == "a" else float(rng.normal()), float(rng.normal())))
    rows += [("a", 9999, None, 1.0), ("d", 1, None, None)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double").repartition(5)
    for limit in (64, 1 << 14):
        got = {(r.g, r.n): (r.mx, r.my) for r in running_medians(df, ["g"], {"mx": "x", "my": "y"}, "k", limit).collect()}
        want = {}
        for g in ("a", "b", None, "c"):
            mine = sorted((r for r in rows if r[0] == g and r[2] is not None), key=lambda r: r[1])
            for n in range(1, len(mine) + 1):
                want[g, n] = tuple(np.median([r[c] for r in mine[:n]]) for c in (2, 3))
        assert got == want


def test_no_rows(spark):
    assert running_medians(spark.createDataFrame([], "g string, k int, x double"), ["g"], {"m": "x"}, "k").count() == 0


def test_a_group_of_a_million(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.lit(1).alias("g"), "id", (F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 7).alias("x"))
    start = time.perf_counter()
    out = running_medians(df, ["g"], {"m": "x"}, "id").where("n % 99991 = 0 or n = 1000000").collect()
    assert time.perf_counter() - start < 120
    x = np.array([r.x for r in df.orderBy("id").select("x").collect()])
    assert len(out) == 11 and all(r.m == np.median(x[: r.n]) for r in out)

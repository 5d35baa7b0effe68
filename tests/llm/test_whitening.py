"""Whitening against numpy's own eigenvectors and Python's whole numbers."""

import math

import numpy as np
import pytest

from aerolith.llm.queries import QUERIES
from aerolith.llm.whitening import deviations, leading, whiten

SCHEMA = "vec_id long, embedding array<float>"


def naive(rows, k=4):
    """(vec_id, component): n, deviation, projection up to sign, explained."""
    kept = [(i, [math.floor(256.0 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    d = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (d - len(x))) for i, x in kept]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array(fit, dtype=float) - np.array([s / n for s in sums])
    e, axes = np.linalg.eigh(a.T @ a / n)
    out = {}
    for i, x in kept:
        for c in range(min(k, d)):
            if e[-1 - c] > 1e-9 * e.sum():
                w = (np.array(x) - np.array([s / n for s in sums])) @ axes[:, -1 - c] / math.sqrt(e[-1 - c])
                out.setdefault((i, c + 1), []).append((n, sum((n * v - s) ** 2 for v, s in zip(x, sums)), w, e[-1 - c] / e.sum()))
    return out


def compare(found, want):
    assert len(found) == sum(map(len, want.values()))
    for c in {c for _, c in want}:
        rows = [r for r in found if r.component == c]
        sign = [np.sign(r.whitened) * np.sign(want[r.vec_id, c][0][2]) for r in rows if abs(r.whitened) > 1e-6]
        assert len(set(sign)) == 1
        for r in rows:
            n, dev, w, share = want[r.vec_id, c][0]
            assert (r.n, r.deviation) == (n, dev) and abs(r.whitened - sign[0] * w) < 1e-9 and abs(r.explained - share) < 1e-12 and r.identity_error < 1e-10


def test_query_on_all_vectors(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    compare(QUERIES["op11_whitening"](spark, sf).collect(), naive(rows))


def test_odd_rows(spark):
    """Null vectors, null and non-finite entries go; repeated vectors count once; short and empty ones end in zeros; clashing columns."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(size=5)]) for i in range(40)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [float("nan")] * 5), (103, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.5, -2.25]), (106, rows[0][1]), (107, rows[0][1])]
    table = spark.createDataFrame([(i, v, "a", 1, 2.0) for i, v in rows], SCHEMA + ", x string, component int, whitened double").repartition(5)
    compare(whiten(table).collect(), naive(rows))
    assert whiten(table.withColumnRenamed("vec_id", "x1").drop("x").withColumnRenamed("x1", "x"), id_col="x").where("x = 5").count() == 4


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    out = whiten(spark.createDataFrame(rows, SCHEMA))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_components_without_variance_are_left_out(spark):
    rows = [(i, [float(i), 2.0 * i, 7.0]) for i in range(9)]
    found = whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in found} == {1} and len(found) == 9
    compare(found, naive(rows))


def test_huge_entries(spark):
    """Beyond a long: entries are its ends, deviations null; nothing fails."""
    rows = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [3.0, -1.0])], "vec_id long, embedding array<double>")
    found = whiten(rows).collect()
    assert len(found) >= 3 and {r.n for r in found} == {3} and None in {r.deviation for r in found}


def test_deviations_are_exact():
    x = np.array([[10**9, -(10**9)], [3, 4]], dtype=np.int64)
    sums = [10**9 + 3, 4 - 10**9]
    assert deviations(x, 2, sums) == [e if e < 2**63 else None for e in (sum((2 * v - s) ** 2 for v, s in zip(r, sums)) for r in x.tolist())]
    assert deviations(x[1:], 1, [0, 0]) == [25]


def test_many_passes_reach_the_certificate():
    """A slowly falling spectrum far wider than the blocks that Rayleigh-Ritz holds."""
    d = 600
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    e = 1 / np.arange(1, d + 1) ** 0.7
    v = (q * e) @ q.T
    values, axes, passes = leading(lambda b: v @ b, d, 4)
    assert passes < 60 and np.abs(values - e[:4]).max() < 1e-12
    assert np.abs(np.abs((q[:, :4] * axes).sum(axis=0)) - 1).max() < 1e-12


def test_result_does_not_depend_on_partitioning(spark, sf):
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = ({(r.vec_id, r.component): (r.n, r.deviation, abs(r.whitened)) for r in whiten(t.repartition(p)).collect()} for p in (1, 9))
    assert a.keys() == b.keys() and all(a[k][:2] == b[k][:2] and abs(a[k][2] - b[k][2]) < 1e-10 for k in a)

"""Whitening of embeddings: leading components by matrix-free block subspace iteration, each pass one Spark job over the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Vectors in a block, blocks that Rayleigh-Ritz looks at before it starts anew from the best, entries of one piece of a batch.
BLOCK, BLOCKS, PIECE = 16, 8, 1 << 18
_LOW = 32


def _pieces(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of the batches, and their column ``x`` as a matrix of whole numbers."""
    step = max(1, PIECE // d)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, part.column(part.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows, and the exact sum of each entry of ``x``, in halves of 32 bits so that no partial sum overflows."""

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _pieces(batches, d):
            n += len(x)
            high += (x >> _LOW).sum(axis=0)
            low += (x & ((1 << _LOW) - 1)).sum(axis=0)
        yield pa.record_batch([pa.array(range(d), pa.int32()), pa.array(high), pa.array(low), pa.array([n] * d, pa.int64())], names=["i", "high", "low", "n"])

    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    found = rows.select("x").mapInArrow(halves, "i int, high long, low long, n long").groupBy("i").agg(whole("high"), whole("low"), whole("n")).orderBy("i").collect()
    return int(found[0]["n"]), [(int(r["high"]) << _LOW) + int(r["low"]) for r in found]


def summed(rows: DataFrame, d: int, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of ``kernel`` (from a piece of rows to a matrix of ``shape``): by task, then by matrix row in Spark."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in _pieces(batches, d):
            total += kernel(x)
        yield pa.record_batch([pa.array(range(shape[0]), pa.int32()), *map(pa.array, total.T)], names=["i", *(f"z{j}" for j in range(shape[1]))])

    sums = [F.sum(f"z{j}").alias(f"z{j}") for j in range(shape[1])]
    found = rows.select("x").mapInArrow(parts, "i int, " + ", ".join(f"z{j} double" for j in range(shape[1]))).groupBy("i").agg(*sums).orderBy("i").collect()
    return np.array([r[1:] for r in found])


def _orthonormal(block: np.ndarray, beside: np.ndarray, scale: float) -> np.ndarray:
    """Orthonormal columns of ``block`` without what ``beside`` spans; columns of which nothing above round-off remains go."""
    for _ in range(2):
        block = block - beside @ (beside.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > scale]
        scale = 0.5
    return block


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, blocks: int = BLOCKS, tolerance: float = 1e-13, most: int = 500, seed: int = 11) -> tuple[np.ndarray, np.ndarray, int]:
    """Eigenvalues (falling), unit eigenvectors and passes: the ``k`` leading ones of the symmetric matrix that ``product`` multiplies by.

    Each pass multiplies one block of orthonormal vectors. Rayleigh-Ritz takes this block with the ones before it, up to ``blocks``; then
    it goes on from the best block alone. The next block is the QR of the Ritz vectors' residuals. It ends when the residuals of all ``k``
    are at most ``tolerance`` times the largest eigenvalue, or when nothing is left to multiply, as the blocks span all the matrix reaches.
    """
    k, block = min(k, d), min(max(block, k), d)
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, block)))[0]
    for done in range(1, most + 1):
        basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        h = basis.T @ image
        w, u = np.linalg.eigh((h + h.T) / 2)
        w, u = w[::-1][:block], u[:, ::-1][:, :block]
        ritz, turned = basis @ u, image @ u
        rest = turned - ritz * w
        top = max(abs(w[0]), np.finfo(float).tiny)
        if np.linalg.norm(rest[:, :k], axis=0).max() <= tolerance * top:
            return w[:k], ritz[:, :k], done
        if basis.shape[1] + block > blocks * block:
            basis, image = ritz, turned
        new = _orthonormal(rest, basis, 1e-15 * top)[:, : d - basis.shape[1]]
        if not new.shape[1]:
            return w[:k], ritz[:, :k], done
    raise ArithmeticError(f"no certificate for {k} components after {most} passes")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 4, scale: int = 256, block: int = BLOCK) -> DataFrame:
    """A row for every vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    A vector counts as x, its entries times ``scale`` rounded down. Components are the ``k`` leading unit eigenvectors of the covariance of the
    distinct x (divisor n, their number), found by :func:`leading`; ``whitened`` is x less the mean, projected on the component, over the root of
    its eigenvalue; ``explained`` the eigenvalue's share of the trace; ``deviation`` the exact sum of (n x - sum)^2 over the entries;
    ``identity_error`` how far the whitened distinct vectors' covariance, measured in a pass of its own, is from the identity.

    Rows whose vector is null or holds a null or non-finite entry are left out. Shorter vectors, empty ones too, count as ending in zeros.
    Repeated vectors count once in the fit and are rows each. Entries beyond a long count as its largest or smallest value, and a deviation
    beyond a long is null. Components without variance are left out, so one distinct vector, or none, gives no rows; ties between eigenvalues give
    any basis. Other columns are not read, whatever their names. A pass sends d x ``block`` sums to the driver, never rows.
    """
    out = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = F.col("v")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)
    kind = kept.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    named = lambda df: df.select(F.col("_id").alias(id_col), *out)
    d = kept.agg(F.max(F.size("v"))).first()[0] or 0
    if not d:
        return named(vectors.sparkSession.createDataFrame([], schema))
    whole = F.transform(x, lambda e: F.floor(e * F.lit(float(scale))).cast("long"))
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size(x))
    rows = kept.select("_id", F.when(F.size(x) < d, F.concat(whole, zeros)).otherwise(whole).alias("x"))
    fit = materialize(rows.select("x").distinct())
    n, sums = exact_sums(fit, d)
    mean = np.array([s / n for s in sums])
    product = lambda q: summed(fit, d, lambda x: (c := x - mean).T @ (c @ q), (d, q.shape[1])) / n
    trace = summed(fit, d, lambda x: np.array([[np.square(x - mean).sum()]]), (1, 1))[0, 0] / n
    values, axes, _ = leading(product, d, k, block) if trace > 0 else (np.zeros(0), np.zeros((d, 0)), 0)
    axes, values = axes[:, values > 1e-12 * trace], values[values > 1e-12 * trace]
    if not len(values):
        release(fit)
        return named(vectors.sparkSession.createDataFrame([], schema))
    turn = axes / np.sqrt(values)
    moments = summed(fit, d, lambda x: (w := np.hstack([(x - mean) @ turn, np.ones((len(x), 1))])).T @ w, (len(values) + 1, len(values) + 1)) / n
    release(fit)
    centre = moments[:-1, -1]
    off = float(np.abs(moments[:-1, :-1] - np.outer(centre, centre) - np.eye(len(values))).max())
    share = (values / trace).tolist()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = len(share)
        for part, x in _pieces(batches, d):
            at = np.repeat(np.arange(len(x)), m)
            yield pa.record_batch([
                part.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(len(at), n, np.int64)),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(at)), pa.array(((x - mean) @ turn).ravel()), pa.array(np.tile(share, len(x))), pa.array(np.full(len(at), off)),
            ], names=["_id", *out])

    return named(rows.mapInArrow(project, schema))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the exact sum over its entries of (n x - sum)^2; null beyond a long."""
    widest = n * int(max(-int(x.min(initial=0)), int(x.max(initial=0)))) + max(map(abs, sums), default=0)
    if widest * widest * x.shape[1] < 1 << 63:
        return np.square(n * x - np.array(sums, dtype=np.int64)).sum(axis=1).tolist()
    exact = [sum((n * e - s) ** 2 for e, s in zip(r, sums)) for r in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]

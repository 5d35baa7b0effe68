"""Packing into optimal length buckets: dynamic programming over the global length histogram."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dense_index, materialize, word_count

#: Lengths up to this are told apart one by one; above, those of one of this many steps an octave are one cell.
EXACT, STEPS = 1 << 14, 1 << 12


def length_cell(length):
    """A cell of lengths (a Column), by its upper end: the length itself up to EXACT, then rounded up to 1/STEPS of its octave."""
    octave = F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")))
    step = F.greatest(F.pow(F.lit(2.0), octave) / STEPS, F.lit(1.0)).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step) * step).cast("long")


def optimal_boundaries(bounds: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total of count * (end - own length).

    ``bounds`` ascend. The own lengths' sum is a constant, so the cost of a bucket over cells i..j is
    bounds[j] * count(i..j). That cost is Monge, so the best start never moves left as j grows and each
    layer is filled by divide and conquer: O(buckets * cells * log cells). Ties take the leftmost start.
    """
    m = len(bounds)
    if m == 0:
        return []
    buckets = min(buckets, m)
    before = np.concatenate([[0], np.cumsum(counts, dtype=np.float64)])
    best = np.concatenate([[0.0], bounds * before[1:]])  # one bucket over the first j cells
    choice = [np.zeros(m + 1, dtype=np.int64)]
    for _ in range(1, buckets):
        nxt, pick = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=np.int64)
        nxt[0] = 0.0
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(a, min(b, j - 1) + 1)
            cost = best[i] + bounds[j - 1] * (before[j] - before[i])
            k = int(np.argmin(cost))
            nxt[j], pick[j] = cost[k], i[k]
            todo += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = nxt
        choice.append(pick)
    ends, j = [], m
    for layer in range(buckets - 1, -1, -1):
        if j == 0:
            break
        ends.append(int(bounds[j - 1]))
        j = int(choice[layer][j])
    return sorted(set(ends))


def pack(
    docs: DataFrame, id_col: str = "doc_id", length=None, buckets: int = 8, token_budget: int = 65536, carry: dict | None = None,
) -> DataFrame:
    """Every row in a padded batch: ``id_col, length, bucket, bucket_len, batch, slot`` and ``carry``'s columns.

    ``length`` is a Column over ``docs`` (default: words of ``text``; give tokens where a batch is to hold at most so many tokens).
    The histogram counts every row; the driver sees a count and the largest length of each cell, of which there are at most
    EXACT plus STEPS an octave. Boundaries are lengths of rows and minimise total padding; longer than EXACT, only the largest length
    of a cell can be one, which pads a row by at most 1 / STEPS of its length more than the best boundaries would.
    Batches of a bucket hold floor(token_budget / bucket_len) rows, at
    least one; a row longer than the budget is a batch of its own and is not cut. ``batch`` is gapless from
    0 in its bucket, ``slot`` from 0 in its batch; nothing orders a bucket in one task.

    Null or empty texts have length 0 and the bucket that covers it; very long texts are measured whole; repeated rows, and rows
    with equal or null ids, take slots of their own; an empty table gives no rows; columns that neither ``length`` nor ``carry``
    names are not read, whatever their names.
    """
    length = word_count(F.col("text")) if length is None else length
    rows = materialize(docs.select(
        F.col(id_col).alias("_id"), F.coalesce(length, F.lit(0)).cast("long").alias("length"),
        *[e.alias(f"_c_{n}") for n, e in (carry or {}).items()],
    ))
    hist = sorted((r[1], r[2]) for r in rows.groupBy(length_cell(F.col("length")).alias("b")).agg(F.max("length"), F.count("*")).collect())
    ends = optimal_boundaries(np.array([b for b, _ in hist], dtype=np.float64), np.array([n for _, n in hist]), buckets) or [0]
    bucket = F.lit(len(ends) - 1)
    for k in range(len(ends) - 2, -1, -1):
        bucket = F.when(F.col("length") <= ends[k], F.lit(k)).otherwise(bucket)
    held = [max(1, token_budget // max(e, 1)) for e in ends]
    at = lambda xs: F.element_at(F.array(*[F.lit(x).cast("long") for x in xs]), F.col("bucket") + 1)
    numbered = dense_index(rows.withColumn("bucket", bucket), sum(n for _, n in hist), "bucket", ["_id", "length"], "_n")
    return numbered.select(
        F.col("_id").alias(id_col), "length", "bucket", at(ends).alias("bucket_len"),
        F.floor(F.col("_n") / at(held)).cast("long").alias("batch"), F.pmod("_n", at(held)).alias("slot"),
        *[F.col(f"_c_{n}").alias(n) for n in carry or {}],
    )

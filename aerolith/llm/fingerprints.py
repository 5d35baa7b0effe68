"""Document fingerprints: a threshold-scaled sketch, which keeps every shingle hash below a fixed fraction; small sets stay whole."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .textkernel import U, shingle_sets

#: A hash stays if it is below 2**64 * FRACTION; sets of at most WHOLE hashes stay whole.
FRACTION = 1 / 2
WHOLE = 64
_EVERY = 1 << 64


def sketch(hashes: np.ndarray, fraction: float = FRACTION, whole: int = WHOLE) -> tuple[np.ndarray, int]:
    """Kept hashes of a sorted distinct set, and the limit below which they are complete."""
    if len(hashes) <= whole:
        return hashes, _EVERY
    limit = int(_EVERY * fraction)
    return hashes[: np.searchsorted(hashes, U(limit))], limit


def to_text(kept: np.ndarray, limit: int) -> str:
    return ("c" if limit == _EVERY else "p") + base64.b64encode(kept.astype("<u8").tobytes()).decode()


def from_text(fingerprint: str, fraction: float = FRACTION) -> tuple[np.ndarray, int]:
    kept = np.frombuffer(base64.b64decode(fingerprint[1:]), dtype="<u8").astype(U)
    if fingerprint[0] == "c":
        return kept, _EVERY
    return kept, int(_EVERY * fraction)


def _common(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> tuple[int, int, int]:
    limit = min(a[1], b[1])
    x, y = (k if limit == _EVERY else k[: np.searchsorted(k, U(limit))] for k, _ in (a, b))
    return len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated Jaccard similarity: both sketches cut to the smaller limit. Two sets without shingles are alike (1)."""
    both, n, m = _common(a, b)
    if n + m - both:
        return both / (n + m - both)
    return 1.0 if a[1] == b[1] == _EVERY else 0.0


def containment(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Estimated share of a's shingles that b has, however much longer b is. An empty set is contained (1)."""
    both, n, _ = _common(a, b)
    return both / n if n else 1.0 if a[1] == _EVERY else 0.0


def merge(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int], fraction: float = FRACTION, whole: int = WHOLE) -> tuple[np.ndarray, int]:
    """The sketch of the union, from the two sketches alone."""
    limit = min(a[1], b[1])
    every = np.union1d(*(k if limit == _EVERY else k[: np.searchsorted(k, U(limit))] for k, _ in (a, b)))
    return sketch(every, fraction, whole) if limit == _EVERY else (every, limit)


#: Rows of a range of documents on average, ranges at most, and keys picked for each of them, so that ranges are about even.
RANGE_ROWS, RANGES, FINE = 1024, 1 << 14, 8


def _starts(ids: DataFrame) -> np.ndarray:
    """The first keys of the ranges in the order of documents, one line each: whether the id is null, its complement, the text hash.

    Each is a key of the table, the table's first among them; the others are every FINE-th in order of keys picked by hash.
    """
    key = lambda df: sorted((r[0] is None, ~(r[0] or 0), r[1]) for r in df.collect())
    ids = materialize(ids.select("doc_id", "th"))  # texts are hashed once
    rows = ids.count()
    every = max(1, max(RANGE_ROWS, -(-rows // RANGES)) // FINE)
    picked = ids.where(F.pmod(F.xxhash64("doc_id", "th", F.lit(3)), F.lit(every)) == 0).distinct()
    first = ids.orderBy(F.col("doc_id").desc_nulls_last(), "th").limit(1)
    found = np.array(sorted({*key(first), *key(picked)[FINE - 1 :: FINE]}), dtype=np.int64).reshape(-1, 3)
    release(ids)
    return found


def _range_of(starts: np.ndarray, null: np.ndarray, ids: np.ndarray, th: np.ndarray) -> np.ndarray:
    """For each row twice the number of its range, and one more if its key begins it."""
    own = np.stack([null.astype(np.int64), ~np.where(null, 0, ids), th], axis=1)
    both = np.concatenate([starts, own])
    order = np.lexsort((np.arange(len(both)) >= len(starts), both[:, 2], both[:, 1], both[:, 0]))
    place = np.cumsum(order < len(starts)) - 1
    found = np.empty(len(both), dtype=np.int64)
    found[order] = place
    found = found[len(starts) :]
    return 2 * found + (starts[found] == own).all(axis=1)


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stream rows by (range, extra, id descending); every row waits for its next one, whose text edits it."""
    waiting = None  # (id, text) of the row before, and the first row of its range
    first = None
    at, closed = None, False
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def done(pairs: list) -> pa.RecordBatch:
        sets = [sketch(s) for s in shingle_sets(pa.array([own for (_, own), _ in pairs] + [nxt for _, (_, nxt) in pairs], pa.large_string()))]
        edits = [own[: len(own) - len(own) // 3] + nxt[: len(own) // 3] for (_, own), (_, nxt) in pairs]
        changed = [sketch(s) for s in shingle_sets(pa.array(edits, pa.large_string()))]
        k = len(pairs)
        return pa.record_batch([
            pa.array([i for (i, _), _ in pairs], pa.int64()), pa.array([len(t) for (_, t), _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string()),
            pa.array([to_text(*s) for s in sets[:k]], pa.string()), pa.array([to_text(*s) for s in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(sets[:k], changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(sets[:k], sets[k:])], pa.float64()),
        ], names=names)

    ready, held = [], 0
    for batch in batches:
        for ident, text, span, extra in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "span", "extra"))):
            row = (ident, text or "")
            if span != at:
                if waiting is not None:  # a range without a row from the next one: it wraps around to itself
                    ready.append((waiting, first))
                at, closed, waiting, first = span, False, None, row
            if closed:
                continue
            if waiting is not None:
                ready.append((waiting, row))
                held += len(row[1])
            waiting, closed = (None, True) if extra else (row, False)
            if held > 2 << 20 or len(ready) > 2048:
                yield done(ready)
                ready, held = [], 0
    if waiting is not None:
        ready.append((waiting, first))
    if ready:
        yield done(ready)


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every row and of its edited text, with their likeness and that to the next document.

    The edited text has the last third (code points, rounded down) replaced by as much of the beginning of
    the next document in descending id, the first one after the last. Columns: ``id_col, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    Texts move once, into ranges of documents in order of id and text hash, which begin with documents of the table; a range's
    first row is also sent to the range before it, so a sorted stream of each range sees every row's successor. An id on
    very many texts is many ranges. A task holds two texts and one output batch.

    Null texts count as empty; null ids come after all others, in order of their texts' hashes, as do rows
    of equal id among themselves; repeated rows are successors of one another and in one range; a single row is its own
    successor; very long texts are read whole; an empty table gives no rows; other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    starts = _starts(ids)
    n = max(1, len(starts))
    marks = spark.sparkContext.broadcast(starts)

    @F.pandas_udf("long")
    def spans(null: pd.Series, ident: pd.Series, th: pd.Series) -> pd.Series:
        return pd.Series(_range_of(marks.value, null.to_numpy(dtype=bool), ident.to_numpy(dtype=np.int64), th.to_numpy(dtype=np.int64)))

    at = lambda span, extra: F.struct(span.alias("span"), F.lit(extra).alias("extra"))
    own = F.floor(F.col("_at") / 2).cast("long")
    places = F.when(F.col("_at") % 2 == 1, F.array(at(own, 0), at(F.pmod(own - 1, F.lit(n)), 1))).otherwise(F.array(at(own, 0)))
    dealt = (
        # no nulls reach Python, where they would make ids doubles
        ids.withColumn("_at", spans(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "th")).withColumn("_to", F.explode(places)).select("doc_id", "text", "th", "_to.span", "_to.extra")
        .repartition("span").sortWithinPartitions("span", "extra", F.col("doc_id").desc_nulls_last(), "th").drop("th")
    )
    out = dealt.mapInArrow(_paired, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumnRenamed("doc_id", id_col)

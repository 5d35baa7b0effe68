"""Quality classifier: supervised subword embeddings (hashed words and byte n-grams), trained by numpy SGD."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, release, small_or_not
from .textkernel import U, buffers, slices, word_hashes, words

#: Rows of the embedding table for each kind of feature: words, byte 3-grams, byte 4-grams, word pairs.
BITS = 16
KINDS = 4
#: Bytes of all bags that the fit, which is one task, may hold.
FIT_BYTES = 512 << 20


def _features(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind: bucket of every feature in order, row offsets into them, and a mask of those inside one row.

    N-grams run over all bytes of a text, white space included, so they see the edges of words. A pair of
    neighbouring words is hashed by the exclusive or of their hashes, so a word repeated is one bucket, whichever word it is.
    """
    buf, off = buffers(texts)
    starts, stops, first = words(buf, off)
    hashes = word_hashes(buf, starts, stops)
    out = [((hashes >> U(64 - BITS)).astype(np.int32), first, None)]
    pairs = ((hashes[1:] ^ hashes[:-1]) >> U(64 - BITS)).astype(np.int32) + np.int32(3 << BITS)
    inside = np.ones(len(pairs), dtype=bool)
    at = first[1:] - 1
    inside[at[(at >= 0) & (at < len(pairs))]] = False
    out.append((pairs, np.minimum(first, len(pairs)), inside))
    wide = buf.astype(np.uint32)
    for n in (3, 4):
        m = max(0, len(wide) - n + 1)
        code = np.zeros(m, dtype=np.uint32)
        for k in range(n):
            code |= wide[k : k + m] << np.uint32(8 * k)
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        inside = np.ones(m, dtype=bool)
        for k in range(1, n):  # windows that begin in the last n - 1 bytes of a row reach into the next one
            at = off[1:] - k
            inside[at[(at >= 0) & (at < m)]] = False
        out.append((code.astype(np.int32) + np.int32((n - 2) << BITS), np.minimum(off, m), inside))
    return out


@dataclass
class QualityModel:
    """Embedding table and softmax weights; ``lean`` is each bucket's part of the logit of label 1, the same for ``bias``."""

    table: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    @property
    def lean(self) -> np.ndarray:
        return (self.table @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32)

    @property
    def bias(self) -> float:
        return float(self.intercept[1] - self.intercept[0])


def bags(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of every text its distinct buckets and the share of its features that each has."""
    out = []
    for k in range(len(texts)):  # one by one: the features of one text are all that is held
        parts = [idx if inside is None else idx[inside] for idx, _, inside in _features(texts.slice(k, 1))]
        ids, n = np.unique(np.concatenate(parts), return_counts=True)
        out.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
    return out


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], dim: int = 8, epochs: int = 6, rate: float = 0.5, seed: int = 11) -> QualityModel | None:
    """SGD over documents in a seeded order; the hidden vector is the mean of a document's feature vectors.

    Without both labels there is nothing to learn and the result is None.
    """
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / dim, 1 / dim, (KINDS << BITS, dim)).astype(np.float32)
    weights, intercept = np.zeros((dim, 2), dtype=np.float32), np.zeros(2, dtype=np.float32)
    y = np.asarray(labels)
    balance = len(y) / (2.0 * np.bincount(y, minlength=2))
    step, total = 0, epochs * len(bags)
    for _ in range(epochs):
        for d in rng.permutation(len(bags)):
            lr = rate * (1 - step / total)
            step += 1
            ids, share = bags[d]
            if not len(ids):
                continue
            hidden = share @ table[ids]
            z = hidden @ weights + intercept
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[d]] -= 1.0
            p *= balance[y[d]]
            back = weights @ p
            weights -= lr * np.outer(hidden, p)
            intercept -= lr * 0.01 * p
            # rows of the table are scaled by share, so they learn at a rate that doesn't fall with length
            table[ids] -= lr * 20 * np.sqrt(share / share.max())[:, None] * share.max() * back
    return QualityModel(table, weights, intercept)


def _bag_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            made = bags(part.column("text"))
            yield pa.record_batch([
                part.column("doc_id").cast(pa.string()), part.column("quality").cast(pa.int32()),
                pa.array([i.tobytes() for i, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary()),
            ], names=["doc_id", "quality", "ids", "share"])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model of all bags as one row: each bucket's lean, and the bias; no row where there is nothing to learn."""
    rows = [(r["doc_id"], r["quality"], np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)) for b in batches for r in b.to_pylist()]
    rows.sort(key=lambda r: r[0])
    model = train([(i, s) for _, _, i, s in rows], [q for _, q, _, _ in rows])
    if model is not None:
        yield pa.record_batch([pa.array([model.lean.tobytes()], pa.binary()), pa.array([model.bias])], names=["lean", "bias"])


def score_texts(texts: pa.Array, lean: np.ndarray, bias: float, known: bool) -> np.ndarray:
    """Probability of label 1 for each text: the softmax of two classes on the mean of its features' leans."""
    rows = len(texts)
    total, count = np.zeros(rows), np.zeros(rows)
    for idx, off, inside in _features(texts) if known else []:
        w = lean[idx]
        if inside is not None:
            w[~inside] = 0
        some = np.flatnonzero(off[1:] > off[:-1])
        if len(some):
            total[some] += np.add.reduceat(w, off[:-1][some], dtype=np.float64)
            count[some] += off[1:][some] - off[:-1][some] if inside is None else np.add.reduceat(inside, off[:-1][some], dtype=np.int64)
    z = np.where(count > 0, total / np.maximum(count, 1), 0.0) + bias
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _scores(batches: Iterator[pa.RecordBatch], lean: np.ndarray, bias: float, known: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            columns = {n: part.column(n) for n in part.schema.names if n != "text"}
            score = pa.array(score_texts(part.column("text"), lean, bias, known))
            yield pa.record_batch([*columns.values(), score], names=[*columns, "score"])


def _passed(batches: Iterator[pa.RecordBatch], text: str, lean: np.ndarray, bias: float, known: bool, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, text):
            yield part.filter(pa.array(score_texts(part.column(text), lean, bias, known) >= threshold))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows_per_label: int, learn: Column, seed: int = 5) -> DataFrame:
    """``doc_id, text, quality`` of at most ``rows_per_label`` documents of each label, those with the smallest seeded hash of the id.

    A document labelled twice keeps its larger label; of an id with several texts the one of the smallest hash counts; labels other
    than 0 and 1 and null ids are left out. Texts are whole, however long.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & learn).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    order = [F.xxhash64("doc_id", F.lit(seed)), F.col("doc_id")]
    some = None
    for q in (0, 1):
        part = marks.where(F.col("quality") == q).orderBy(*order).limit(rows_per_label)
        some = part if some is None else some.unionByName(part)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(small_or_not(some, 24), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("quality").alias("quality"))


def within_bytes(made: DataFrame, fit_bytes: int) -> DataFrame:
    """Of the bags, which are few, those of each label whose sizes sum up to half of ``fit_bytes``, in the order of their texts' ids by hash."""
    size = F.octet_length("ids") + F.octet_length("share")
    upto = Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id")  # at most rows_per_label rows of a few bytes
    held = made.select("doc_id", "quality", size.cast("long").alias("size")).withColumn("upto", F.sum("size").over(upto))
    return made.join(small_or_not(held.where(F.col("upto") <= fit_bytes // 2).select("doc_id"), 32), "doc_id", "left_semi")


def _learnt(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, learn: Column | None, rows_per_label: int, fit_bytes: int = FIT_BYTES):
    """The model, learnt in one task from at most 2 * ``rows_per_label`` bags of features, which other tasks make of the texts.

    A bag has at most 2^18 buckets (2 MiB), whatever its text's length, and all bags of the task ``fit_bytes`` at most. The driver gets one number a bucket.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sample = labelled_sample(named, labels, rows_per_label, F.lit(True) if learn is None else learn)
    made = materialize(sample.mapInArrow(_bag_rows, "doc_id string, quality int, ids binary, share binary"))
    model = within_bytes(made, fit_bytes).repartition(1).mapInArrow(_fitted, "lean binary, bias double").collect()
    release(made)
    lean = np.frombuffer(model[0]["lean"], np.float32) if model else np.zeros(1, np.float32)
    return docs.sparkSession.sparkContext.broadcast(lean), model[0]["bias"] if model else 0.0, bool(model)


def keep_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_per_label: int = 1500, threshold: float = 0.5,
) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all columns, whatever their names; learns and scores as :func:`quality_scores`."""
    lean, bias, known = _learnt(docs, labels, id_col, text_col, None, rows_per_label)
    return docs.mapInArrow(lambda it: _passed(it, text_col, lean.value, bias, known, threshold), docs.schema)


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: Column | None = None,
    rows_per_label: int = 1500, threshold: float = 0.5, keep: list[str] | None = None,
) -> DataFrame:
    """Every row's ``score`` (0 to 1, higher: label 1 likelier) and ``predicted``, with ``id_col`` and the columns of ``keep``.

    The model learns from a bounded sample of the labelled rows for which ``learn`` (over ``labels``) holds:
    ``rows_per_label`` is that bound, and ``FIT_BYTES`` bounds the bags of the sample. It sees texts only. Since the hidden vector is a mean, the logit is a
    mean of one number for each bucket; executors get that table (1 MiB, whatever the corpus) and score whole texts.

    Null and empty texts get the model's score of no features; very long texts are scored whole, one being the least a task
    holds; without both labels every score is 0.5; ids and labels that come twice: see ``labelled_sample``;
    repeated rows are scored each; an empty table gives no rows; clashing names don't matter, as only named columns are read.
    """
    lean, bias, known = _learnt(docs, labels, id_col, text_col, learn, rows_per_label)
    own = [id_col, *(keep or [])]
    kept = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(own)], F.col(text_col).alias("text"))
    types = {f.name: f.dataType.simpleString() for f in kept.schema if f.name != "text"}
    schema = ", ".join(f"{n} {t}" for n, t in types.items()) + ", score double"
    found = kept.mapInArrow(lambda it: _scores(it, lean.value, bias, known), schema)
    return found.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(own)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

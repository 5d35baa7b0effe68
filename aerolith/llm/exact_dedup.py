"""Exact dedup by progressive refinement: length, then prefix hash, then full hash of survivors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize, small_or_not, strip_white_space, text_or_empty


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256, carry: dict | None = None
) -> DataFrame:
    """One row per input row: ``id_col, keep_id, group_size, kept`` plus the columns of ``carry``.

    Texts are equal when identical without white space. The row with the longest original text stays,
    then the smallest id. ``carry`` maps names to expressions over ``docs`` which ride along.

    1. One scan notes each row's normalised length and the hash of its first ``prefix_chars`` characters.
    2. Lengths, then (length, prefix hash) pairs, that occur once leave: such rows are alone.
    3. Only rows of surviving pairs are read again for their SHA-256; equal digests form the groups.

    Defined cases: a null text counts as empty, and all empty texts are one group; repeated rows (same id
    and text) form a group of which one row is kept; null ids sort last; very long texts are compared by length, prefix
    and SHA-256 of the whole; an empty table gives no rows; other columns of ``docs`` are ignored, whatever their names.
    Hot groups: group sizes come from partial aggregates, and the join back is an equi-join that AQE may split.
    """
    norm = strip_white_space(text_or_empty(text_col))
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.char_length(text_or_empty(text_col)).cast("long").alias("_cp"),
        F.octet_length(norm).cast("long").alias("_len"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("_pre"),
        *[e.alias(f"_c_{n}") for n, e in (carry or {}).items()],
        norm.alias("_norm"),
    )
    notes = materialize(base.drop("_norm"))
    lengths = notes.groupBy("_len").count().where("count > 1").select("_len")
    pairs = (
        notes.join(small_or_not(lengths, 16), "_len", "left_semi")
        .groupBy("_len", "_pre").count().where("count > 1").select("_len", "_pre")
    )
    pairs = small_or_not(materialize(pairs), 24)
    alone = notes.join(pairs, ["_len", "_pre"], "left_anti")
    again = materialize(
        base.join(pairs, ["_len", "_pre"], "left_semi")
        .select("*", F.sha2("_norm", 256).alias("_sha")).drop("_norm")
        .withColumn("_row", F.monotonically_increasing_id())
    )
    rank = F.struct((-F.col("_cp")).alias("a"), F.col("_id").isNull().alias("b"), F.col("_id").alias("c"), F.col("_row").alias("d"))
    # written before the join, so that the join has an exchange of its own on both sides, which AQE can split
    groups = materialize(again.groupBy("_sha").agg(F.min(rank).alias("_best"), F.count("*").alias("_n")))
    carried = [f"_c_{n}" for n in carry or {}]
    grouped = again.join(groups, "_sha").select(
        "_id", F.col("_best.c").alias("keep_id"), F.col("_n").alias("group_size"),
        (F.col("_best.d") == F.col("_row")).alias("kept"), *carried,
    )
    single = alone.select("_id", F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *carried)
    out = single.unionByName(grouped)
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", "kept", *[F.col(f"_c_{n}").alias(n) for n in carry or {}]
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept.

    The cases are those of :func:`exact_duplicates`; very long texts are hashed whole. How rows leave: see ``keep_rows``.
    """
    found = materialize(exact_duplicates(docs, id_col, text_col, carry={"text_hash": F.xxhash64(text_or_empty(text_col))}))
    return keep_rows(docs, found.where("group_size > 1").withColumnRenamed(id_col, "id"), id_col, text_col)

"""Shared pieces of the training-data operators: row numbering, joins by size, rows kept by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.scratch import release, settled, written

#: Fixed value: the six ASCII white-space characters of every contract here, space and 0x09 to 0x0D.
WHITE_SPACE = " \t\n\x0b\x0c\r"
#: A side of a join is broadcast only when its counted rows times its row width stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows of a bin of :func:`dense_index`, and how many times that makes a bin too large for one task.
BIN_ROWS, HOT = 4096, 16

__all__ = ["BROADCAST_BYTES", "WHITE_SPACE", "dense_index", "free_names", "keep_rows", "materialize", "release", "same_keys", "settled", "small_or_not",
           "strip_white_space", "text_or_empty", "word_count"]
materialize = written


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def strip_white_space(text: Column) -> Column:
    """Delete every character of ``WHITE_SPACE``; chained byte-wise replaces are cheaper than a regex."""
    for ch in WHITE_SPACE:
        text = F.replace(text, F.lit(ch), F.lit(""))
    return text


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside ``WHITE_SPACE``; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def small_or_not(df: DataFrame, row_bytes: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted rows fit ``BROADCAST_BYTES``; else a shuffled join follows."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def keep_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows that ``found`` (``id, text_hash, kept``, a row for each row in question) gives up.

    A row is named by its id and the hash of its whole text, so one of several texts under one id can go alone. Of rows
    equal in both one stays if ``kept``, any of them if other columns differ. Keys that go leave by an anti join, so
    texts are shuffled only when these keys are too many to broadcast. All columns stay, whatever their names.
    """
    keys = materialize(
        found.groupBy("id", "text_hash").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).where(~F.col("stays") | (F.col("rows") > 1))
    )
    th, kid, kth = free_names(docs, "_hash", "_key_id", "_key_hash")
    marked = docs.withColumn(th, F.xxhash64(text_or_empty(text_col)))
    on = F.col(id_col).eqNullSafe(F.col(kid)) & (F.col(th) == F.col(kth))
    named = lambda df: small_or_not(df.select(F.col("id").alias(kid), F.col("text_hash").alias(kth)), 32)
    out = marked.join(named(keys), on, "left_anti")
    repeated = keys.where("stays")
    if not repeated.isEmpty():
        out = out.unionByName(marked.join(named(repeated), on, "left_semi").dropDuplicates([id_col, th]))
    return out.drop(th)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & a[k].eqNullSafe(b[k])
    return cond


def dense_index(df: DataFrame, rows: int, group: str, order: list[str], name: str = "slot") -> DataFrame:
    """Gapless numbers from 0 in every ``group`` (a non-null column), never ordering a group in one task.

    ``order`` columns decide a hash bin; rows are numbered inside (group, bin) and shifted by the counts of
    the group's earlier bins. ``rows`` is the table's row count, from which the number of bins follows
    (at most 16384, so the table of counts stays small). Rows equal in all ``order`` columns are
    interchangeable; where so many are equal that a bin holds ``HOT`` times its share, the bin is cut by where its rows
    were read. ``df`` is read a few times, so hand in something cheap to read.
    """
    bins = max(1, min(-(-rows // BIN_ROWS), 16384))
    df = df.withColumn("_bin", F.pmod(F.xxhash64(*order), F.lit(bins)))
    most = HOT * max(BIN_ROWS, -(-rows // bins))
    large = df.groupBy(group, "_bin").agg(F.count("*").alias("_cuts")).where(F.col("_cuts") > most)
    large = materialize(large.withColumn("_cuts", F.ceil(F.col("_cuts") / BIN_ROWS)))  # at most rows / most of them
    if large.isEmpty():
        df = df.withColumn("_cut", F.lit(0).cast("long"))
    else:
        cut = F.coalesce(F.pmod(F.xxhash64("_at"), F.col("_cuts")), F.lit(0)).cast("long")
        placed = df.withColumn("_at", F.monotonically_increasing_id()).join(small_or_not(large, 64), [group, "_bin"], "left").withColumn("_cut", cut)
        df = materialize(placed.drop("_at", "_cuts"))  # as what is read twice must be cut alike
    before = Window.partitionBy(group).orderBy("_bin", "_cut").rowsBetween(Window.unboundedPreceding, -1)
    shift = (
        df.groupBy(group, "_bin", "_cut").agg(F.count("*").alias("_n"))
        .select(group, "_bin", "_cut", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    )
    inside = Window.partitionBy(group, "_bin", "_cut").orderBy(*order)
    return (
        df.withColumn("_r", F.row_number().over(inside) - 1)
        .join(shift, [group, "_bin", "_cut"])
        .withColumn(name, (F.col("_shift") + F.col("_r")).cast("long"))
        .drop("_bin", "_cut", "_r", "_shift")
    )

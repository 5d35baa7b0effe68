"""The corpus pipeline: quality, exact and near duplicates, mixing, packing. Each stage works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith import ship
from aerolith.llm.common import free_names, keep_rows, materialize, release, settled, small_or_not, text_or_empty
from aerolith.llm.exact_dedup import drop_exact_duplicates
from aerolith.llm.mixing import mix_sources
from aerolith.llm.ngram_join import jaccard_components
from aerolith.llm.packing import pack
from aerolith.llm.quality import keep_quality


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by ``labels``, doesn't reject; columns as they come, whatever their names.

    Null and empty texts get the score of no features; repeated rows are judged alike; texts of any length are read whole.
    """
    ship(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space: the longest, then the smallest id, nulls last.

    Null and empty texts are one group; repeated rows are one document; columns stay as they are, whatever their names.
    """
    return drop_exact_duplicates(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked documents: the smallest id, null ids last, then the smallest text hash.

    Rows are dropped by id and text, so of one id on unlike texts only the linked one goes, and rows without an id are
    treated alike. Documents without words (null and empty texts too) link with nothing and stay, each of them. Repeated rows
    are one document. Texts of any length are compared whole; columns stay as they are, whatever their names.
    """
    ship(spark)
    linked = lambda: jaccard_components(docs).where("component_class is not null")
    rows = settled(lambda: linked().select(F.col("doc_id").alias("id"), "text_hash", "component_class"))
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "text_hash"))
    best = materialize(rows.groupBy("component_class").agg(first.alias("best"), F.count("*").alias("rows")).where("rows > 1"))
    found = rows.join(best, "component_class").select("id", "text_hash", (F.col("id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"))
    return keep_rows(docs, found, "doc_id", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: taken words over own words, rounded; 0, 1 or 2 times.

    The words of rows of one id (null is one) and text count together, and these rows come equally often. Documents without words
    (null and empty texts too) take no part in a mix of words and go. Texts of any length count whole; columns stay as they are, whatever their names.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    key, their, mine, often, turn = free_names(docs, "_id", "_their_hash", "_hash", "_times", "_turn")
    mix = lambda: mix_sources(docs, carry={"th": F.xxhash64(text_or_empty())}).groupBy("doc_id", "th").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    chosen = settled(lambda: mix().select(F.col("doc_id").alias(key), F.col("th").alias(their), times.alias(often)).where(F.col(often) > 0))
    hashed = docs.withColumn(mine, F.xxhash64(text_or_empty()))
    mixed = hashed.join(small_or_not(chosen, 32), F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(mine) == F.col(their)))
    return mixed.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document in a padded batch; see ``pack``.

    Null and empty texts have length 0; repeated rows take places of their own; other columns are not read.
    """
    return pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_dedup_stage),
    ("n-gram Jaccard join", near_dedup_stage),
    ("source mixing", mixing_stage),
    ("length packing", packing_stage),
]

#: SQL can't express the classifier's training nor the boundaries' dynamic programming; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)

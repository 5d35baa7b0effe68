"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty, word_count

#: Weights dealt to the sources in code point order, share of all words in the mix, most repeats.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows that copies of one row are counted in, so that a row which is most of the table is many rows.
PARTS = 1024


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words dealt by weight, no target above ``most`` times its source.

    Resharing the excess until none is above has a closed form: order sources by size / weight; source k
    stops exactly if most * size / weight is at most (what remains) / (weight that remains) there.
    There is one row per source, so the windows without a key see a short table.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    table = by_source.withColumn("w", w).withColumn("cap", F.col("source_size").cast("double") * most)
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    table = (
        table.withColumn("rest", F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("rest_w", F.sum("w").over(onward))
        .withColumn("rate", F.col("rest") / F.col("rest_w"))
        .withColumn("stops", F.col("cap") <= F.col("w") * F.col("rate"))
    )
    rate = F.min_by("rate", F.struct("stops", F.col("cap") / F.col("w"))).over(every)  # of the first source that doesn't stop
    return table.select("source", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("w") * rate).alias("target"))


def sainte_lague(cells: DataFrame, votes: str, seats: Column, within: list[str], order: list[Column], name: str) -> DataFrame:
    """``seats`` (equal in each ``within`` group) dealt to the rows of ``cells`` by the highest quotients votes / (2k - 1).

    Rounding votes * (seats - n/2) / total gives at most ``seats`` seats and rounding votes * (seats + n/2) /
    total at least that many, with n rows in the group. So the first roundings are certain, and only the
    quotients between the two, about two a row, are ranked.
    """
    g = Window.partitionBy(*within)
    v, total, n = F.col(votes).cast("double"), F.sum(F.col(votes).cast("double")).over(g), F.count("*").over(g)
    part = lambda s: F.when(total > 0, F.greatest(F.floor(v * F.greatest(s, F.lit(0.0)) / total + 0.5), F.lit(0))).otherwise(F.lit(0))
    bounds = (
        cells.withColumn("_seats", seats.cast("long"))
        .withColumn("_sure", part(F.col("_seats") - n / 2).cast("long"))
        .withColumn("_upto", part(F.col("_seats") + n / 2).cast("long"))
        .withColumn("_left", F.col("_seats") - F.sum("_sure").over(g))
    )
    quotient = F.col(votes) / (F.col("_k") * 2 - 1)
    key = [c for c in cells.columns]
    more = F.when(F.col("_upto") > F.col("_sure"), F.sequence(F.col("_sure") + 1, F.col("_upto"))).otherwise(F.array(F.lit(0).cast("long")))
    dealt = (
        bounds.withColumn("_k", F.explode(more))
        .withColumn("_rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.col("_k") == 0, quotient.desc(), *order, F.col("_k"))))
        .withColumn("_won", ((F.col("_k") > 0) & (F.col("_rank") <= F.col("_left"))).cast("long"))
    )
    return dealt.groupBy(*key, "_sure").agg(F.sum("_won").alias("_w")).withColumn(name, F.col("_sure") + F.col("_w")).drop("_sure", "_w")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17,
    shard_words: int = 1 << 16, weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, carry: dict | None = None,
) -> DataFrame:
    """How many words the mix takes of every document: ``id_col, size, source_size, target, taken``, ``source`` and ``carry``'s columns.

    Documents fall into seeded shards, of about ``shard_words`` words at least and 65536 shards at most, by a
    hash of id and text. Words of one source in one shard, in seeded order, are cut into blocks of equal size.
    Blocks are apportioned to sources by target and inside each source to shards by words, both by the
    highest quotients; a quota takes every block as often as it goes whole into the shard's blocks, and
    one more run of blocks from a seeded start, around the shard's end. ``taken`` is what these blocks cut of a document.

    Null texts have size 0 and nothing taken; the null source is a source of its own, sorted last; repeated
    rows are rows of their own, next to each other in their shard; words of texts of any length are counted whole; an empty table gives
    no rows; other columns of ``docs`` are not read, whatever their names. A hot source has cells in all shards, and a row that is
    repeated very often is a few rows with a number of copies until the end, so no task orders more than a shard's different rows.
    Reruns agree: what rows of one id and text take together, and each of them, does not depend on partitioning.
    """
    read = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("source"), F.xxhash64(text_or_empty(text_col)).alias("_th"), word_count(F.col(text_col)).alias("size"),
        *[e.alias(f"_c_{n}") for n, e in (carry or {}).items()], F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).alias("_part"),
    )
    # copies of one row, in PARTS rows at most, which are interchangeable
    sizes = materialize(read.groupBy(*read.columns).agg(F.count("*").alias("_copies")).withColumn("_words", F.col("size") * F.col("_copies")))
    total = sizes.agg(F.sum("_words")).first()[0] or 0
    shard = max(shard_words, -(-total // 65536))
    n_shards, block = max(1, -(-total // shard)), max(1, min(shard >> 10, total >> 20))
    dealt = sizes.withColumns({
        "_src": F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")),
        "_shard": F.pmod(F.xxhash64(F.col("_id"), F.col("_th"), F.col("size"), F.lit(seed)), F.lit(n_shards)),
    })
    targets = source_targets(sizes.select("source", F.col("_words").alias("size")), weights, share, most).withColumn("_src", F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s"))).drop("source")
    seats = sainte_lague(targets, "target", F.round(F.sum("target").over(Window.partitionBy()) / block), [], [F.col("_src")], "_source_blocks")
    cells = dealt.groupBy("_src", "_shard").agg(F.sum("_words").alias("_words")).join(seats, "_src")
    cells = sainte_lague(cells, "_words", F.col("_source_blocks"), ["_src"], [F.col("_shard")], "_quota")
    blocks = F.greatest(F.ceil(F.col("_words") / block), F.lit(1))
    quota = F.least(F.col("_quota"), blocks * most)
    cells = materialize(cells.select(
        "_src", "_shard", "_words", "source_size", "target",
        F.floor(quota / blocks).alias("_whole"), F.pmod(quota, blocks).alias("_run"), blocks.alias("_blocks"),
        F.pmod(F.xxhash64("_src", "_shard", F.lit(seed + 1)), blocks).alias("_start"),
    ))
    upto = Window.partitionBy("_src", "_shard").orderBy(F.xxhash64("_id", "_th", F.lit(seed + 2)), "_id", "_th", "size", "_part").rowsBetween(Window.unboundedPreceding, 0)
    first = dealt.withColumn("_lo", F.sum("_words").over(upto) - F.col("_words")).drop("_words")
    lines = first.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).withColumn("_hi", F.col("_lo") + F.col("_copy") * F.col("size")).withColumn("_lo", F.col("_hi") - F.col("size"))
    overlap = lambda a, b: F.greatest(F.least(F.col("_hi"), b) - F.greatest(F.col("_lo"), a), F.lit(0))
    a, b, end = F.col("_start") * block, (F.col("_start") + F.col("_run")) * block, F.col("_blocks") * block
    taken = F.col("size") * F.col("_whole") + overlap(a, F.least(b, end)) + overlap(F.lit(0), F.greatest(b - end, F.lit(0)))
    return lines.join(cells, ["_src", "_shard"]).select(
        F.col("_id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        *[F.col(f"_c_{n}").alias(n) for n in carry or {}],
    )

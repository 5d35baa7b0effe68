"""Merkle manifest of a table: levels of runs hashed into parents, and for every row the siblings on its way up to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import ordered_index
from .common import materialize

#: Children of a node.
FANOUT = 8


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value, so that joined values can't be taken for others."""
    s = value.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_hash(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the encoded values, one after the other."""
    return F.sha2(F.concat(*map(encoded, values)).cast("binary"), 256)


def parent_hash(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children).cast("binary"), 256)


def climb(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``nodes`` (``g, i, n, h``) and the top of each ``g``: ``g, depth, h``.

    A level has a row ``g, i, n, kids, h`` for each run of ``fanout`` consecutive nodes (the last run can be shorter) of a group that still
    has several; a group with one node is done. Only the number of levels is counted on the driver.
    """
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, []
    pick = lambda df, d: df.where("n = 1").select("g", F.lit(d).alias("depth"), "h")
    tops = pick(nodes, 0)
    while most > 1:
        run = F.floor(F.col("i") / fanout).cast("long")
        kids = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda x: x["h"])
        runs = nodes.where("n > 1").groupBy("g", run.alias("i")).agg(F.ceil(F.first("n") / fanout).cast("long").alias("n"), kids.alias("kids"))
        nodes = materialize(runs.withColumn("h", parent_hash(F.col("kids"))))
        levels.append(nodes)
        tops = tops.unionByName(pick(nodes, len(levels)))
        most = -(-most // fanout)
    return levels, tops


def _step(kids: Column, place: Column) -> Column:
    """What stands to the left and to the right of a child, as joined digests."""
    return F.struct(F.concat_ws("", F.slice(kids, F.lit(1), place)).alias("left"), F.concat_ws("", F.slice(kids, place + 2, F.size(kids))).alias("right"))


def siblings(levels: list[DataFrame], tops: DataFrame, rows: DataFrame, fanout: int) -> DataFrame:
    """``rows`` (``g, i``, ...) with ``path``, the siblings of each level from the row up, and the columns of ``tops`` (``g, depth, path``, ...).

    Paths are made from the tops down, a join for each level: siblings shared by all rows under a node are made once for that node, so a
    level moves a row for each of its runs, and the rows of the table are moved once, for the last level.
    """
    more = [c for c in tops.columns if c not in ("g", "depth", "path")]
    at = lambda d: tops.where(F.col("depth") == d).select("g", F.lit(0).cast("long").alias("i"), "path", *more)
    under = lambda df: F.concat(F.array(_step(F.col("kids"), F.col("_place"))), "path")
    none = F.array().cast("array<string>")
    last, here = at(0).withColumn("kids", none), None
    for d in range(len(levels), 0, -1):
        here = at(d) if here is None else here.unionByName(at(d))
        met = levels[d - 1].select("g", "i", "kids").join(here, ["g", "i"])
        if d == 1:
            last = last.unionByName(met)
        else:
            each = met.select("g", "i", "kids", "path", *more, F.posexplode("kids").alias("_place", "_h"))
            here = each.select("g", (F.col("i") * fanout + F.col("_place")).alias("i"), under(each).alias("path"), *more)
    last = last.withColumnRenamed("i", "_run")
    joined = rows.withColumns({"_run": F.floor(F.col("i") / fanout).cast("long"), "_place": F.pmod("i", F.lit(fanout)).cast("int")}).join(last, ["g", "_run"])
    return joined.withColumn("path", F.when(F.size("kids") > 0, under(joined)).otherwise(F.col("path"))).drop("_run", "_place", "kids")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make."""
    return F.aggregate(path, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]).cast("binary"), 256))


def proof_hash(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    return parent_hash(F.transform(path, lambda s: F.concat(s["left"], s["right"])))


def merkle_manifest(
    docs: DataFrame, columns: tuple = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group_col: str = "lang",
    fanout: int = FANOUT, carry: dict[str, Column] | None = None,
) -> DataFrame:
    """A row for every row of ``docs``: ``id_col, leaf, subroot, root, path`` and the columns of ``carry`` (names other than these).

    A leaf is the hash of ``columns``. Leaves of a group ascend by id; runs of ``fanout`` become parents until one node, the subroot, is
    left; subroots in the order of their groups become the root likewise. ``path`` has for each level, from the leaf up, the joined digests
    left and right of the way, so :func:`folded` gives the root again. Texts are hashed in the scan; only digests are shuffled.

    Nulls in any column are values of their own: a null id comes first, null groups are one group, the first. Rows of one id follow by
    leaf; repeated rows are leaves each, with equal columns but for ``path``, which may go to any of them. Empty texts differ from null
    ones, very long texts are hashed whole. An empty table gives no rows; other columns are not read, whatever their names.
    """
    g = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # keeps the order, null first
    own = {f"_c_{k}": c for k, c in (carry or {}).items()}
    leaves = docs.select(g.alias("g"), F.col(id_col).alias("_id"), leaf_hash(*map(F.col, columns)).alias("h"), *[c.alias(k) for k, c in own.items()])
    rows = ordered_index(leaves, "g", ["_id", "h"])
    levels, subroots = climb(rows.select("g", "i", "n", "h"), fanout)
    groups = ordered_index(subroots.select(F.lit("").alias("g"), F.col("g").alias("of"), "depth", F.col("h")), "g", ["of"])
    above, root = climb(groups.select("g", "i", "n", "h"), fanout)
    empty = F.array().cast("array<struct<left:string,right:string>>")
    tops = root.select("g", "depth", empty.alias("path"), F.col("h").alias("root"))
    of_groups = siblings(above, tops, groups.withColumnRenamed("depth", "_depth"), fanout)
    tops = materialize(of_groups.select(F.col("of").alias("g"), F.col("_depth").alias("depth"), "path", F.col("h").alias("subroot"), "root"))
    out = siblings(levels, tops, rows, fanout)
    return out.select(F.col("_id").alias(id_col), F.col("h").alias("leaf"), "subroot", "root", "path", *[F.col(k).alias(k[3:]) for k in own])

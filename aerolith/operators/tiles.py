"""Detection on overlapping tiles of large frames, and greedy merging of the boxes that the tiles find twice."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FRAME_HEIGHT, FRAME_WIDTH
from .detect import run_detector
from .scratch import release, written

# Fixed values of the tiled detector: tile size in pixels, overlap of neighbours, share of the smaller box that makes two boxes one.
TILE, OVERLAP, SAME = 512, 0.2, 0.5
#: Pixels of a cell in which boxes meet.
CELL = 64.0
TILE_BOX = "frame_idx long, left long, top long, x1 double, y1 double, x2 double, y2 double, confidence double"
_SIDES = ("x1", "y1", "x2", "y2")
#: What a round makes of a box, the least over its cells.
_OPEN, _KEPT, _ALONE = range(3)


def tile_starts(length: int, tile: int = TILE, overlap: float = OVERLAP) -> list[int]:
    """Where tiles begin along a side; the last one is moved back to end with the frame."""
    step = tile - int(overlap * tile)
    out, at = [0], 0
    while at + tile < length:
        at = min(at + step, length - tile)
        out.append(at)
    return out


def with_tiles(frames: DataFrame, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT, tile: int = TILE, overlap: float = OVERLAP) -> DataFrame:
    """A row for every frame and tile: ``left, top, right, bottom`` in pixels."""
    whole = lambda *v: [F.lit(x).cast("long") for x in v]
    tiles = [F.struct(*[c.alias(n) for c, n in zip(whole(x, y, min(x + tile, width), min(y + tile, height)), ("left", "top", "right", "bottom"))])
             for y in tile_starts(height, tile, overlap) for x in tile_starts(width, tile, overlap)]
    return frames.withColumn("_tile", F.explode(F.array(*tiles))).select(*frames.columns, "_tile.*")


def detect_tiled(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], least_confidence: float = 0.5, **tiling) -> DataFrame:
    """Merged boxes ``frame_idx, x1, y1, x2, y2, confidence, parts`` of ``detect``, which sees tiles (frame columns, ``left, top, right, bottom``)
    and gives rows of ``TILE_BOX`` in the tile's pixels."""
    found = run_detector(with_tiles(frames, **tiling), detect, TILE_BOX).where(F.col("confidence") >= F.lit(least_confidence))
    moved = {s: F.col(s) + F.col("left" if s[0] == "x" else "top") for s in _SIDES}
    return merge_boxes(found.withColumns(moved).drop("left", "top"))


def overlap_share(a: Callable[[str], Column], b: Callable[[str], Column], of_smaller: bool) -> Column:
    """Intersection of two boxes over the smaller one's area, or over their union."""
    side = lambda p, q: F.greatest(F.least(a(q), b(q)) - F.greatest(a(p), b(p)), F.lit(0.0))
    area = lambda c: (c("x2") - c("x1")) * (c("y2") - c("y1"))
    both = side("x1", "x2") * side("y1", "y2")
    whole = F.least(area(a), area(b)) if of_smaller else area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def _cells(df: DataFrame, cell: float) -> DataFrame:
    """A row for every cell that a box ``r`` lies in."""
    span = lambda p, q: F.explode(F.sequence(F.floor(F.col(f"r.{p}") / F.lit(cell)).cast("long"), F.floor(F.col(f"r.{q}") / F.lit(cell)).cast("long")))
    return df.withColumn("_cx", span("x1", "x2")).withColumn("_cy", span("y1", "y2"))


def merge_boxes(boxes: DataFrame, by: str = "frame_idx", same: float = SAME, of_smaller: bool = True, cell: float = CELL) -> DataFrame:
    """Greedy merging inside each frame: ``by, x1, y1, x2, y2, confidence, parts``.

    In order of confidence (then of coordinates) a box that overlaps none of those kept before by at least ``same`` is kept; any other goes to
    the first kept box that it overlaps so. A kept box grows around what went to it; ``parts`` counts boxes. Boxes meet in cells of the frame,
    never all pairs: in a round a box is kept if it is the first of all its cells, and undecided ones that it overlaps are done with.
    A round decides at least the first box of each frame, in practice all but chains of boxes that each overlap the next; each round is written,
    parted by what became of the boxes, and later steps read only those they need. Boxes with no other in their cells are done with the first round.
    Equal boxes are one with the best confidence; rows with a null in place or confidence are left out; a frame with most boxes is many cells.
    """
    rank = F.struct((-F.col("confidence")).alias("c"), *_SIDES)
    rows = boxes.select(by, *[F.col(s).cast("double").alias(s) for s in _SIDES], F.col("confidence").cast("double").alias("confidence")).dropna()
    rows = rows.groupBy(by, *_SIDES).agg(F.max("confidence").alias("confidence"), F.count("*").alias("parts"))
    open_ = written(rows.select(by, rank.alias("r"), "parts"))
    key, place = [by, "r", "parts"], [by, "_cx", "_cy"]
    whole = lambda df: df.select(by, *[F.col(f"r.{s}").alias(s) for s in _SIDES], (-F.col("r.c")).alias("confidence"), "parts")
    tops = lambda df: _cells(df, cell).select(*place, F.col("r").alias("top"))
    near = overlap_share(lambda s: F.col(f"r.{s}"), lambda s: F.col(f"top.{s}"), of_smaller) >= F.lit(same)
    alone = kept = gone = None
    while alone is None or not open_.isEmpty():
        in_cells = _cells(open_, cell)
        first = in_cells.groupBy(*place).agg(F.min("r").alias("top"), F.count("*").alias("_n"))
        # first in all its cells, and alone in them; only in the first round are all boxes there
        state = F.when(F.col("r") != F.col("top"), _OPEN).when((F.col("_n") > 1) | F.lit(alone is not None), _KEPT).otherwise(_ALONE)
        decided = written(in_cells.join(first, place).groupBy(*key).agg(F.min(state).alias("_state")), "_state")
        now = {s: decided.where(F.col("_state") == s).drop("_state") for s in (_OPEN, _KEPT, _ALONE)}
        # a cell has one of those kept now at most
        meet = _cells(now[_OPEN], cell).join(tops(now[_KEPT]), place, "left")
        left = written(meet.groupBy(*key).agg(F.bool_or(F.col("top").isNotNull() & near).alias("_gone")), "_gone")
        release(open_)
        alone = now[_ALONE] if alone is None else alone
        kept = now[_KEPT] if kept is None else kept.unionByName(now[_KEPT])
        done, open_ = left.where("_gone").drop("_gone"), left.where("not _gone").drop("_gone")
        gone = done if gone is None else gone.unionByName(done)
    owner = _cells(gone, cell).join(tops(kept), place).where(near).groupBy(*key).agg(F.min("top").alias("owner"))
    owner = owner.unionByName(kept.withColumn("owner", F.col("r")))
    grown = owner.groupBy(by, "owner").agg(
        *[F.min(f"r.{s}").alias(s) for s in _SIDES[:2]], *[F.max(f"r.{s}").alias(s) for s in _SIDES[2:]], F.sum("parts").cast("long").alias("parts"))
    return grown.select(by, *_SIDES, (-F.col("owner.c")).alias("confidence"), "parts").unionByName(whole(alone))

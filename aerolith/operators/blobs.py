"""Colour blobs of frames as sparse pixel tables: mask, closing and opening and labels in tiles of bits, moments."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import FRAME_HEIGHT, FRAME_WIDTH
from .dbscan import components
from .scratch import release, written

# Fixed values of the colour detector: ranges of hue, saturation and value for red, on both ends of the hue circle, and the 5 x 5
# ellipse as columns (dx, dy).
RANGES = (((0, 120, 70), (10, 255, 255)), ((170, 120, 70), (180, 255, 255)))
ELLIPSE = ((0, -2), *((dx, dy) for dy in (-1, 0, 1) for dx in (-2, -1, 0, 1, 2)), (0, 2))
#: Pixels of a tile's side.
TILE = 64
#: Pixels of a block's side: its 64 pixels are the bits of a long, a row of them a byte.
BLOCK = 8
#: Rows of blocks that are read before whole tiles of them are worked on, and bytes of the tiles that are one numpy array.
ROWS, ARRAY_BYTES = 1 << 15, 1 << 20
#: Where a tile's part meets the line between two tiles: ``down`` the line number ``line`` from top to bottom or else from left to right, beside
#: the tile ``at`` along it, from ``low`` to ``high``; ``after`` the line, or before.
_RUN = pa.struct([("down", pa.bool_()), ("line", pa.int64()), ("at", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("after", pa.bool_())])
_KEY = ("_by", "tx", "ty")


def in_colour(h: Column, s: Column, v: Column, ranges: tuple = RANGES) -> Column:
    """Whether a pixel lies in one of the ranges, ends included."""
    hit = F.lit(False)
    for low, high in ranges:
        inside = F.lit(True)
        for c, a, b in zip((h, s, v), low, high):
            inside = inside & (c >= F.lit(a)) & (c <= F.lit(b))
        hit = hit | inside
    return F.coalesce(hit, F.lit(False))


def _blocks(pixels: int) -> int:
    return max(1, -(-pixels // BLOCK))


def _tiles(pixels: DataFrame, by: str, side: int, rim: int = 0, frame: tuple[int, int] | None = None) -> DataFrame:
    """``_by, tx, ty, place, bits``: the blocks of all tiles of ``side`` x ``side`` blocks and ``rim`` blocks around, each tile's rows on end.

    Pixels become bits before they are shuffled, so a frame has at most as many rows as blocks however often its pixels are repeated.
    """
    placed = pixels.select(F.col(by).alias("_by"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).dropna()
    if frame:
        placed = placed.where(F.col("x").between(0, frame[0] - 1) & F.col("y").between(0, frame[1] - 1))
    bit = F.bit_or(F.expr("shiftleft(1L, int((y & 7) * 8 + (x & 7)))")).alias("bits")
    out = placed.groupBy("_by", F.expr("x >> 3").alias("bx"), F.expr("y >> 3").alias("by")).agg(bit)
    for tile, at, length in (("tx", "bx", 0), ("ty", "by", 1)):
        first, last = (F.floor((F.col(at) + r) / side).cast("long") for r in (-rim, rim))
        out = out.withColumn(tile, F.explode(F.sequence(first, last)) if rim else first)
        if frame:
            out = out.where(F.col(tile).between(0, (frame[length] - 1) // (side * BLOCK)))
    place = (F.col("by") - F.col("ty") * side + rim) * (side + 2 * rim) + F.col("bx") - F.col("tx") * side + rim
    return out.select(*_KEY, place.cast("int").alias("place"), "bits").repartition(*_KEY).sortWithinPartitions(*_KEY)


def _whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of whole tiles, and where each tile begins and the last one ends."""
    kept, rows = [], 0

    def begins(table: pa.Table) -> tuple[pa.RecordBatch, np.ndarray]:
        batch = pa.RecordBatch.from_arrays([c.combine_chunks() for c in table.columns], schema=table.schema)
        new = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in map(batch.column, _KEY)]
        return batch, np.concatenate([[0], np.flatnonzero(np.logical_or.reduce(new)) + 1])

    for batch in batches:
        kept, rows = [*kept, batch], rows + batch.num_rows
        if rows >= ROWS:
            table, at = begins(pa.Table.from_batches(kept))
            if len(at) > 1:
                yield table.slice(0, at[-1]), at
            kept = [table.slice(at[-1])]
            rows = kept[0].num_rows
    if rows:
        table, at = begins(pa.Table.from_batches(kept))
        yield table, np.append(at, table.num_rows)


def _grids(batches: Iterator[pa.RecordBatch], wide: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Some tiles of ``wide`` x ``wide`` blocks at a time: a row of each, and an array (tile, row, word of 64 pixels) whose lowest bits are leftmost."""
    words = -(-wide // 8)
    step = max(1, ARRAY_BYTES // (wide * BLOCK * words * 8))
    for rows, at in _whole_tiles(batches):
        place, bits = rows.column("place").to_numpy(), rows.column("bits").to_numpy().astype("<i8")
        tiles = rows.select(list(_KEY)).take(pa.array(at[:-1]))
        for lo in range(0, tiles.num_rows, step):
            part = tiles.slice(lo, step)
            mine = slice(at[lo], at[lo + part.num_rows])
            of = np.repeat(np.arange(part.num_rows), np.diff(at[lo : lo + part.num_rows + 1]))
            row, col = np.divmod(place[mine], wide)
            grid = np.zeros((part.num_rows, wide * BLOCK, words * 8), np.uint8)
            grid[of[:, None], row[:, None] * BLOCK + np.arange(BLOCK), col[:, None]] = bits[mine].view(np.uint8).reshape(-1, BLOCK)
            yield part, grid.view("<u8")


def _moved(grid: np.ndarray, dx: int) -> np.ndarray:
    """Each pixel is the one that was ``dx`` to its right; beyond the array there are none."""
    skip, bits = divmod(dx, 64)
    out, words = None, grid.shape[2]
    for off, shift, by in ((skip, np.right_shift, bits), (skip + 1, np.left_shift, 64 - bits)):
        if abs(off) < words and by < 64:
            moved = shift(grid, np.uint64(by))
            if off:
                moved = np.concatenate([moved[..., off:], np.zeros_like(moved[..., :off])] if off > 0 else [np.zeros_like(moved[..., off:]), moved[..., :off]], axis=2)
            out = moved if out is None else np.bitwise_or(out, moved, out=out)
    return np.zeros_like(grid) if out is None else out


def _dilated(grid: np.ndarray, kernel: tuple) -> np.ndarray:
    """Pixels with one of ``grid`` under the kernel."""
    lines, out, rows = {}, np.zeros_like(grid), grid.shape[1]
    for dy in {dy for _, dy in kernel if abs(dy) < rows}:
        dxs = frozenset(dx for dx, y in kernel if y == dy)
        if dxs not in lines:
            lines[dxs] = reduce(np.ndarray.__ior__, (_moved(grid, dx) for dx in dxs))
        out[:, max(0, -dy) : rows - max(0, dy)] |= lines[dxs][:, max(0, dy) : rows - max(0, -dy)]
    return out


def _eroded(grid: np.ndarray, kernel: tuple, inside: np.ndarray) -> np.ndarray:
    """Pixels with nothing but ``grid`` under the part of the kernel that lies in the frame."""
    return inside & ~_dilated(inside & ~grid, kernel) & (grid if (0, 0) in kernel else _dilated(grid, kernel))


def _inside(shape: tuple, left: np.ndarray, top: np.ndarray, frame: tuple[int, int]) -> np.ndarray:
    """The pixels of tiles that lie in the frame; ``left`` and ``top`` are those of the arrays."""
    xs, ys = left[:, None] + np.arange(shape[2] * 64), top[:, None] + np.arange(shape[1])
    cols = np.packbits((xs >= 0) & (xs < frame[0]), axis=1, bitorder="little").view("<u8")
    return np.where(((ys >= 0) & (ys < frame[1]))[:, :, None], cols[:, None, :], np.uint64(0))


class _Cleaning:
    """Closing and opening of tiles, exact inside of a rim as wide as the four steps reach."""

    def __init__(self, tile: int, frame: tuple[int, int] | None, kernel: tuple = ()) -> None:
        self.side, self.frame, self.kernel = _blocks(tile), frame, kernel
        self.rim = _blocks(4 * max((abs(d) for at in kernel for d in at), default=0)) if frame else 0

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        """Some tiles at a time: a row of each, lefts, tops and bytes (tile, row, 8 pixels) without the rim."""
        for part, grid in _grids(batches, self.side + 2 * self.rim):
            left, top = (part.column(c).to_numpy() * self.side * BLOCK for c in ("tx", "ty"))
            if self.frame:
                inside = _inside(grid.shape, left - self.rim * BLOCK, top - self.rim * BLOCK, self.frame)
                grid = _dilated(grid, self.kernel) & inside
                grid = _eroded(_eroded(grid, self.kernel, inside), self.kernel, inside)
                grid = _dilated(grid, self.kernel) & inside
            rim, side = self.rim, self.side
            yield part, left, top, grid.view(np.uint8)[:, rim * BLOCK : (rim + side) * BLOCK, rim : rim + side]

    def tiles(self, pixels: DataFrame, by: str) -> DataFrame:
        return _tiles(pixels, by, self.side, self.rim, self.frame)


def _pixels(grid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tile, row and column of the pixels of bytes (tile, row, 8 pixels), in this order."""
    flat = np.ascontiguousarray(grid).reshape(-1)
    some = np.flatnonzero(flat)
    which, bit = np.nonzero(np.unpackbits(flat[some][:, None], axis=1, bitorder="little"))
    row, x = np.divmod(some[which] * 8 + bit, grid.shape[2] * 8)
    return *np.divmod(row, grid.shape[1]), x


def close_and_open(pixels: DataFrame, by: str = "frame_idx", width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT, kernel: tuple = ELLIPSE, tile: int = TILE) -> DataFrame:
    """``pixels`` with gaps closed, then specks gone: ``by, x, y``. Repeated pixels are one; those outside of the frame and rows with a null are left out.

    Each tile is one array of bits with a rim as wide as the four steps reach, so a frame is many tasks and no step is shuffled.
    """
    clean = _Cleaning(tile, (width, height), kernel)
    kind = pixels.schema[by].dataType.simpleString()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, top, grid in clean(batches):
            n, y, x = _pixels(grid)
            yield pa.RecordBatch.from_arrays([rows.column("_by").take(pa.array(n)), pa.array(left[n] + x), pa.array(top[n] + y)], ["_by", "x", "y"])

    return clean.tiles(pixels, by).mapInArrow(some, f"_by {kind}, x long, y long").withColumnRenamed("_by", by)


def _labels(n: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, side: int) -> np.ndarray:
    """For each run of pixels of a row the first run, by tile, row and column, that it is connected with (eight neighbours)."""
    row = n * (side + 1) + y  # a row between tiles, and columns between rows, have no run
    first, last = row * (side + 2) + x0 + 1, row * (side + 2) + x1 + 1
    low, high = np.searchsorted(last, first + side + 1, "left"), np.searchsorted(first, last + side + 3, "right")
    count = high - low
    a = np.repeat(np.arange(len(n)), count)
    b = np.arange(len(a)) + np.repeat(low - np.cumsum(count) + count, count)
    label = np.arange(len(n))
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != (hop := label[label])).any():
            label = hop
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _seams(n: np.ndarray, y: np.ndarray, x0: np.ndarray, x1: np.ndarray, part: np.ndarray, side: int, tx: np.ndarray, ty: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Parts and the columns of ``_RUN`` where runs of pixels lie on a tile's border.

    What comes after a line is one pixel longer on both ends, so that it meets all that it is connected with; from top to bottom it may thereby
    meet the tiles above and below too.
    """
    out = []

    def add(at: np.ndarray, down: bool, line: np.ndarray, along: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> None:
        same = lambda v: np.full(len(at), v)
        out.append((part[at], same(down), line, along, low - after, high + after, same(after)))

    for after, on in ((True, y == 0), (False, y == side - 1)):
        at = np.flatnonzero(on)
        left = tx[n[at]] * side
        add(at, False, ty[n[at]] + (not after), tx[n[at]], left + x0[at], left + x1[at], after)
    for after, on in ((True, x0 == 0), (False, x1 == side - 1)):
        at = np.flatnonzero(on)
        cut = np.flatnonzero((np.diff(n[at]) != 0) | (np.diff(y[at]) != 1))
        begin, end = (at[np.concatenate(c)] for c in (([0], cut + 1), (cut, [len(at) - 1]))) if len(at) else (at, at)
        top = ty[n[begin]] * side
        for step, meets in ((0, slice(None)), *(((-1, y[begin] == 0), (1, y[end] == side - 1)) if after else ())):
            i = n[begin[meets]]
            add(begin[meets], True, tx[i] + (not after), ty[i] + step, top[meets] + y[begin[meets]], top[meets] + y[end[meets]], after)
    of, *columns = (np.concatenate(c) for c in zip(*out))
    return of, columns


def _parts(grid: np.ndarray, left: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """The tile of each connected part of a tile, and its ``a, m00, m10, m01, runs``."""
    n, side = grid.shape[:2]
    rows = np.zeros((n, side, -(-grid.shape[2] // 8) * 8), np.uint8)
    rows[:, :, : grid.shape[2]] = grid
    rows = rows.view("<u8")
    n, y, x0 = _pixels((rows & ~_moved(rows, -1)).view(np.uint8))
    x1 = _pixels((rows & ~_moved(rows, 1)).view(np.uint8))[2]
    label = _labels(n, y, x0, x1, side)
    first = np.flatnonzero(label == np.arange(len(label)))
    part = np.searchsorted(first, label)
    many = x1 - x0 + 1
    total = lambda v: np.bincount(part, v, len(first)).astype(np.int64)  # noqa: E731  inside of a tile, so exact
    tile, m00 = n[first], total(many)
    code = ((top[tile] + y[first]) << 32) + left[tile] + x0[first]
    moments = [m00, total((x0 + x1) * many / 2) + left[tile] * m00, total(y * many) + top[tile] * m00]
    of, runs = _seams(n, y, x0, x1, part, side, left // side, top // side)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(first) + 1)).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c[order]) for c in runs], fields=list(_RUN)))
    return tile, [*map(pa.array, (code, *moments)), listed]


def _blobs(pixels: DataFrame, by: str, clean: _Cleaning) -> DataFrame:
    kind = pixels.schema[by].dataType.simpleString()

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, left, top, grid in clean(batches):
            tile, columns = _parts(grid, left, top)
            yield pa.RecordBatch.from_arrays([rows.column("_by").take(pa.array(tile)), *columns], ["_by", "a", "m00", "m10", "m01", "runs"])

    run = "runs array<struct<down: boolean, line: long, at: long, low: long, high: long, after: boolean>>"
    parts = written(clean.tiles(pixels, by).mapInArrow(some, f"_by {kind}, a long, m00 long, m10 long, m01 long, {run}"))
    runs = parts.select("_by", "a", F.explode("runs").alias("r")).select("_by", "a", "r.*")
    then = runs.where("after").select("_by", "down", "line", "at", F.col("a").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    met = runs.where("not after").join(then, ["_by", "down", "line", "at"]).where("low <= b_high and high >= b_low").select("_by", "a", "b").distinct()
    links = written(met.select("_by", F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))))
    label = components(links.select("_by", "a").distinct(), links, "_by")
    release(links)
    moments = ("m00", "m10", "m01")
    at_border = parts.where("size(runs) > 0").select("_by", "a", *moments).join(label, ["_by", "a"], "left")
    joined = at_border.groupBy("_by", F.coalesce("label", "a").alias("blob")).agg(*[F.sum(m).cast("long").alias(m) for m in moments])
    whole = parts.where("size(runs) = 0").select("_by", F.col("a").alias("blob"), *moments).unionByName(joined)
    return whole.select(F.col("_by").alias(by), "blob", F.col("m00").cast("double").alias("area"), *moments)


def blobs(pixels: DataFrame, by: str = "frame_idx", tile: int = TILE) -> DataFrame:
    """Connected blobs of ``pixels`` (``by, x, y``): ``by, blob, area, m00, m10, m01``. Repeated pixels are one; rows with a null are left out.

    Pixels are labelled inside tiles (``tile`` pixels, in whole blocks), many tiles in one array of bits; parts that touch over the tiles' borders
    are united as components of the few labels there. So a frame with most pixels is many tasks. ``blob`` is the smallest code ``y * 2^32 + x``
    of the blob's pixels. Moments are sums over pixels: holes don't count, and a blob inside of a hole is one of its own.
    """
    return _blobs(pixels, by, _Cleaning(tile, None))


def cleaned_blobs(pixels: DataFrame, by: str = "frame_idx", width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT, kernel: tuple = ELLIPSE, tile: int = TILE) -> DataFrame:
    """``blobs`` of ``close_and_open``: tiles are cleaned and labelled as they are, and no pixel is a row in between."""
    return _blobs(pixels, by, _Cleaning(tile, (width, height), kernel))

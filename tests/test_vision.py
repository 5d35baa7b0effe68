"""Tiles, merged boxes and blobs against plain Python."""

import random

import numpy as np
import pandas as pd
import pytest

from aerolith.operators.blobs import ELLIPSE, RANGES, blobs, cleaned_blobs, close_and_open, in_colour
from aerolith.operators.tiles import detect_tiled, merge_boxes, tile_starts, with_tiles

BOXES = "frame_idx long, x1 double, y1 double, x2 double, y2 double, confidence double"


def share(a, b, smaller=True):
    w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    whole = min(area(a), area(b)) if smaller else area(a) + area(b) - w * h
    return w * h / whole if whole > 0 else 0


def greedy(rows, smaller=True):
    out = []
    for f in sorted({r[0] for r in rows}):
        mine = {}
        for r in rows:
            if r[0] == f and None not in r:
                c, n = mine.get(r[1:5], (-1, 0))
                mine[r[1:5]] = (max(c, r[5]), n + 1)
        kept = []
        for box, (c, n) in sorted(mine.items(), key=lambda kv: (-kv[1][0], kv[0])):
            for k in kept:
                if share(k[0], box, smaller) >= 0.5:
                    k[1], k[3] = [*map(min, k[1][:2], box[:2]), *map(max, k[1][2:], box[2:])], k[3] + n
                    break
            else:
                kept.append([box, list(box), c, n])
        out += [(f, *k[1], k[2], k[3]) for k in kept]
    return sorted(out)


def merged(spark, rows, **kw):
    return sorted(map(tuple, merge_boxes(spark.createDataFrame(rows, BOXES).repartition(5), **kw).collect()))


@pytest.mark.parametrize("seed, smaller", [(1, True), (2, True), (3, False)])
def test_merging_is_greedy(spark, seed, smaller):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        x, y = rng.randrange(0, 300), rng.randrange(-50, 200)
        rows.append((rng.randrange(3), float(x), float(y), float(x + rng.randrange(1, 120)), float(y + rng.randrange(1, 90)), rng.randrange(20) / 20))
    rows += rows[:20] + [(0, 5.0, None, 6.0, 7.0, 0.5), (1, 5.0, 5.0, 5.0, 9.0, 0.9)]
    assert merged(spark, rows, of_smaller=smaller) == greedy(rows, smaller)


def test_no_boxes(spark):
    assert merged(spark, []) == []


def test_a_chain_of_boxes_takes_rounds(spark):
    rows = [(0, 8.0 * k, 0.0, 8.0 * k + 14, 10.0, (12 - k) / 12) for k in range(12)]
    assert merged(spark, rows) == greedy(rows)


def test_rounds_read_only_the_boxes_they_need(spark, monkeypatch):
    """Boxes with no other in their cells are read again only for the result, which doesn't shuffle them; rounds read what the round before left."""
    from aerolith.operators import tiles

    relations, tables = [], []

    def seen(df, *by):
        relations.append(df._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        tables.append(tiles_written(df, *by))
        return tables[-1]

    tiles_written = tiles.written
    monkeypatch.setattr(tiles, "written", seen)
    alone = [(f, 200.0 * k, 70.0 * f, 200.0 * k + 20, 70.0 * f + 15, (k + 1) / 10) for f in range(3) for k in range(8)]
    rows = alone + [(9, 6.0 * k, 0.0, 6.0 * k + 14, 10.0, (4 - k) / 4) for k in range(4)] + [(9, 300.0, 300.0, 300.0, 309.0, 0.25), (9, 420.0, 400.0, 400.0, 409.0, 0.5)]
    result = tiles.merge_boxes(spark.createDataFrame(rows, BOXES).repartition(5))
    plan = result._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, result.collect())) == greedy(rows)
    assert relations == [0, 2, 2, 2, 2] and [{r[0]: r[1] for r in t.groupBy(t.columns[-1]).count().collect()} for t in tables[1:]] == [
        {tiles._ALONE: 26, tiles._KEPT: 1, tiles._OPEN: 3}, {True: 1, False: 2}, {tiles._KEPT: 1, tiles._OPEN: 1}, {True: 1}]
    assert plan.count("Relation [") == 7 and plan.startswith("Union") and [plan.count(x) for x in ("Join ", "Aggregate [")] == [1, 2]


def test_boxes_without_a_frame_or_with_nan_are_left_out_and_repeated_ones_counted(spark):
    nan = float("nan")
    rows = [(None, 0.0, 0.0, 9.0, 9.0, 0.5), (1, nan, 0.0, 9.0, 9.0, 0.5), (1, 0.0, 0.0, 9.0, 9.0, nan), *[(1, 0.0, 0.0, 9.0, 9.0, 0.0)] * 3, *[(1, 1.0, 0.0, 9.0, 9.0, 0.2)] * 2, (2, -70.0, -0.0, -60.0, 5.0, 0.1), (2, -70.0, 0.0, -60.0, 5.0, 0.3)]
    assert merged(spark, rows) == [(1, 0.0, 0.0, 9.0, 9.0, 0.2, 5), (2, -70.0, 0.0, -60.0, 5.0, 0.3, 2)]


def test_tiles_cover_the_frame():
    assert tile_starts(1920) == [0, 410, 820, 1230, 1408] and tile_starts(1080) == [0, 410, 568] and tile_starts(512) == [0] and tile_starts(100) == [0]


def test_tiled_detection_finds_each_target_once(spark):
    """A detector that sees what lies in its tile, cut at the tile's border; targets on borders come back whole and once."""
    targets = [(f, x, y) for f in range(3) for x in (0, 400, 500, 815, 1300, 1890) for y in (5, 420, 555, 1050)]

    def detect(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t in part.itertuples():
            for f, x, y in targets:
                x1, y1, x2, y2 = max(x, t.left), max(y, t.top), min(x + 30, t.right), min(y + 30, t.bottom)
                if f == t.frame_idx and x1 < x2 and y1 < y2:
                    out.append((f, t.left, t.top, x1 - t.left, y1 - t.top, x2 - t.left, y2 - t.top, 0.5 + (x2 - x1) * (y2 - y1) / 2000))
        return pd.DataFrame(out, columns=["frame_idx", "left", "top", "x1", "y1", "x2", "y2", "confidence"])

    frames = spark.range(3).withColumnRenamed("id", "frame_idx")
    assert with_tiles(frames).count() == 3 * 15
    got = detect_tiled(frames, detect).collect()
    assert sorted((r.frame_idx, r.x1, r.y1, r.x2, r.y2) for r in got) == sorted((f, x, y, x + 30, y + 30) for f, x, y in targets)


def plain_morphology(pixels, width, height):
    grid = np.zeros((height, width), bool)
    for x, y in pixels:
        if 0 <= x < width and 0 <= y < height:
            grid[y, x] = True
    under = lambda g, x, y: [g[y + dy, x + dx] for dx, dy in ELLIPSE if 0 <= x + dx < width and 0 <= y + dy < height]
    for how in (any, all, all, any):
        grid = np.array([[how(under(grid, x, y)) for x in range(width)] for y in range(height)])
    return {(x, y) for y, x in zip(*map(list, np.nonzero(grid)))}


def plain_blobs(pixels):
    left, out = set(pixels), []
    while left:
        todo, blob = [left.pop()], []
        while todo:
            x, y = todo.pop()
            blob.append((x, y))
            for dx in (-1, 0, 1):
                for dy in (-1, 0, 1):
                    if (x + dx, y + dy) in left:
                        left.remove((x + dx, y + dy))
                        todo.append((x + dx, y + dy))
        out.append((len(blob), sum(x for x, _ in blob), sum(y for _, y in blob)))
    return sorted(out)


@pytest.mark.parametrize("tile", [8, 64])
def test_blobs_of_random_frames(spark, tile):
    rng = random.Random(9)
    frames = {}
    for f in range(4):
        frames[f] = {(x, y) for x in range(-2, 50) for y in range(40) if rng.random() < (0.3, 0.55, 0.75, 0.02)[f]}
    frames[4] = {(x, 11) for x in range(45)} | {(44, y) for y in range(30)} | {(x, 29) for x in range(0, 45)}
    pixels = spark.createDataFrame([(f, x, y) for f, ps in frames.items() for x, y in ps for _ in range(1 + (x == y))], "frame_idx long, x long, y long").repartition(6)
    clean = close_and_open(pixels, width=48, height=40)
    got = {}
    for r in clean.collect():
        got.setdefault(r.frame_idx, set()).add((r.x, r.y))
    want = {f: plain_morphology(ps, 48, 40) for f, ps in frames.items()}
    assert got == {f: ps for f, ps in want.items() if ps}
    for source, name in ((clean, want), (pixels.where("x >= 0").distinct(), {f: {p for p in ps if p[0] >= 0} for f, ps in frames.items()})):
        found = {}
        for r in blobs(source, tile=tile).collect():
            found.setdefault(r.frame_idx, []).append((r.m00, r.m10, r.m01))
        assert {f: sorted(b) for f, b in found.items()} == {f: plain_blobs(ps) for f, ps in name.items() if ps}


def test_no_pixels(spark):
    assert blobs(close_and_open(spark.createDataFrame([], "frame_idx long, x long, y long"))).count() == 0


def test_colour_ranges(spark):
    rows = [(0, 120, 70), (10, 255, 255), (11, 200, 200), (175, 119, 200), (170, 120, 70), (180, 255, 255), (None, 200, 200)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "h int, s int, v int").withColumn("hit", in_colour(F.col("h"), F.col("s"), F.col("v")))
    plain = lambda p: None not in p and any(all(a <= x <= b for x, a, b in zip(p, *r)) for r in RANGES)
    assert [r.hit for r in df.collect()] == [plain(p) for p in rows]


@pytest.mark.parametrize("tile, kernel", [(8, ELLIPSE), (32, ELLIPSE), (32, ((0, 0), (1, 0), (3, -1), (-2, 2)))])
def test_blobs_are_cleaned_and_labelled_in_one_pass(spark, tile, kernel):
    """The same as cleaning first, over borders of tiles and of the frame; rows with a null are left out, and names of columns don't clash."""
    rng = random.Random(tile)
    rows = [(f"f{f}", x, y) for f in range(3) for x in range(-2, 72) for y in range(-1, 46) if rng.random() < (0.4, 0.8, 0.97)[f]]
    pixels = spark.createDataFrame([*rows, *rows[:50], (None, 3, 3), ("f0", None, 3)], "line string, x int, y long").repartition(5)
    found, want = {}, {}
    for r in cleaned_blobs(pixels, "line", 70, 45, kernel, tile).collect():
        assert r.area == r.m00
        found.setdefault(r.line, []).append((r.blob, r.m00, r.m10, r.m01))
    clean = close_and_open(pixels, "line", 70, 45, kernel).toPandas()
    for f, part in clean.groupby("line"):
        ps = set(zip(part.x.tolist(), part.y.tolist()))
        want[f] = plain_blobs(ps)
        assert {b[0] for b in found[f]} <= {(y << 32) + x for x, y in ps}
    assert {f: sorted(b[1:] for b in bs) for f, bs in found.items()} == want and len(want) == 3


def test_cleaning_shuffles_bits_and_not_each_step(spark):
    """Each of the four steps was a shuffle of the kernel's rows for each pixel; now blocks of 64 pixels move, twice."""
    from pyspark.sql import functions as F

    pixels = spark.range(32400 * 40).select(F.expr("id div 32400 % 4 as frame_idx"), F.expr("id % 240 as x"), F.expr("id div 240 % 135 as y"))
    clean = close_and_open(pixels, width=240, height=135)
    assert clean._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 2
    assert clean.count() == 4 * 240 * 135 and [tuple(r)[2:] for r in blobs(clean.where("frame_idx = 1")).collect()] == [(32400.0, 32400, 120 * 135 * 239, 120 * 135 * 134)]


def test_filters_on_pixels_do_not_repeat_the_projection(spark, sf, monkeypatch):
    from aerolith.plans import queries

    seen = []
    monkeypatch.setattr(queries, "cleaned_blobs", lambda pixels, **_: seen.append(pixels) or blobs(pixels.limit(0)))
    queries.QUERIES["colour_blobs"](spark, sf)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(seen[0].where("x between 0 and 239 and y between 0 and 134").dropna()).count("COS(") == plan(queries._det(spark, sf).select("u", "v")).count("COS(") > 0

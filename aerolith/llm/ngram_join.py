"""N-gram Jaccard join: prefix blocks of rare shingles, a count-vector R-tree in each block, exact verification.

A count-vector R-tree over a whole corpus prunes nothing once documents have many more shingles than groups,
as group counts of unrelated documents then overlap by chance. So rows first meet in blocks that no linked
pair can miss: the prefix of a document is its rarest shingles, one more than it may lack, and a linked pair
shares a shingle of both prefixes. Each block's documents are points of group counts in a bulk-loaded tree;
summed coordinate minima bound the overlap of nodes and of points. What survives meets the same bound on far finer
count vectors, of 2^20 groups and a byte or two a shingle, before the last of it is verified on whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, small_or_not, text_or_empty
from .components import connected_components, relabelled
from .textkernel import U, mix, shingle_sets, slices

#: Cells of the frequency sketch (counts of all shingles of all documents) and its blocks; a fixed size.
CELL_BITS, SKETCH_BLOCKS = 22, 64
#: Coordinates of a point (counts to 254; 255 stands for more), members of a block that one task compares
#: with as many others, shingles that count as one member more, children of a tree node, and pairs of leaves opened at once.
GROUPS, TILE, SHINGLES, FANOUT, LEAVES = 64, 2048, 1024, 16, 1024
#: Binary logarithm of the groups of a fine count vector (at most 21, for three bytes a difference).
FINE_BITS = 20


@dataclass(frozen=True)
class Naming:
    """How sets get their classes: by a first hash, or by a second one where sets of one first hash (``split``) are known to differ."""

    bits: int = 64
    split: frozenset = frozenset()

    def hashes(self, s: np.ndarray) -> tuple[int | None, int | None]:
        """Two independent hashes of a set's shingles and their number, the second of 64 bits; none for the empty set."""
        if not len(s):
            return None, None
        x = s ^ U(len(s))
        a, b = mix(x).sum(dtype=U), mix(x * U(0xC2B2AE3D27D4EB4F) + U(0x165667B19E3779F9)).sum(dtype=U)
        return int((a >> U(64 - self.bits)).view(np.int64)), int(b.view(np.int64))

    def of(self, s: np.ndarray) -> int | None:
        a, b = self.hashes(s)
        return b if a in self.split else a


def _classes(batches: Iterator[pa.RecordBatch], words: int, naming: Naming) -> Iterator[pa.RecordBatch]:
    """Id, text hash, set size and the set's two hashes of every row; at the end this task's sketch of shingle counts."""
    from pyspark import TaskContext

    counts = np.zeros(1 << CELL_BITS, dtype=np.uint32)
    none = lambda n, t: pa.nulls(n, t)
    names = ["doc_id", "th", "n", "cls", "chk", "block", "salt", "sketch"]
    for batch in batches:
        for part in slices(batch, "text"):
            n, cls, chk, seen = [], [], [], []
            for s in shingle_sets(part.column("text"), words):
                n.append(len(s))
                c, k = naming.hashes(s)
                cls.append(c)
                chk.append(k)
                seen.append(s)
            cells = (np.concatenate(seen) >> U(64 - CELL_BITS)).astype(np.int64)
            np.add.at(counts, cells, 1)
            k = part.num_rows
            yield pa.record_batch([
                part.column("doc_id").cast(pa.int64()), part.column("th"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(chk, pa.int64()),
                none(k, pa.int32()), none(k, pa.int32()), none(k, pa.binary()),
            ], names=names)
    if counts.any():
        parts = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_BLOCKS)]
        k = len(parts)
        yield pa.record_batch([
            *[none(k, pa.int64())] * 5, pa.array(range(k), pa.int32()),
            pa.array([TaskContext.get().partitionId() // 256] * k, pa.int32()), pa.array(parts, pa.binary()),
        ], names=names)


def _add_sketches(table: pa.Table) -> pa.Table:
    """Sum of one block's parts; a group holds at most 256 tasks' blocks, then one for each 256 tasks."""
    total = np.zeros((1 << CELL_BITS) // SKETCH_BLOCKS, dtype=np.uint64)
    for x in table.column("sketch"):
        raw = np.frombuffer(zlib.decompress(x.as_py()), dtype=np.uint8)
        total += raw.view(np.uint32 if len(raw) == 4 * len(total) else np.uint64)
    return pa.table({"block": table.column("block")[:1], "sketch": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _ranked(table: pa.Table) -> pa.Table:
    """The rarity of one block's cells, a byte each: twice the binary logarithm of the count."""
    total = np.frombuffer(zlib.decompress(_add_sketches(table).column("sketch")[0].as_py()), dtype=np.uint64)
    ranks = (2 * np.log2(total + 1.0)).astype(np.uint8)
    return pa.table({"block": table.column("block")[:1], "sketch": pa.array([ranks.tobytes()], pa.binary())})


def _prefix_rows(batches: Iterator[pa.RecordBatch], words: int, percent: int, rank: bytes, naming: Naming) -> Iterator[pa.RecordBatch]:
    """(key, class, set size, position) for the rarest shingles of each class this task meets, keys in the order of rarity."""
    rarity = np.frombuffer(rank, dtype=np.uint8)
    met: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            keys, cls, size, pos = [], [], [], []
            for s in shingle_sets(part.column("text"), words):
                if not len(s):
                    continue
                c = naming.of(s)
                if c in met:
                    continue
                met.add(c)
                n = len(s)
                k = n - (percent * n + 99) // 100 + 1
                order = (rarity[s >> U(64 - CELL_BITS)].astype(U) << U(56)) | (mix(s) >> U(8))
                order.sort()
                keys.append(order[:k])
                cls.append(np.full(k, c, dtype=np.int64))
                size.append(np.full(k, n, dtype=np.int32))
                pos.append(np.arange(k, dtype=np.int32))
            if keys:
                yield pa.record_batch([
                    pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(size)), pa.array(np.concatenate(pos)),
                ], names=["key", "cls", "n", "pos"])


def _packed(s: np.ndarray) -> bytes:
    """A fine count vector: the groups of a sorted set in order, with repeats, as differences of one to three bytes."""
    d = np.diff((s >> U(64 - FINE_BITS)).astype(np.int64), prepend=0)
    size = 1 + (d >= 1 << 7) + (d >= 1 << 14)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint8)
    for k in range(3):
        m = size > k
        out[at[m] + k] = ((d[m] >> 7 * k) & 127) | np.where(size[m] > k + 1, 128, 0)
    return out.tobytes()


def _unpacked(raw: np.ndarray) -> np.ndarray:
    """The groups of a fine count vector, each made distinct by the number of equal ones before it."""
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    x = np.cumsum(np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, starts))
    return (x << 32) | (np.arange(len(x)) - np.searchsorted(x, x))


def _chosen(batches: Iterator[pa.RecordBatch], words: int, naming: Naming, made: dict) -> Iterator[pa.RecordBatch]:
    """Of rows (cls, text) the columns of ``made``, functions of the set; a class once a task.

    A row whose text is of another class (a clash of text hashes) gives nothing.
    """
    met: set[int] = set()
    for batch in batches:
        for part in slices(batch, "text"):
            cls, out = [], [[] for _ in made]
            for c, s in zip(part.column("cls").to_pylist(), shingle_sets(part.column("text"), words)):
                if c not in met and c == naming.of(s):
                    met.add(c)
                    cls.append(c)
                    for x, f in zip(out, made.values()):
                        x.append(f(s))
            yield pa.record_batch([pa.array(cls, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], names=["cls", *made])


def _point(s: np.ndarray) -> bytes:
    """Counts of a set's shingles by group."""
    counts = np.bincount((s & U(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def _may_verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both fine count vectors, those whose summed minima allow a link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("fine_a"), batch.column("fine_b")):
            x, y = (_unpacked(np.frombuffer(z.as_buffer(), dtype=np.uint8)) for z in (x, y))
            most = len(np.intersect1d(x, y, assume_unique=True))
            keep.append((100 + percent) * most >= percent * (len(x) + len(y)))
        yield _ids_of(batch).filter(pa.array(keep, pa.bool_()))


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs with both whole sets, those that link."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            x, y = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(100 * both >= percent * (len(x) + len(y) - both))
        yield _ids_of(batch).filter(pa.array(keep, pa.bool_()))


#: A pair: two classes and the components they were in when the pair was found.
PAIR = ("a", "b", "ca", "cb")
_PAIR = ", ".join(f"{c} long" for c in PAIR)
#: A member of a tile: on the left (``side`` -1), the right (1) or both (0); ``stray`` outside the block's largest component, as all of the left are.
_MEMBER = "block long, ti int, tj int, side int, stray boolean, cls long, comp long, n int, pos int, point binary"
MEMBER = tuple(c.split()[0] for c in _MEMBER.split(", "))


def _ids_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(c) for c in PAIR], names=list(PAIR))


def _may_link(p: np.ndarray, q: np.ndarray, both: np.ndarray, percent: int) -> np.ndarray:
    """Whether summed coordinate minima reach the overlap that sets of ``both`` shingles together need."""
    least = np.minimum(p, q)
    return ((100 + percent) * least.sum(axis=1, dtype=np.int64) >= percent * both) | (least == 255).any(axis=1)


class CountTree:
    """A bulk-loaded R-tree over count vectors: members sorted by size, leaves of ``FANOUT``, boxes of minima and maxima."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((points.argmax(axis=1), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []
        top, small, large = self.points, self.sizes, self.sizes
        while len(top) > 1:
            cut = np.arange(0, len(top), FANOUT)
            top = np.maximum.reduceat(top, cut, axis=0)
            small, large = np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)
            self.levels.append((top, small, large))

    def matches(self, other: CountTree, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (into either tree's own input) whose bound allows 100 * overlap >= percent * union."""
        found = list(self.pieces(other, percent))
        i, j = zip(*found) if found else ([np.empty(0, dtype=np.int64)],) * 2
        return np.concatenate(i), np.concatenate(j)

    def pieces(self, other: CountTree, percent: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """:meth:`matches` in pieces of ``LEAVES`` pairs of leaves; ``wanted`` says of a piece's pairs which are to meet the bound."""
        depth = min(len(self.levels), len(other.levels))
        n, k = (len(t.levels[depth - 1][0]) if depth else len(t.points) for t in (self, other))
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n), np.arange(k), indexing="ij"))
        while depth:
            i, j = self._bounded(other, percent, depth, i, j)
            depth -= 1
            if not depth:
                break
            i, j = self._opened(other, depth, i, j)
        whole = not self.levels or not other.levels
        for c in range(0, len(i), LEAVES):
            x, y = i[c : c + LEAVES], j[c : c + LEAVES]
            if not whole:
                x, y = self._opened(other, 0, x, y)
            if wanted:
                ok = wanted(self.order[x], other.order[y])
                x, y = x[ok], y[ok]
            x, y = self._bounded(other, percent, 0, x, y)
            if len(x):
                yield self.order[x], other.order[y]

    def _level(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.levels[depth - 1] if depth else (self.points, self.sizes, self.sizes)

    def _bounded(self, other: CountTree, percent: int, depth: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of nodes (points at depth 0) those below which a pair may link."""
        (p, s, l), (q, t, m) = self._level(depth), other._level(depth)
        keep = (100 * l[i] >= percent * t[j]) & (100 * m[j] >= percent * s[i])  # some sizes agree
        i, j = i[keep], j[keep]
        fine = np.zeros(len(i), dtype=bool)
        for c in range(0, len(i), 1 << 14):
            x, y = i[c : c + (1 << 14)], j[c : c + (1 << 14)]
            fine[c : c + (1 << 14)] = _may_link(p[x], q[y], s[x] + t[y], percent)
        return i[fine], j[fine]

    def _opened(self, other: CountTree, depth: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of children, at ``depth``, of pairs of nodes."""
        n, k = (len(t._level(depth)[0]) for t in (self, other))
        step = np.arange(FANOUT)
        ci, cj = (i[:, None] * FANOUT + step)[:, :, None], (j[:, None] * FANOUT + step)[:, None, :]
        ok = ((ci < n) & (cj < k)).ravel()
        return tuple(np.broadcast_to(x, (len(i), FANOUT, FANOUT)).ravel()[ok] for x in (ci, cj))


def _candidates(rows: dict[str, np.ndarray], percent: int, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one tile, left and right member, which are wanted as their piece comes up and whose points allow a link."""
    left, right = np.flatnonzero(rows["side"] <= 0), np.flatnonzero(rows["side"] >= 0)
    if len(left) == 0 or len(right) == 0:
        return
    n, points = rows["n"], np.stack([np.frombuffer(x, dtype=np.uint8) for x in rows["point"]])
    if len(left) * len(right) <= 64:
        i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
        ok = wanted(i, j)
        i, j = i[ok], j[ok]
        ok = _may_link(points[i], points[j], n[i] + n[j], percent)
        yield i[ok], j[ok]
        return
    x, y = CountTree(points[left], n[left]), CountTree(points[right], n[right])
    for i, j in x.pieces(y, percent, lambda i, j: wanted(left[i], right[j])):
        yield left[i], right[j]


def _compared(rows: dict[str, np.ndarray], percent: int, on: str) -> np.ndarray:
    """The members of one tile that may link with another one of another component, by their points or their fine count vectors; on whole sets the links.

    Of the links a spanning forest: classes that the tile's links have joined are not compared any more, nor are members that
    may both link already. So a tile returns no more rows than it has members, whatever the number of its pairs.
    """
    n, pos, cls, stray = rows["n"], rows["pos"], rows["cls"], rows["stray"]
    names, label = np.unique(rows["comp"], return_inverse=True)
    own, hit, exact = label.copy(), np.zeros(len(n), dtype=bool), on == "set"

    def wanted(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        # if the shared shingle is the pair's first, at most what follows it is shared too; a link shows at its first
        most = np.minimum(n[i] - pos[i], n[j] - pos[j])
        new = (label[i] != label[j]) & (~stray[j] | (cls[i] < cls[j])) & ((100 + percent) * most >= percent * (n[i] + n[j]))
        return new & ~(hit[i] & hit[j])

    links, codes = [], None
    for i, j in _candidates(rows, percent, wanted):
        if on == "point":
            hit[i] = hit[j] = True
            continue
        if codes is None:
            sizes = np.cumsum([len(x) for x in rows[on]])
            distinct, all_codes = np.unique(np.concatenate(rows[on]), return_inverse=True)
            codes, marked = np.split(all_codes, sizes[:-1]), np.zeros(len(distinct), dtype=bool)
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        for a, others in zip(i[first].tolist(), np.split(j, first[1:])):
            marked[codes[a]] = True
            for b in others.tolist():
                if label[a] == label[b] or (hit[a] and hit[b]):
                    continue
                both = np.count_nonzero(marked[codes[b]])
                if (100 + percent) * both < percent * (len(codes[a]) + len(codes[b])):
                    continue
                if exact:
                    links.append((a, b))
                    label[label == label[b]] = label[a]
                else:
                    hit[a] = hit[b] = True
            marked[codes[a]] = False
    if not exact:
        return np.flatnonzero(hit)
    a, b = np.array(links, dtype=np.int64).reshape(-1, 2).T
    return np.stack([cls[a], cls[b], names[own[a]], names[own[b]]], axis=1)


def _tiles(batches: Iterator[pa.RecordBatch], percent: int, on: str) -> Iterator[pa.RecordBatch]:
    """Stream members sorted by (block, ti, tj) through :func:`_compared`; a tile is complete when the next one starts."""
    rest: pa.Table | None = None
    read = {"fine": lambda x: _unpacked(np.frombuffer(x.as_buffer(), dtype=np.uint8)), "set": lambda x: np.frombuffer(x.as_buffer(), dtype=U)}

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: table.column(c).to_numpy() for c in MEMBER if c != "point"}
        cols["n"], cols["pos"] = cols["n"].astype(np.int64), cols["pos"].astype(np.int64)
        points = table.column("point").to_pylist()
        new = np.flatnonzero((np.diff(cols["block"]) != 0) | (np.diff(cols["ti"]) != 0) | (np.diff(cols["tj"]) != 0)) + 1
        cut = np.concatenate([[0], new, [len(points)]])
        found = []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            if hi - lo > 1:
                rows = {c: v[lo:hi] for c, v in cols.items()} | {"point": points[lo:hi]}
                if on in read:
                    rows[on] = [read[on](x) for x in table.column(on).slice(lo, hi - lo)]
                got = _compared(rows, percent, on)
                found.append(got if on == "set" else got + lo)
        if found:
            found = np.concatenate(found)
            if on == "set":
                yield pa.record_batch([pa.array(found[:, k]) for k in range(4)], names=list(PAIR))
            elif len(found):
                yield from table.select(list(MEMBER)).take(pa.array(found)).to_batches()

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        k = [table.column(c).to_numpy() for c in ("block", "ti", "tj")]
        last = np.logical_and.reduce([x == x[-1] for x in k])
        at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        yield from compared(table.slice(0, at))
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield from compared(rest)


class _Corpus:
    """Whole texts by class: what the classes chosen so far are made of, each read from one row that holds it."""

    def __init__(self, texts: DataFrame, words: int, naming: Naming):
        self.texts, self.words, self.naming = texts, words, naming

    def of(self, chosen: DataFrame, made: dict) -> DataFrame:
        """A written table ``cls`` and the columns of ``made`` for the classes of ``chosen`` (``cls, low, th``)."""
        c = small_or_not(chosen.select("cls", F.col("low").alias("_low"), F.col("th").alias("_th")), 32)
        # by broadcast when the counted classes are few, else by a shuffled join
        rows = self.texts.join(c, (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_low"))).select("cls", "text")
        words, naming = self.words, self.naming
        out = materialize(rows.mapInArrow(lambda it: _chosen(it, words, naming, made), "cls long, " + ", ".join(f"{n} binary" for n in made)))
        if out.count() == chosen.count():
            return out
        once = materialize(out.dropDuplicates(["cls"]))  # a repeated row was met by several tasks
        release(out)
        return once


def _links(pairs: DataFrame, points: DataFrame, corpus: _Corpus, classes: DataFrame, percent: int) -> DataFrame:
    """Verify pairs of classes: by fine count vectors first, then on whole sets, made for the classes of what is left only.

    A class may have many pairs, so all joins keep an exchange on each side, which AQE can split.
    """
    pairs = materialize(pairs)
    if pairs.isEmpty():
        return pairs
    fine = points.select("cls", "fine").join(small_or_not(_ends(pairs), 16), "cls", "left_semi")
    left = materialize(_with_both(pairs, fine, "fine").mapInArrow(lambda it: _may_verify(it, percent), _PAIR))
    chosen = materialize(classes.join(small_or_not(_ends(left), 16), "cls", "left_semi"))
    sets = corpus.of(chosen, {"set": np.ndarray.tobytes})
    out = materialize(_with_both(left, sets, "set").mapInArrow(lambda it: _verified(it, percent), _PAIR))
    release(pairs, left, chosen, sets)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()


def _with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    """Pairs with column ``name`` of both classes."""
    return (
        pairs.join(of.select(F.col("cls").alias("a"), F.col(name).alias(f"{name}_a")), "a")
        .join(of.select(F.col("cls").alias("b"), F.col(name).alias(f"{name}_b")), "b")
        .select(*PAIR, f"{name}_a", f"{name}_b")
    )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, first_bits: int = 64,
) -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id`` (smallest id reachable by links), ``class_id``, ``component_class`` and ``text_hash``.

    Two documents link when 100 * |A and B| >= percent * |A or B| over their distinct ``words``-word shingles,
    A-Z lower-cased. Rows of equal sets are one class, so copies never multiply work.

    1. A scan gives every row its set size and class (two 64-bit hashes; a first hash that two sets share gives way to
       the second; ``first_bits`` below 64 makes such clashes common, for tests), and a sketch of all shingles' counts.
    2. Every class sends its rarest 1 - percent/100 shingles (and one more). Shingles of one class end; those with the
       same members are one block, so a passage that documents share is one block and not one for each of its shingles.
    3. Every member of a block is verified against two pivots, its smallest and its largest class: linear in the rows.
       Blocks whose members are all in one component end.
    4. Of the other blocks, members outside the largest component meet all members in tiles of bounded size, with a
       count-vector tree on each side, and positions and points as bounds. First a block's members are dealt once, which
       settles blocks of one tile and joins most of what belongs together in larger ones, in linear rows; then each part
       of what is still outside meets each part of a larger block.
    5. A tile first returns its members that may link by their points, then by fine count vectors, then, on whole sets, a
       spanning forest of their links: never its pairs, so no table grows with the square of a tile's members.
    6. Links between components are contracted after each round, in shared scratch tables.

    No link between different components is lost: step 4 brings every two classes that share a block and are apart into
    one tile, with no cap. Shingles are compared by 64-bit hashes. All group sizes come from partial aggregates.

    Null and empty texts have no set and are their own component (``class_id`` null); rows with fewer than ``words`` words have
    one shingle; repeated rows share class and component; a row without an id, or one of several texts under one id, is
    linked like any other (``component_class`` tells components apart even so) and gets its component's smallest
    id, null where no row of the component has one; very long texts are read whole, one text being the least a task
    holds; other columns of ``docs`` are not read, whatever their names; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64(text_or_empty("text")))
    first = materialize(texts.mapInArrow(
        lambda it: _classes(it, words, Naming(first_bits)), "doc_id long, th long, n long, cls long, chk long, block int, salt int, sketch binary"))
    shape = "block int, sketch binary"
    ranks = (
        first.where("block is not null").select("block", "salt", "sketch")
        .groupBy("block", "salt").applyInArrow(_add_sketches, shape)
        .groupBy("block").applyInArrow(_ranked, shape).collect()
    )
    rarity = bytearray(1 << CELL_BITS)  # a fixed 4 MiB
    for r in ranks:
        rarity[r["block"] * len(r["sketch"]) : (r["block"] + 1) * len(r["sketch"])] = r["sketch"]
    rank = spark.sparkContext.broadcast(bytes(rarity))

    hashed = first.where("cls is not null").groupBy("cls").agg(
        F.min("chk").alias("chk"), F.max("chk").alias("chk2"), F.min("n").alias("n"), F.min("doc_id").alias("low"),
        F.min_by("th", "doc_id").alias("th"), F.min("th").alias("any_th"),
    ).withColumn("th", F.coalesce("th", "any_th")).drop("any_th")
    hashed = materialize(hashed)
    # different sets of one 64-bit hash: about n^2 / 2^65 of n classes, three of 10^10
    split = frozenset(r[0] for r in hashed.where("chk <> chk2").select("cls").collect())
    naming = Naming(first_bits, split)
    rows = first.where("block is null").select("doc_id", "th", "n", "cls", "chk")
    classes = hashed.select("cls", "n", "low", "th")
    if split:
        rows = rows.withColumn("cls", F.when(F.col("cls").isin(*split), F.col("chk")).otherwise(F.col("cls")))
        again = rows.join(F.broadcast(hashed.where("chk <> chk2").select(F.col("cls").alias("_c"))), F.col("cls") == F.col("_c"), "left_anti")
        classes = materialize(again.where("cls is not null").groupBy("cls").agg(
            F.min("n").alias("n"), F.min("doc_id").alias("low"), F.min_by("th", "doc_id").alias("th"), F.min("th").alias("any_th"),
        ).withColumn("th", F.coalesce("th", "any_th")).drop("any_th"))
    corpus = _Corpus(texts, words, naming)

    sent = texts.where("text is not null").select("text").mapInArrow(
        lambda it: _prefix_rows(it, words, percent, rank.value, naming), "key long, cls long, n int, pos int")
    shared = materialize(sent.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo < hi").select("key"))
    met = materialize(sent.join(shared, "key", "left_semi").groupBy("key", "cls").agg(F.min("n").alias("n"), F.min("pos").alias("pos")))
    rank.destroy()  # nothing is computed from it any more: what follows reads written tables
    # the members of a key by their number and two sums without carry; keys of the same members are one block
    alike = materialize(met.groupBy("key").agg(
        F.count("*").alias("m"), F.bit_xor(F.xxhash64("cls")).alias("x"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("y"),
        F.min("cls").alias("lo"), F.max("cls").alias("hi"),
    ).select("key", F.xxhash64("m", "x", "y").alias("block"), "lo", "hi"))
    blocks = materialize(
        met.join(alike, "key").groupBy("block", "cls", "lo", "hi").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    )
    release(shared, met, alike)
    chosen = materialize(classes.join(blocks.select("cls").distinct(), "cls", "left_semi"))
    points = corpus.of(chosen, {"point": _point, "fine": _packed})

    pivots = blocks.select("cls", "n", "pos", F.explode(F.array("lo", "hi")).alias("p")).where("cls <> p").groupBy("cls", "p").agg(F.min("n").alias("n"), F.min("pos").alias("pos"))
    near = ((100 + percent) * (F.col("n") - F.col("pos")) >= percent * (F.col("n") + F.col("pn"))) & (100 * F.least("n", "pn") >= percent * F.greatest("n", "pn"))
    pairs = pivots.join(chosen.select(F.col("cls").alias("p"), F.col("n").alias("pn")), "p").where(near)
    pairs = pairs.select(F.least("cls", "p").alias("a"), F.greatest("cls", "p").alias("b")).distinct().select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"))
    found = _links(pairs, points, corpus, classes, percent)
    comps = relabelled(None, _joined(found))
    release(found)
    for diagonal in (True, False):
        left = blocks if diagonal else blocks.where(F.col("members") > TILE)
        if left.isEmpty():
            break
        before, blocks = blocks, _apart(left, comps)
        release(before)
        found = _tile_links(blocks, points, corpus, classes, percent, diagonal)
        comps = relabelled(comps, _joined(found))
        release(found)
    whole = classes.select("cls", "low").join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls"))
    lows = whole.groupBy("comp").agg(F.min("low").alias("component_low"))
    named = materialize(whole.select("cls", "comp").join(lows, "comp"))
    release(blocks, points, chosen, comps)
    return (
        rows.join(named, "cls", "left")
        .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"),
                F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_low")).alias("component_id"),
                F.col("cls").alias("class_id"), F.col("comp").alias("component_class"), F.col("th").alias("text_hash"))
    )


def _joined(links: DataFrame) -> DataFrame:
    return connected_components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))


def _apart(blocks: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the blocks whose members are in several components: ``block, cls, comp, n, pos``, the weights of the block's members and strays, and whether the row is one.

    A weight is a number of members and of every ``SHINGLES`` shingles they have, so that it bounds rows and bytes.
    """
    now = materialize(
        blocks.select("block", "cls", "n", "pos").join(comps, F.col("cls") == F.col("node"), "left")
        .select("block", "cls", F.coalesce("component", "cls").alias("comp"), "n", "pos")
    )
    largest = materialize(
        now.groupBy("block", "comp").agg(F.count("*").alias("k"), F.sum(F.col("n") / SHINGLES + 1).alias("w")).groupBy("block")
        .agg(F.max_by(F.struct("comp", "w"), "k").alias("big"), F.max("k").alias("most"), F.sum("k").alias("all"), F.sum("w").alias("members")).where("most < all")
        .select("block", "big.comp", "members", (F.col("members") - F.col("big.w")).alias("strays")).withColumnRenamed("comp", "big")
    )
    out = materialize(now.join(largest, "block").withColumn("stray", F.col("comp") != F.col("big")).drop("big"))
    release(now, largest)
    return out


def _tile_links(blocks: DataFrame, points: DataFrame, corpus: _Corpus, classes: DataFrame, percent: int, diagonal: bool) -> DataFrame:
    """Links that join the components of the members of every tile as all links of its pairs do.

    Members go through the tiles three times: with their points, those left with fine count vectors, those still left with
    whole sets. Each time a tile returns at most as many rows as it has members, see :func:`_compared`.
    """
    dealt = lambda df, on: df.select(*MEMBER, *on).repartition("block", "ti", "tj").sortWithinPartitions("block", "ti", "tj")
    left = materialize(dealt(_placed(blocks, diagonal).join(points.select("cls", "point"), "cls"), []).mapInArrow(lambda it: _tiles(it, percent, "point"), _MEMBER))
    fine = points.select("cls", "fine").join(small_or_not(left.select("cls").distinct(), 16), "cls", "left_semi")
    close = materialize(dealt(left.join(fine, "cls"), ["fine"]).mapInArrow(lambda it: _tiles(it, percent, "fine"), _MEMBER))
    chosen = materialize(classes.join(small_or_not(close.select("cls").distinct(), 16), "cls", "left_semi"))
    sets = corpus.of(chosen, {"set": np.ndarray.tobytes})
    out = materialize(dealt(close.join(sets, "cls"), ["set"]).mapInArrow(lambda it: _tiles(it, percent, "set"), _PAIR))
    release(left, close, chosen, sets)
    return out


def _placed(blocks: DataFrame, diagonal: bool) -> DataFrame:
    """Members in tiles: part i of a block's strays meets part j of all its members; with ``diagonal`` part i of all only meets itself.

    A block of weights m and s of its members and strays takes s / TILE copies of its rows and m / TILE of its strays; most take
    none, and with ``diagonal`` none does.
    """
    many = lambda c: F.ceil(F.col(c) / TILE).cast("int")
    mine = lambda c: F.pmod(F.hash("cls"), F.col(c))
    tile = lambda i, j, side: F.struct(i.alias("ti"), j.alias("tj"), side.alias("side"))
    cut = blocks.withColumn("ts", many("strays")).withColumn("to", many("members"))
    if diagonal:
        return cut.withColumn("at", tile(mine("to"), mine("to"), F.when(F.col("stray"), 0).otherwise(1))).select("*", "at.*")
    numbers = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    right = F.transform(numbers("ts"), lambda i: tile(i, mine("to"), F.lit(1)))
    left = F.transform(numbers("to"), lambda j: tile(mine("ts"), j, F.lit(-1)))
    return cut.withColumn("at", F.explode(F.when(F.col("stray"), F.concat(left, right)).otherwise(right))).select("*", "at.*")

"""Numpy kernels over whole Arrow string columns: words, 64-bit word hashes and shingle sets, without row loops in Python."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Multipliers which keep the five places of a shingle apart.
_PLACE = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) | 1 for k in range(1, 65)], dtype=np.uint64)
_PIECE = 1 << 17
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        n = max(n, 2 * _PIECE)
        _powers = tuple(np.concatenate([[U(1)], np.cumprod(np.full(n - 1, b, dtype=U), dtype=U)]) for b in (_BASE, _BASE_INVERSE))
    return _powers


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (rows + 1, from 0) of a string column; a null has no bytes."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    if texts.null_count:
        texts = texts.fill_null("")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if off is not None else np.zeros(1, np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return buf, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no part holds more than ``most`` text bytes, but for single longer rows."""
    if not batch.num_rows:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    total, start = np.concatenate([[0], np.cumsum(n)]), 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(total, total[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (rows + 1)."""
    space = np.empty(len(buf) + 2, dtype=bool)
    space[0] = space[-1] = True
    space[1:-1] = _IS_SPACE[buf]
    begins = ~space[1:-1] & space[:-2]
    ends = ~space[1:-1] & space[2:]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(buf))]  # a row's end also ends a word
    begins[cut] |= ~space[1:-1][cut]
    ends[cut - 1] |= ~space[1:-1][cut - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, off)


def word_hashes(buf: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of every word, from differences of running polynomial sums, in pieces that stay in cache."""
    out = np.empty(len(starts), dtype=U)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + _PIECE, "right")))
        a, b = int(starts[i]), int(stops[j - 1])
        power, inverse = _power_tables(b - a + 1)
        total = np.empty(b - a + 1, dtype=U)
        total[0] = 0
        np.cumsum((buf[a:b].astype(U) + U(1)) * power[: b - a], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = (total[stops[i:j] - a] - total[s]) * inverse[s]
        i = j
    return mix(out)


def shingle_sets(texts: pa.Array, size: int = 5, lower: bool = True) -> Iterator[np.ndarray]:
    """For every row the sorted distinct 64-bit hashes of its word shingles.

    A row of fewer than ``size`` words has its whole sequence as its one shingle; without words it has none.
    """
    buf, off = buffers(texts)
    if lower:
        buf = _LOWER[buf]
    starts, stops, first = words(buf, off)
    h = word_hashes(buf, starts, stops)
    n = len(h) - size + 1
    if n > 0:
        rolled = np.zeros(n, dtype=U)
        for k in range(size):
            rolled += h[k : k + n] * _PLACE[k]
        rolled = mix(rolled)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(rolled[a : b - size + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            yield s
        elif b > a:
            yield mix((h[a:b] * _PLACE[: b - a]).sum(dtype=U, keepdims=True) + U((b - a) * 0xA24BAED4963EE407 % (1 << 64)))
        else:
            yield h[:0]

"""Words, shingles and their 64-bit hashes, in numpy, straight from Arrow's string buffers.

A word is a maximal run of bytes other than space and 0x09 to 0x0D.  Hashes depend on the
bytes alone, so every executor computes the same ones.  Two different words, shingles or
windows get the same hash with odds of 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
#: Bytes, and words, that one numpy pass takes at a time.
SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no linear structure (splitmix64's finish)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 1), base, U)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n > 4 * SEGMENT:
            return have
        _powers[base] = have
    return have


def texts(column: pa.Array | pa.ChunkedArray, most: int = 1 << 22) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them and their end) of runs of rows of about `most` bytes; null is empty."""
    for array in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        yield from _runs(array, most)


def _runs(array: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    n = len(array)
    _, at, data = array.buffers()
    offsets = np.frombuffer(at, kind)[array.offset : array.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, hash) of every word; starts and ends are byte positions in `data`."""
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    first = ~space
    last = first.copy()
    first[1:] &= space[:-1]
    last[:-1] &= space[1:]
    full = offsets[1:] > offsets[:-1]
    for mark, at in ((first, offsets[:-1][full]), (last, offsets[1:][full] - 1)):
        mark[at] = ~space[at]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    out = np.empty(len(start), U)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + SEGMENT, side="right")))
        lo, n = start[i], int(end[j - 1] - start[i])
        total = np.zeros(n + 1, U)
        np.cumsum((data[lo : lo + n].astype(U) + U(1)) * powers(_BASE, n)[:n], out=total[1:])
        s, e = start[i:j] - lo, end[i:j] - lo
        out[i:j] = mix((total[e] - total[s]) * powers(_BASE_INV, n + 1)[s])
        i = j
    return row, start, end, out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of every run of `n` of these word hashes, by its first word."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, U)
    if n <= 8:
        out = np.zeros(count, U)
        for i in range(n):
            out += hashes[i : i + count] * U(pow(_BASE, i + 1, 2**64))
        return mix(out)
    out = np.empty(count, U)
    for lo in range(0, count, SEGMENT):
        hi = min(count, lo + SEGMENT)
        part = hashes[lo : hi + n - 1]
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * powers(_BASE, len(part))[: len(part)], out=total[1:])
        out[lo:hi] = mix((total[n:] - total[:-n]) * powers(_BASE_INV, len(part) + 1)[: hi - lo])
    return out


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def bounds(row: np.ndarray, rows: int) -> np.ndarray:
    """Where each row's words begin in arrays by word, and where the last ends."""
    return np.searchsorted(row, np.arange(rows + 1))


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """The least (or largest) of every `width` neighbours."""
    f, have = (np.minimum if least else np.maximum), 1
    out = values
    while 2 * have <= width:
        out = f(out[:-have], out[have:])
        have *= 2
    return f(out[: len(values) - width + 1], out[width - have :][: len(values) - width + 1]) if have < width else out

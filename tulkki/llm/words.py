"""Vectorised word scanning and hashing over the byte buffers of Arrow strings.

Words are the runs of bytes other than ``[\\x20\\x09-\\x0D]``.  Hashes are
polynomials over the ring of 64-bit integers, read off prefix sums, so that
the hash of any word or of any window of words costs one subtraction and one
multiplication.  A finaliser makes them non-linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text taken at once; the arrays of a piece take about 100 times as much memory.
PIECE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER_BYTE = _BYTE.copy()
_LOWER_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASES = [int(x) | 1 for x in _rng.integers(1 << 62, 1 << 63, 4, dtype=np.uint64)]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i below n at least."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        up, down = np.full(n, base, U64), np.full(n, pow(base, -1, 1 << 64), U64)
        up[0] = down[0] = 1
        have = _tables[base] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-shift-multiply rounds); changes ``h`` in place."""
    h ^= h >> U64(31)
    h *= U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h *= U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


class Prefix:
    """Prefix sums of one sequence, giving the hash of any of its ranges."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, self._down = _powers(_BASES[base], n + 1)
        self._sums = np.zeros(n + 1, U64)
        np.cumsum(values * up[:n], dtype=U64, out=self._sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._down[start])


class Words:
    """The words of some texts: ``hash`` and ``row`` of each word, and the
    first word of each row in ``first`` (one entry more than rows)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        offsets = offsets.astype(np.int64) - offsets[0]
        n = len(data)
        space = _SPACE[data]
        begins = np.ones(n, bool)
        begins[1:] = space[:-1]
        ends = np.ones(n, bool)
        ends[:-1] = space[1:]
        inner = offsets[1:-1]
        begins[inner[inner < n]] = True
        ends[inner[inner > 0] - 1] = True
        self.start = np.flatnonzero(begins & ~space)
        self.end = np.flatnonzero(ends & ~space) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = Prefix((_LOWER_BYTE if lower else _BYTE)[data], 0).ranges(self.start, self.end)


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string array into row ranges of at most ``limit`` bytes, a row at
    least: (first row, end row, bytes, offsets).  Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, int(offsets[lo]) + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1]
        lo = hi


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, from prefix and suffix
    minima of blocks of that width (linear, whatever the width)."""
    n = len(values)
    if n < width:
        return values[:0]
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])

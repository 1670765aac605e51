"""Bit-parallel edit distance (Myers / Hyyro) of many pairs of word lists at a time.

A row of a pair's matrix is one bit a column in words of 64 bits ("limbs");
numpy advances the rows of all pairs of a chunk together.  Pairs are in
descending order of rows, so that those still going on are a prefix.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np

ONE = np.uint64(1)
TOP = np.uint64(63)


def numbered(pairs: list[tuple[list, list]]) -> list[tuple[list[int], list[int]]]:
    """The pairs with numbers for words."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    return [([number[w] for w in a], [number[w] for w in b]) for a, b in pairs]


def padded(lists: list[list[int]], width: int, spare: int) -> np.ndarray:
    """One row a list, filled up with ``spare``."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    out = np.full((len(lists), width), spare, np.int32)
    out[np.arange(width) < sizes[:, None]] = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
    return out


def packed(equal: np.ndarray) -> np.ndarray:
    """(pair, row, column) with a multiple of 64 columns as bits: (row, limb, pair)."""
    return np.ascontiguousarray(np.packbits(equal, axis=2, bitorder="little").view(np.uint64).transpose(1, 2, 0))


def stacked(rows: list[list[int]], columns: list[list[int]], limbs: int, cells: int = 1 << 22) -> np.ndarray:
    """(row, limb, pair): the columns equal to each row's word, of numbered pairs, the one with most rows first."""
    out = np.zeros((len(rows[0]), limbs, len(rows)), np.uint64)
    at = 0
    while at < len(rows):
        most = len(rows[at])
        end = at + max(1, cells // (most * limbs * 64))
        equal = padded(rows[at:end], most, -1)[:, :, None] == padded(columns[at:end], 64 * limbs, -2)[:, None, :]
        out[:most, :, at:end] = packed(equal)
        at = end
    return out


def advance(places: np.ndarray, lengths: np.ndarray, widths: np.ndarray, keep: tuple[str, ...] = ()) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distance of each pair (``lengths`` rows, in descending order, by ``widths`` columns), and of each cell the bits ``keep``.

    ``same``: the cell is equal to the one above and left of it; ``more``,
    ``less``: one more, one less than the cell above."""
    most, limbs, count = places.shape
    kept = [np.zeros_like(places) for _ in keep]
    up, down = np.full((limbs, count), ~np.uint64(0)), np.zeros((limbs, count), np.uint64)
    ends = np.searchsorted(-lengths, -np.arange(most), side="left")  # pairs with more than i rows
    for i, n in enumerate(ends.tolist()):
        plus, minus = ONE, np.uint64(0)
        for k in range(limbs):
            u, d = up[k, :n], down[k, :n]
            x = places[i, k, :n] | minus
            same = (((x & u) + u) ^ u) | x | d
            more = d | ~(same | u)
            less = same & u
            for name, out in zip(keep, kept, strict=True):
                out[i, k, :n] = same if name == "same" else more if name == "more" else less
            above, below = more << ONE | plus, less << ONE | minus
            if k + 1 < limbs:
                plus, minus = more >> TOP, less >> TOP
            up[k, :n] = below | ~(same | above)
            down[k, :n] = above & same
    bits = np.clip(widths[None, :] - 64 * np.arange(limbs)[:, None], 0, 64)
    mask = np.where(bits == 64, ~np.uint64(0), (ONE << (bits % 64).astype(np.uint64)) - ONE)
    steps = np.bitwise_count(up & mask).sum(0, dtype=np.int64) - np.bitwise_count(down & mask).sum(0, dtype=np.int64)
    return lengths + steps, kept


def bit(kept: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether the bit of row ``i`` and column ``j`` (both from 0) of pair ``p`` is set."""
    return (kept[i, j >> 6, p] >> (j & 63).astype(np.uint64) & ONE).astype(bool)


def chunks(sizes: list[int], limbs: int, cells: int = 1 << 19, most: int = 1 << 11) -> list[tuple[int, int]]:
    """Stretches of pairs, whose rows are ``sizes`` in descending order, of about ``cells`` limbs each."""
    out, at = [], 0
    while at < len(sizes):
        end = min(len(sizes), at + max(16 * limbs, min(most, cells // max(1, sizes[at] * limbs))))
        out.append((at, end))
        at = end
    return out

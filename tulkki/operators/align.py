"""Word alignment (M1) and edit distance (M7).

M1 follows one fixed tie rule so that hits (and hence WIL) are reproducible:
common prefix and suffix are trimmed as hits, then on the unit-cost matrix
D[i][j] (i over reference words, j over hypothesis words) the traceback from
the end takes a deletion when D[i][j] = D[i-1][j] + 1, else an insertion when
D[i][j-1] = D[i-1][j-1] - 1, else the diagonal.

The matrix is never materialised as numbers: the bit-parallel recurrence
(Myers / Hyyro) gives, per reference word, the horizontal +1 / -1 deltas of a
whole row as two integers, which is all the traceback needs.  The rows of
pairs of ordinary length are kept.  Of longer ones only the start
states of blocks of rows are, and each block but the last that the
traceback enters is computed again, so memory stays about 2 * sqrt(n) * m bits while the result is
exact for any length.  Of pairs of ordinary length many advance together
(``bits``), with the same deltas and the same traceback.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki.operators.bits import advance, bit, chunks, numbered, stacked

ALIGN_TYPE = T.StructType([
    T.StructField("hits", T.LongType()),
    T.StructField("subs", T.LongType()),
    T.StructField("dels", T.LongType()),
    T.StructField("ins", T.LongType()),
])


def _rows(places, mask, up, down, keep=None):
    """Advance the bit-parallel recurrence over reference words, each given by its ``places`` in the hypothesis.

    ``up`` and ``down`` are the +1 and -1 deltas along the row; ``keep`` gets those down the columns."""
    for x in places:
        x |= down
        same = ((((x & up) + up) ^ up) | x) & mask
        more = down | (same | up) ^ mask
        less = same & up
        if keep is not None:
            keep.append((more, less))
        # the bits beyond the row go with the mask
        more = more << 1 | 1
        up = (less << 1 | ~(same | more)) & mask
        down = more & same
    return up, down


# rows times columns of a matrix whose rows are kept
_KEPT = 1 << 26


def _trimmed(ref: list, hyp: list) -> tuple[list, list, int]:
    """Both sides without their common start and end, and how many words these have."""
    n, m = len(ref), len(hyp)
    lim = min(n, m)
    pre = 0
    while pre < lim and ref[pre] == hyp[pre]:
        pre += 1
    suf = 0
    while suf < lim - pre and ref[n - 1 - suf] == hyp[m - 1 - suf]:
        suf += 1
    return ref[pre:n - suf], hyp[pre:m - suf], pre + suf


def _hits_and_cost(r: list, h: list) -> tuple[int, int]:
    """Hits and distance of two trimmed lists."""
    n, m = len(r), len(h)
    if n == 0 or m == 0:
        return 0, n + m
    hits = 0
    pm: dict = {}
    for j, w in enumerate(h):
        pm[w] = pm.get(w, 0) | (1 << j)
    mask = (1 << m) - 1
    places = [pm.get(w, 0) for w in r]
    block = n if n * m <= _KEPT else max(64, math.isqrt(n))
    starts, rows = [], []
    up, down = mask, 0
    for b in range(0, n, block):
        starts.append((up, down))
        # the traceback starts with the last block's rows
        up, down = _rows(places[b:b + block], mask, up, down, rows if b + block >= n else None)
    # the last cell: down the first column, then along the last row
    cost = n + up.bit_count() - down.bit_count()
    # traceback, one block of rows at a time from the last
    i, j = n, m
    for bi in range(len(starts) - 1, -1, -1):
        b0 = bi * block
        if bi < len(starts) - 1:
            rows = []
            _rows(places[b0:b0 + block], mask, *starts[bi], rows)
        while i > b0 and j > 0:
            hp, hn = rows[i - 1 - b0]
            if hp >> j - 1 & 1:
                i -= 1
            elif j >= 2 and hn >> j - 2 & 1:
                j -= 1
            else:
                i -= 1
                j -= 1
                hits += r[i] == h[j]
        if j == 0:
            break
    return hits, cost


def _hits_and_costs(refs: list[list], hyps: list[list], limbs: int) -> tuple[list[int], list[int]]:
    """``_hits_and_cost`` of many pairs, longest ``refs`` first, with at most 64 * ``limbs`` words in each of ``hyps``."""
    places = stacked(refs, hyps, limbs)
    i, j = (np.array([len(x) for x in side]) for side in (refs, hyps))
    cost, (more, less) = advance(places, i, j, ("more", "less"))
    hits, p = np.zeros(len(refs), np.int64), np.arange(len(refs))
    while p.size:
        up = bit(more, i - 1, j - 1, p)
        left = ~up & (j > 1) & bit(less, i - 1, np.maximum(j - 2, 0), p)
        across = ~(up | left)
        hits[p] += across & bit(places, i - 1, j - 1, p)
        i, j = i - ~left, j - ~up
        on = (i > 0) & (j > 0)
        i, j, p = i[on], j[on], p[on]
    return hits.tolist(), cost.tolist()


def _counts(n: int, m: int, hits: int, cost: int) -> tuple[int, int, int, int]:
    subs = n + m - 2 * hits - cost
    return hits, subs, n - hits - subs, m - hits - subs


def align_words(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """Return (hits, substitutions, deletions, insertions) for two word lists."""
    r, h, hits = _trimmed(ref, hyp)
    more, cost = _hits_and_cost(r, h)
    return _counts(len(ref), len(hyp), hits + more, cost)


# the numbers of limbs of the pairs that advance together; wider ones are as fast one by one
_WIDTHS = [1, 2, 3, 4, 6, 8, 12, 16]


def align_many(pairs: list[tuple[list, list]]) -> list[tuple[int, int, int, int]]:
    """``align_words`` of each pair: those of like width advance together, the others one by one."""
    out: list = [None] * len(pairs)
    groups = defaultdict(list)
    for k, (ref, hyp) in enumerate(numbered(pairs)):
        r, h, hits = _trimmed(ref, hyp)
        if not r or not h:
            out[k] = _counts(len(ref), len(hyp), hits, len(r) + len(h))
        else:
            groups[next((x for x in _WIDTHS if len(h) <= 64 * x), 0)].append((k, r, h, hits))
    for limbs, group in groups.items():
        group.sort(key=lambda x: -len(x[1]))
        for a, b in chunks([len(x[1]) for x in group], limbs or 1):
            part = group[a:b]
            _, refs, hyps, _ = zip(*part, strict=True)
            # few pairs, or such that need much memory for their rows, go one by one, too
            if not limbs or len(part) < 8 * limbs or len(refs[0]) * limbs * len(part) > 1 << 22:
                found = [_hits_and_cost(r, h) for r, h in zip(refs, hyps, strict=True)]
            else:
                found = zip(*_hits_and_costs(refs, hyps, limbs), strict=True)
            for (k, _, _, hits), (more, cost) in zip(part, found, strict=True):
                out[k] = _counts(len(pairs[k][0]), len(pairs[k][1]), hits + more, cost)
    return out


def _align_batch(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    out = align_many([(list(a) if a is not None else [], list(b) if b is not None else []) for a, b in zip(ref, hyp, strict=True)])
    return pd.DataFrame(out, columns=["hits", "subs", "dels", "ins"], dtype="int64")


align_counts_udf = F.pandas_udf(_align_batch, ALIGN_TYPE)


def _align_text_batch(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    # some thousand pairs at a time, as their words take more memory than the texts
    out = []
    for at in range(0, len(ref), 2000):
        part = zip(ref[at:at + 2000], hyp[at:at + 2000], strict=True)
        out += align_many([(a.split() if a else [], b.split() if b else []) for a, b in part])
    return pd.DataFrame(out, columns=["hits", "subs", "dels", "ins"], dtype="int64")


align_texts_udf = F.pandas_udf(_align_text_batch, ALIGN_TYPE)


def align_texts(ref_text, hyp_text) -> Column:
    """M1 on two whitespace-tokenised texts (cheaper Arrow transfer than word arrays)."""
    r = F.col(ref_text) if isinstance(ref_text, str) else ref_text
    h = F.col(hyp_text) if isinstance(hyp_text, str) else hyp_text
    return F.when(r.isNotNull() | h.isNotNull(), align_texts_udf(r, h))


def align_counts(ref_words, hyp_words) -> Column:
    """M1: struct<hits, subs, dels, ins> for two array<string> columns (Arrow UDF)."""
    r = F.col(ref_words) if isinstance(ref_words, str) else ref_words
    h = F.col(hyp_words) if isinstance(hyp_words, str) else hyp_words
    empty = F.array().cast("array<string>")
    # the guard also keeps the UDF call in a form Catalyst always extracts
    return F.when(r.isNotNull() | h.isNotNull(),
                  align_counts_udf(F.coalesce(r, empty), F.coalesce(h, empty)))


def word_distance(counts) -> Column:
    """M7: word-level edit distance, read off the alignment counts."""
    c = F.col(counts) if isinstance(counts, str) else counts
    return c["subs"] + c["dels"] + c["ins"]

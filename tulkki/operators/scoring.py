"""One pass over pairs of texts: alignment counts, METEOR matches and TER edits.

A pair is one row, so all that its metrics count is taken in one Arrow-batched
UDF, without a shuffle; ratios and corpus sums are columns and aggregates on
what it returns.  Small Arrow batches are scored together, as many pairs advance
at once, and equal pairs that come near each other are scored once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki.functions.stem import stem
from tulkki.operators.align import align_many
from tulkki.operators.metrics import METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA
from tulkki.operators.ter import TerLimits, ter_many

SCORES = ["hits", "subs", "dels", "ins", "ref_len", "hyp_len", "matches", "chunks", "ter_edits"]
SCORE_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in SCORES])


def meteor_counts(ref: list[str], hyp: list[str], stems: bool | dict[str, str] = False, synonyms: dict[str, list[str]] | None = None) -> tuple[int, int]:
    """(matches, chunks) of METEOR's stages: equal words, equal stems, synonyms.

    In each stage hypothesis words, the last first, take the last reference
    word that is left and fits; later stages see what is left over.
    ``stems`` may give the stems of the words that need one; ``synonyms``
    lists, for a hypothesis word, the words that it may stand for.
    """
    root = (lambda w: stems.get(w, w)) if isinstance(stems, dict) else stem
    pairs: dict[int, int] = {}
    left_ref, left_hyp = list(range(len(ref))), list(range(len(hyp)))
    stages = [lambda w: [w]]
    if stems:
        stages.append(lambda w: [root(w)])
    if synonyms:
        stages.append(lambda w: synonyms.get(w, []))
    for number, keys in enumerate(stages):
        places = defaultdict(list)
        for r in left_ref:
            places[root(ref[r]) if stems and number == 1 else ref[r]].append(r)
        taken = set()
        for h in reversed(left_hyp):
            best = max((places[k] for k in keys(hyp[h]) if places.get(k)), key=lambda p: p[-1], default=None)
            if best:
                pairs[h] = best.pop()
                taken.add(pairs[h])
        left_hyp = [h for h in left_hyp if h not in pairs]
        left_ref = [r for r in left_ref if r not in taken]
    return len(pairs), sum(pairs.get(h - 1) != r - 1 or h - 1 not in pairs for h, r in pairs.items())


# characters of texts that are scored together, whose words take more memory than they do, and pairs in a group of batches
_MOST_CHARS, _MOST_PAIRS = 1 << 22, 1 << 14


def _size(pair: tuple[str | None, str | None]) -> int:
    return len(pair[0] or "") + len(pair[1] or "") + 1


def _groups(batches: Iterator[list]) -> Iterator[list[list]]:
    """Batches of pairs put together up to the bounds above; a batch is a group at least."""
    group, chars, count = [], 0, 0
    for batch in batches:
        group.append(batch)
        chars += sum(map(_size, batch))
        count += len(batch)
        if chars >= _MOST_CHARS or count >= _MOST_PAIRS:
            yield group
            group, chars, count = [], 0, 0
    if group:
        yield group


def _scored(batches: Iterator[list], score: Callable[[list], list]) -> Iterator[list]:
    """What ``score`` gives for the pairs of each batch; it gets each pair once, as far as the texts of some groups are kept."""
    known: dict = {}
    for group in _groups(batches):
        new = list(dict.fromkeys(pair for batch in group for pair in batch if pair not in known))
        at = 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and chars < _MOST_CHARS:
                chars += _size(new[end])
                end += 1
            known.update(zip(new[at:end], score(new[at:end]), strict=True))
            at = end
        for batch in group:
            yield [known[pair] for pair in batch]
        if sum(map(_size, known)) > 2 * _MOST_CHARS:
            known.clear()


def pair_scores(ref_text, hyp_text, meteor: bool = True, ter: bool = True, stems: bool = False,
                synonyms: dict[str, list[str]] | None = None, limits: TerLimits = TerLimits(), words: bool = True) -> Column:
    """struct of ``SCORES`` for two normalised texts; what isn't asked for is NULL.

    NULL texts count as empty; where both are NULL, the struct is NULL.  A
    synonym table, if any, is part of the model and of fixed size.
    """
    def score(texts: list[tuple[str | None, str | None]]) -> list[tuple]:
        pairs = [(r.split() if r else [], h.split() if h else []) for r, h in texts]
        counts = align_many(pairs) if words else [(None,) * 4] * len(pairs)
        edits = [e for e, _ in ter_many([(h, r) for r, h in pairs], limits)] if ter else [None] * len(pairs)
        return [(*c, len(r), len(h), *(meteor_counts(r, h, stems, synonyms) if meteor else (None, None)), e)
                for (r, h), c, e in zip(pairs, counts, edits, strict=True)]

    def batch(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for rows in _scored((list(zip(*some, strict=True)) for some in columns), score):
            yield pd.DataFrame(rows, columns=SCORES, dtype="Int64")

    r = F.col(ref_text) if isinstance(ref_text, str) else ref_text
    h = F.col(hyp_text) if isinstance(hyp_text, str) else hyp_text
    return F.when(r.isNotNull() | h.isNotNull(), F.pandas_udf(batch, SCORE_TYPE)(r, h))


def meteor_score(scores) -> Column:
    """M4: F-mean of precision and recall, less the penalty for scattered matches; 0 without matches."""
    s = F.col(scores) if isinstance(scores, str) else scores
    m = s["matches"].cast("double")
    p, r = m / s["hyp_len"], m / s["ref_len"]
    mean = p * r / (METEOR_ALPHA * p + (1 - METEOR_ALPHA) * r)
    return F.when(s["matches"] > 0, mean * (1 - METEOR_GAMMA * F.pow(s["chunks"] / m, METEOR_BETA))).otherwise(F.when(s.isNotNull(), 0.0))

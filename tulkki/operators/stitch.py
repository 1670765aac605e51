"""B5, second half: the outputs of overlapping chunks put together again.

A chunked model gives one output for each chunk, and neighbours both have the
words of their overlap.  For each boundary the longest overlap is sought of
the end of one output with the start of the next, no longer than the strides
allow.  It is cut in the middle: the words nearest to a chunk's edge, where a
model sees the least, give way to the neighbour's.

A boundary needs the last words of one chunk and the first words of the next
only.  These travel as narrow rows keyed by (recording, boundary), so that a
recording of any length is spread over tasks; nothing is gathered until the
text of a whole recording is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tulkki.functions.columns import materialize


def _longest_overlap(most: int, least_share: float) -> Column:
    """The greatest length at which enough words of the end of ``tail`` equal those at the start of ``head``; 0 if none."""
    def fits(n: Column) -> Column:
        pairs = F.zip_with(F.slice("tail", F.size("tail") - n + 1, n), F.slice("head", F.lit(1), n), lambda a, b: a == b)
        return F.size(F.filter(pairs, lambda same: same)) >= n * F.lit(float(least_share))

    lengths = F.filter(F.array(*[F.lit(n) for n in range(1, most + 1)]), lambda n: (n <= F.size("tail")) & (n <= F.size("head")))
    return F.coalesce(F.array_max(F.filter(lengths, fits)), F.lit(0))


def stitch_chunks(chunks: DataFrame, keys: list[str], overlap: int, words: str = "words", least_share: float = 1.0) -> DataFrame:
    """What each chunk contributes to the text of its recording.

    ``chunks``: keys, chunk_no (consecutive from 0) and the model's output as
    an array of ``words``.  Returns keys, chunk_no, dropped_left,
    dropped_right and the words that stay.

    The overlap of two neighbours is the longest, of at most ``overlap``
    words (both strides), in which ``least_share`` of the words are equal, one
    by one; at 1 it is the longest end of the one that starts the other.  Half
    of it is dropped on each side; where there is none, nothing is.  A null
    output (a failed chunk) is an empty one, and null keys are keys.
    """
    key = F.struct(*keys)
    rows = chunks.select(key.alias("k"), "chunk_no", F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    none = F.lit(None).cast("array<string>")
    tail = F.slice("w", F.greatest(F.size("w") - overlap, F.lit(0)) + 1, overlap)
    sides = F.array(F.struct(F.col("chunk_no").alias("boundary"), tail.alias("tail"), none.alias("head")),
                    F.struct((F.col("chunk_no") - 1).alias("boundary"), none.alias("tail"), F.slice("w", 1, overlap).alias("head")))
    boundaries = (rows.select("k", F.inline(sides)).groupBy("k", "boundary")
                  .agg(F.first("tail", ignorenulls=True).alias("tail"), F.first("head", ignorenulls=True).alias("head")))
    found = materialize(boundaries.where("tail IS NOT NULL AND head IS NOT NULL"), n=_longest_overlap(overlap, least_share)).where("n > 0")
    cut = F.array(F.struct(F.col("boundary").alias("chunk_no"), F.lit(0).alias("dropped_left"), F.expr("n div 2").cast("int").alias("dropped_right")),
                  F.struct((F.col("boundary") + 1).alias("chunk_no"), F.expr("n - n div 2").cast("int").alias("dropped_left"), F.lit(0).alias("dropped_right")))
    drops = found.select("k", F.inline(cut)).groupBy("k", "chunk_no").agg(*[F.sum(c).cast("int").alias(c) for c in ("dropped_left", "dropped_right")])
    joined = rows.join(drops, ["k", "chunk_no"], "left").fillna(0, ["dropped_left", "dropped_right"])
    stays = F.slice("w", F.col("dropped_left") + 1, F.size("w") - F.col("dropped_left") - F.col("dropped_right"))
    return joined.select(*[F.col("k")[c].alias(c) for c in keys], "chunk_no", "dropped_left", "dropped_right", stays.alias(words))


def stitched_text(stitched: DataFrame, keys: list[str], words: str = "words") -> DataFrame:
    """One row per recording: keys and its text, the words of all chunks in order (a recording's text is one row)."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_no", F.array_join(words, " ").alias("t"))))
    return stitched.where(F.size(words) > 0).groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("text"))

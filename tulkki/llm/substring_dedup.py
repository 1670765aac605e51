"""Substring dedup over a compacted De Bruijn graph of token k-mers.

An edge of the graph is a window of ``k`` consecutive words.  Storing one row
for every edge would cost many times the corpus, so edges are compacted where
they arise: each window takes the smallest hash among its ``m``-word grams
(its minimiser), and consecutive windows of a document with one minimiser
form one nonbranching run, stored as a single row with its source coordinate
and the fingerprint of its words.  Equal windows have equal minimisers, so
every repeat is found among the runs of one minimiser:

* a join on the minimiser drops the runs whose minimiser is found in a single
  document (most of a corpus);
* runs with equal fingerprints are one path of the graph; all its
  occurrences but those in its first document are repeats as a whole;
* where one minimiser has several distinct runs, the graph branches inside
  them.  The windows of one occurrence of each run and document are read
  again at their source coordinates and joined window by window.

Per document the repeated runs and windows then merge into maximal spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise
from tulkki.llm.words import Prefix, Words, pieces, sliding_min

RUNS = "doc_id long, tag long, start int, n int, minimiser long, path long"
WINDOWS = "doc_id long, tag long, start int, minimiser long, window long"


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _runs(k: int, m: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            for lo, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                n = len(words.hash)
                if n < k:
                    continue
                sums = Prefix(words.hash, 1)
                at = np.arange(n - m + 1)
                least = sliding_min(sums.ranges(at, at + m), k - m + 1)
                valid = words.row[:n - k + 1] == words.row[k - 1:]
                opens = valid.copy()
                opens[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
                start = np.flatnonzero(opens)
                if not len(start):
                    continue
                # a run ends before the next one opens or the next invalid window
                close = np.flatnonzero(opens | ~valid)
                close = np.append(close, len(valid))
                end = close[np.searchsorted(close, start, "right")]
                rows = words.row[start]
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo + rows]), pa.array(tags[lo + rows]),
                    pa.array((start - words.first[rows]).astype(np.int32)),
                    pa.array((end - start).astype(np.int32)),
                    _signed(least[start]), _signed(sums.ranges(start, end + k - 1)),
                ], names=["doc_id", "tag", "start", "n", "minimiser", "path"])
    return task


def _windows(k: int):
    """The hashes of the windows of given runs, at their source coordinates."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "tag"))
            runs = batch.column("runs")
            bounds = runs.offsets.to_numpy()
            start, count, least = (x.to_numpy(zero_copy_only=False) for x in runs.flatten().flatten())
            base = bounds[0]
            for lo, hi, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                mine = slice(bounds[lo] - base, bounds[hi] - base)
                row = np.repeat(np.arange(hi - lo), np.diff(bounds[lo:hi + 1]))
                n = count[mine].astype(np.int64)
                first = np.repeat(start[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                at = first + np.arange(n.sum())
                each = np.repeat(row, n)
                place = words.first[each] + at
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[lo + each]), pa.array(tags[lo + each]), pa.array(at.astype(np.int32)),
                    pa.array(np.repeat(least[mine], n)),
                    _signed(Prefix(words.hash, 2).ranges(place, place + k)),
                ], names=["doc_id", "tag", "start", "minimiser", "window"])
    return task


def repeated_spans(docs: DataFrame, k: int = 50, m: int = 16) -> DataFrame:
    """Word spans covered by a ``k``-word window that also starts in a document
    with a smaller ``doc_id``: (doc_id, tag, start, end), half-open, one row
    for each run or window (they may overlap).

    ``docs`` needs doc_id and text.  ``tag`` is a hash of the text, so that
    rows with one doc_id and different texts keep apart.  Null doc_ids have no
    order: they neither lose words nor make others lose any.  Null, empty and
    short texts (under ``k`` words) have no window.
    """
    if not 0 < m <= k:
        raise ValueError("m must be from 1 to k")
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = materialise(docs.mapInArrow(_runs(k, m), RUNS), "runs")

    shared = (runs.groupBy("minimiser")
              .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"),
                   (F.min("path") != F.max("path")).alias("branches"))
              .where("lo < hi").select("minimiser", "branches"))
    repeats = materialise(runs.join(shared, "minimiser"), "repeats")
    discard(runs)

    paths = repeats.groupBy("minimiser", "path").agg(F.min("doc_id").alias("source"))
    placed = materialise(repeats.join(paths, ["minimiser", "path"]).drop("path"), "placed")
    discard(repeats)
    whole = (placed.where("doc_id > source")
             .select("doc_id", "tag", "start", (F.col("start") + F.col("n") + (k - 1)).alias("end")))

    branching = (placed.where("branches AND doc_id = source")
                 .groupBy("doc_id", "tag").agg(F.collect_list(F.struct("start", "n", "minimiser")).alias("runs")))
    windows = materialise(docs.join(branching.hint("shuffle_hash"), ["doc_id", "tag"])
                          .select("doc_id", "tag", "text", "runs")
                          .mapInArrow(_windows(k), WINDOWS), "windows")
    firsts = (windows.groupBy("minimiser", "window")
              .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").drop("hi"))
    single = (windows.join(firsts, ["minimiser", "window"]).where("doc_id > lo")
              .select("doc_id", "tag", "start", (F.col("start") + k).alias("end")))
    return whole.unionByName(single)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, digest, kept_text = [], [], [], []
        for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
            words = text.as_buffer().to_pybytes().split() if text.is_valid else []
            kept = words
            if spans.is_valid:
                edge = np.zeros(len(words) + 1, np.int32)
                flat = spans.values.flatten()
                np.add.at(edge, flat[0].to_numpy(), 1)
                np.add.at(edge, flat[1].to_numpy(), -1)
                kept = [w for w, c in zip(words, np.cumsum(edge[:-1]), strict=True) if not c]
            out = b" ".join(kept)
            total.append(len(words))
            removed.append(len(words) - len(kept))
            digest.append(hashlib.sha256(out).hexdigest())
            kept_text.append(out.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
             pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, k: int = 50, m: int = 16) -> DataFrame:
    """Remove every word covered by a repeated ``k``-word window.

    One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text
    (the kept words joined by one space).  Other columns are left out, so
    clashing names don't matter.  A null text has no words; a null doc_id
    keeps all its words; rows repeated with their doc_id are one document and
    lose the same words; an empty table gives an empty result.
    """
    spans = (repeated_spans(docs, k, m).groupBy("doc_id", "tag")
             .agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    return (docs.select("doc_id", "text", F.xxhash64("text").alias("tag"))
            .join(spans.hint("shuffle_hash"), ["doc_id", "tag"], "left")
            .select("doc_id", "text", "spans")
            .mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).drop("kept_text")


OP1_SQL = """
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS k FROM w, unnest(range(1, len(ws) - 48)) u(i)),
firsts AS (SELECT k, min(doc_id) AS lo FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM windows JOIN firsts USING (k), range(50) r(d) WHERE doc_id > lo),
words AS (SELECT doc_id, i, ws[i] AS word FROM w, unnest(range(1, len(ws) + 1)) u(i)),
kept AS (
  SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY words.i) FILTER (WHERE g.i IS NULL) AS text
  FROM words LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

"""Line dedup through a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space with A-Z lower-cased.
Spark counts, for every distinct key, the documents that hold it.  The
distinct key hashes are dealt into shards of bounded size, and each shard
becomes an index of three arrays: the bit levels of a minimal perfect hash
(every key takes a slot of the first level where it collides with no other;
the rank of its bit is its index), a 32-bit fingerprint per key, and the
document counts.  Documents then probe the arrays: their key hashes travel to
the shard, stream past the arrays, and only the hits come back.  No line text
is shuffled, and no line is joined with a line.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise
from tulkki.llm.words import mix

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class PerfectHash:
    """Minimal perfect hash over distinct (hash, fingerprint) pairs.

    Level by level, a key sets a bit of an array twice as long as the keys
    that are left; keys that share a bit go on to the next level.  About 3.5
    bits a key, built and probed with array operations only.
    """

    GAMMA = 2.0

    def __init__(self, levels: list[np.ndarray], ranks: list[np.ndarray], sizes: list[int]):
        self.levels, self.ranks, self.sizes = levels, ranks, sizes

    @classmethod
    def of(cls, hashes: np.ndarray, marks: np.ndarray) -> PerfectHash:
        self, base = cls([], [], []), 0
        while len(hashes):
            size = max(64, int(len(hashes) * self.GAMMA)) + 63 & ~63
            slot = self._slot(hashes, marks, len(self.sizes), size)
            alone = np.bincount(slot, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little")
            words = alone.reshape(-1, 64).sum(axis=1)
            self.levels.append(bits)
            self.ranks.append((base + np.concatenate([[0], np.cumsum(words)[:-1]])).astype(np.uint32))
            self.sizes.append(size)
            base += int(words.sum())
            left = ~alone[slot]
            hashes, marks = hashes[left], marks[left]
        return self

    @staticmethod
    def _slot(hashes: np.ndarray, marks: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
        return (mix(mix(hashes + salt) + marks.astype(np.uint64) * (salt | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    def index(self, hashes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The index of each pair; of pairs that were not indexed, any index or -1."""
        out = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for level, (bits, ranks, size) in enumerate(zip(self.levels, self.ranks, self.sizes, strict=True)):
            if not len(left):
                break
            slot = self._slot(hashes[left], marks[left], level, size)
            hit = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            at = slot[hit]
            words = bits.view(np.uint64)[at >> 6]
            below = words & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            out[left[hit]] = ranks[at >> 6] + np.bitwise_count(below)
            left = left[~hit]
        return out


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _key_hashes(text: Column, min_chars: int) -> Column:
    """The distinct (hash, mark) of the keys of a text's lines that are long enough."""
    keys = F.array_distinct(F.transform(F.split(text, "\n", -1), line_key))
    keys = F.filter(keys, lambda x: F.char_length(x) >= min_chars)
    return F.transform(keys, lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("mark")))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    hashes, marks = pdf["h"].to_numpy().view(np.uint64), pdf["mark"].to_numpy().view(np.uint32)
    table = PerfectHash.of(hashes, marks)
    at = table.index(hashes, marks)
    prints, counts = np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
    prints[at], counts[at] = marks, pdf["docs"].to_numpy()
    if counts.max() < 1 << 32:
        counts = counts.astype(np.uint32)
    return pd.DataFrame({"shard": pdf["shard"].iloc[:1], "arrays": [pickle.dumps((table.levels, table.ranks, table.sizes, prints, counts))]})


def _probe(min_docs: int):
    """Rows come sorted by shard and salt, the arrays before the probes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = prints = counts = None
        for batch in batches:
            loads = np.append(np.flatnonzero(batch.column("arrays").is_valid().to_numpy(zero_copy_only=False)), batch.num_rows)
            done = 0
            for stop in loads:
                if stop > done:
                    part = batch.slice(done, stop - done)
                    hashes = part.column("h").to_numpy().view(np.uint64)
                    marks = part.column("mark").to_numpy().view(np.uint32)
                    at = table.index(hashes, marks)
                    hit = (at >= 0) & (prints[at] == marks) & (counts[at] >= min_docs)
                    yield part.select(["doc_id", "tag", "h", "mark"]).filter(pa.array(hit))
                if stop < batch.num_rows:
                    *parts, prints, counts = pickle.loads(batch.column("arrays")[stop].as_py())
                    table = PerfectHash(*parts)
                done = stop + 1
    return task


def _drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, digest, kept_text = [], [], [], []
        for text, lines, hits in zip(batch.column("text"), batch.column("lines"), batch.column("hits"), strict=True):
            parts = text.as_buffer().to_pybytes().split(b"\n") if text.is_valid else [b""]
            kept = parts
            if hits.is_valid:
                keys, bad = ((x[0].to_numpy().view(np.uint64) ^ x[1].to_numpy().astype(np.uint64) << np.uint64(32))
                             for x in (lines.values.flatten(), hits.values.flatten()))
                kept = [x for x, gone in zip(parts, np.isin(keys, bad), strict=True) if not gone]
            out = b"\n".join(kept)
            total.append(len(parts))
            dropped.append(len(parts) - len(kept))
            digest.append(hashlib.sha256(out).hexdigest())
            kept_text.append(out.decode())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("tag"), batch.column("carried"), pa.array(total, pa.int64()), pa.array(dropped, pa.int64()),
             pa.array(digest, pa.string()), pa.array(kept_text, pa.string())],
            names=["doc_id", "tag", "carried", "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, shard_keys: int, salts: int) -> DataFrame:
    """(doc_id, tag, h, mark) for each document's line keys found in ``min_docs`` documents."""
    probes = (docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tag"), F.explode(_key_hashes(F.col("text"), min_chars)).alias("k"))
              .select("doc_id", "tag", "k.h", "k.mark"))
    counts = materialise(probes.groupBy("h", "mark").agg(F.count("*").alias("docs")), "lines")
    shards = -(-counts.count() // shard_keys) or 1
    index = (counts.withColumn("shard", F.expr(f"CAST(pmod(h, {shards}) AS int)"))
             .groupBy("shard").applyInPandas(_build, "shard int, arrays binary"))
    index = materialise(index, "index")
    discard(counts)
    none = F.lit(None)
    loads = index.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "arrays",
                         none.cast("long").alias("doc_id"), none.cast("long").alias("tag"),
                         F.lit(0).cast("long").alias("h"), F.lit(0).alias("mark"))
    asked = probes.select(F.expr(f"CAST(pmod(h, {shards}) AS int)").alias("shard"),
                          F.expr(f"CAST(pmod(tag, {salts}) AS int)").alias("salt"), none.cast("binary").alias("arrays"),
                          "doc_id", "tag", "h", "mark")
    return (loads.unionByName(asked).repartition("shard", "salt")
            .sortWithinPartitions("shard", "salt", F.col("arrays").isNull())
            .mapInArrow(_probe(min_docs), "doc_id long, tag long, h long, mark int"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, shard_keys: int = 1 << 18, salts: int = 8,
               carry: list[str] | None = None) -> DataFrame:
    """Drop, in every document, the lines whose key is found in ``min_docs`` documents.

    One row per input row: doc_id, tag, n_lines, n_dropped, kept_sha256,
    kept_text.  ``tag`` is a hash of doc_id and text.  A null or empty text is
    one empty line, and is kept; keys under ``min_chars`` code points are never
    dropped.  Each row counts as a document, repeated rows and null doc_ids
    included.  Columns named by ``carry`` follow, others are left out, so
    clashing names don't matter; an empty table gives an empty result.  ``salts`` deals the probes of one line
    to several tasks, each with its copy of that shard's arrays.
    """
    carried = F.struct(*(carry or [F.lit(0).alias("nothing")]))
    docs = docs.select("doc_id", "text", carried.alias("carried"))
    hits = (frequent_lines(docs, min_docs, min_chars, shard_keys, salts)
            .distinct().groupBy(F.col("tag").alias("hit_tag")).agg(F.collect_list(F.struct("h", "mark")).alias("hits")))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1),
                        lambda x: F.struct(F.xxhash64(line_key(x)).alias("h"), F.hash(line_key(x)).alias("mark")))
    tagged = docs.withColumn("tag", F.xxhash64("doc_id", "text"))
    kind = docs.schema["carried"].dataType.simpleString()
    result = (tagged.join(hits.hint("shuffle_hash"), F.col("tag") == F.col("hit_tag"), "left")
              .select("doc_id", "tag", "carried", "text", lines.alias("lines"), "hits")
              .mapInArrow(_drop, f"doc_id long, tag long, carried {kind}, n_lines long, n_dropped long, kept_sha256 string, kept_text string"))
    return result.select("doc_id", "tag", "n_lines", "n_dropped", "kept_sha256", "kept_text", *[f"carried.`{c}`" for c in carry or []])


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return line_dedup(docs).drop("kept_text", "tag")


OP9_SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
keyed AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
bad AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(bad.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE bad.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN bad ON keyed.k = bad.k GROUP BY doc_id
"""

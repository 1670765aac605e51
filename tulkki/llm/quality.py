"""Quality filter by perplexity under an interpolated modified Kneser-Ney model.

The model counts byte n-grams (the order is a parameter) of trusted text, one
model for each language.  All its tables - n-grams with their counts or, below
the highest order, the number of different bytes before them, and contexts
with what discounting leaves over - are DataFrames dealt by their key; nothing
of it is broadcast or held in one place.

Texts are packed once into compressed blocks of bounded size.  Each block asks
for its distinct n-grams, those are joined with the count tables order by
order, and the answers go back to the block, where each document adds up its
own.  So what travels is the distinct n-grams of each block, not those of each
document, and texts travel once, compressed.

A document is kept if its perplexity is at most a quantile of its language,
taken over trusted documents that the model hasn't seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tulkki.llm.language_id import held_out_fold
from tulkki.llm.store import broadcast_if_few, materialise
from tulkki.llm.words import pieces

BLOCK = "block long, docs binary"


def _pack(block_bytes: int):
    """Cut the rows of a task into blocks of about ``block_bytes`` of text."""
    def write(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as out:
            for x in rows:
                out.write_batch(x)
        # the block's number: where its first row comes from
        first = rows[0].column("row")[0].as_py()
        return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "docs"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for lo, hi, data, _ in pieces(batch.column("text"), 1 << 20):
                if held and size + len(data) > block_bytes:
                    yield write(held)
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += len(data)
        if held:
            yield write(held)
    return task


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(block, rows) for the parts of each block."""
    for batch in batches:
        for block, docs in zip(batch.column("block").to_pylist(), batch.column("docs"), strict=True):
            with pa.ipc.open_stream(docs.as_buffer()) as stream:
                for rows in stream:
                    yield block, rows


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte, as a number with the last byte lowest, and its row.  Texts begin after zeros."""
    offsets = offsets.astype(np.int64) - int(offsets[0])
    lengths = np.diff(offsets)
    row = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], lengths)
    key = data.astype(np.int64)
    for back in range(1, order):
        earlier = np.zeros(len(data), np.int64)
        earlier[back:] = data[:-back] if back < len(data) else data[:0]
        key += np.where(place >= back, earlier, 0) << 8 * back
    return key, row


class _Tally:
    """Distinct (lang, n-gram) with counts; merged as it grows."""

    def __init__(self):
        self.parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def add(self, lang: np.ndarray, key: np.ndarray) -> None:
        for one in np.unique(lang):
            held = self.parts.setdefault(int(one), [])
            held.append(np.unique(key[lang == one], return_counts=True))
            if len(held) == 16:
                held[:] = [self._merged(held)]

    @staticmethod
    def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return key, np.bincount(at, weights=np.concatenate([c for _, c in held]), minlength=len(key)).astype(np.int64)

    def batches(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for lang, held in self.parts.items():
            key, count = self._merged(held)
            for lo in range(0, len(key), 1 << 16):
                yield lang, key[lo:lo + (1 << 16)], count[lo:lo + (1 << 16)]


def _counts(order: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally()
        for _, rows in _unpack(batches):
            rows = rows.filter(rows.column("learn"))
            lang = rows.column("lang_key").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in pieces(rows.column("text")):
                key, row = grams(data, offsets, order)
                tally.add(lang[lo + row], key)
        for lang, key, count in tally.batches():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang)), pa.array(key), pa.array(count)], names=["lang_key", "key", "c"])
    return task


def _asked(order: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> Iterator[pa.RecordBatch]:
            for lang, key, _ in tally.batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(np.full(len(key), lang)), pa.array(key)],
                                                 names=["block", "lang_key", "key"])
        block, tally = None, _Tally()
        for now, rows in _unpack(batches):
            if now != block:
                if block is not None:
                    yield from flush()
                block, tally = now, _Tally()
            lang = rows.column("lang_key").to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in pieces(rows.column("text")):
                key, row = grams(data, offsets, order)
                tally.add(lang[lo + row], key)
        if block is not None:
            yield from flush()
    return task


def _score(order: int):
    """Rows come sorted by block, a block's answers before its documents."""
    def scored(rows: pa.RecordBatch, table: dict[int, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lang = rows.column("lang_key").to_numpy(zero_copy_only=False)
        sums, size = np.zeros(rows.num_rows), np.zeros(rows.num_rows, np.int64)
        for lo, hi, data, offsets in pieces(rows.column("text")):
            key, row = grams(data, offsets, order)
            size[lo:hi] = np.diff(offsets)
            of = lang[lo + row]
            log = np.zeros(len(key))
            for one in np.unique(of):
                known, values = table[int(one)]
                mine = of == one
                log[mine] = values[np.searchsorted(known, key[mine])]
            sums[lo:hi] = np.bincount(row, weights=log, minlength=hi - lo)
        perplexity = pa.array(np.exp(-sums / np.maximum(size, 1)), mask=size == 0)
        return pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("doc_id", "lang", "lang_key", "trusted", "learn")), perplexity],
                                          names=["doc_id", "lang", "lang_key", "trusted", "learn", "perplexity"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            done = 0
            for at in np.flatnonzero(batch.column("docs").is_valid().to_numpy(zero_copy_only=False)):
                held.append(batch.slice(done, at - done).select(["lang_key", "key", "log"]))
                done = at + 1
                langs, keys, logs = (np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("lang_key", "key", "log"))
                held, table = [], {}
                for one in np.unique(langs):
                    mine = np.flatnonzero(langs == one)
                    mine = mine[np.argsort(keys[mine])]
                    table[int(one)] = keys[mine], logs[mine]
                with pa.ipc.open_stream(batch.column("docs")[int(at)].as_buffer()) as stream:
                    for rows in stream:
                        yield scored(rows, table)
            held.append(batch.slice(done).select(["lang_key", "key", "log"]))
    return task


def _kneser_ney(counts: DataFrame, asked: DataFrame, order: int) -> DataFrame:
    """(lang_key, key, log): log probability of each asked n-gram's last byte after the others.

    ``counts`` (lang_key, key, c) are those of the highest order.  Order by
    order, p = max(c - D(c), 0) / S(context) + left(context) / S(context) x p
    of the n-gram without its first byte; D has three values for each
    language and order, from its counts of counts."""
    tables = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")
        tables[k] = materialise(tables[k + 1].select("lang_key", suffix).groupBy("lang_key", "key").agg(F.count("*").alias("c")), f"order{k}")
    lower = None
    for k in range(1, order + 1):
        table = tables[k]
        n = [F.count_if(F.col("c") == i).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        # where a count of counts is zero, or the estimate leaves (0, i), the discount is half a count for each
        steps = [F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}"))) for i in (1, 2, 3)]
        d = [F.when((s > 0) & (s < i), s).otherwise(i / 2).alias(f"d{i}") for i, s in zip((1, 2, 3), steps, strict=True)]
        discounts = table.groupBy("lang_key").agg(*n).select("lang_key", *d)
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        context = F.shiftright("key", 8)
        # one row for each language
        rows = table.join(broadcast_if_few(discounts), "lang_key").select("lang_key", "key", "c", cut.alias("d"))
        contexts = rows.groupBy("lang_key", context.alias("context")).agg(F.sum("c").alias("s"), F.sum("d").alias("left"))
        wanted = asked.select("lang_key", F.col("key").bitwiseAND((1 << 8 * k) - 1).alias("key")).distinct()
        found = (wanted.withColumn("context", context).join(rows, ["lang_key", "key"], "left").join(contexts, ["lang_key", "context"], "left"))
        if lower is None:
            found = found.withColumn("below", F.lit(1 / 256))
        else:
            found = (found.withColumn("suffix", F.col("key").bitwiseAND((1 << 8 * (k - 1)) - 1))
                     .join(lower.select("lang_key", F.col("key").alias("suffix"), F.col("p").alias("below")), ["lang_key", "suffix"]))
        p = F.coalesce((F.col("c") - F.col("d")) / F.col("s"), F.lit(0.0)) + F.coalesce(F.col("left") / F.col("s"), F.lit(1.0)) * F.col("below")
        lower = materialise(found.select("lang_key", "key", p.alias("p")), f"p{k}")
    return lower.select("lang_key", "key", F.log("p").alias("log"))


def quality(docs: DataFrame, labels: DataFrame, order: int = 4, quantile: float = 0.99,
            block_bytes: int = 32 << 20) -> DataFrame:
    """Perplexity of every document and whether to keep it.

    One row per input row: doc_id, lang, perplexity (for a byte), threshold,
    keep.  Trusted are the documents all of whose ``labels`` have quality 1
    and not toxic 1; the model learns from those outside the held-out fold, the
    threshold of a language is the ``quantile`` of those in it (of all
    trusted ones, where the fold has none).  Null and empty texts
    have no perplexity and are not kept.  Documents of a language without
    trusted text (a null lang is a language too) have no threshold and are
    kept.  Repeated rows get a row each; null doc_ids are never trusted.
    Other columns are left out; empty tables give an empty result.
    """
    if not 1 < order <= 7:
        raise ValueError("order must be from 2 to 7")
    good = (labels.groupBy("doc_id").agg(F.min(F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1), F.lit(False))).alias("good"))
            .where("good").select(F.col("doc_id").alias("labelled")))
    rows = (docs.select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
            .join(broadcast_if_few(good), F.col("doc_id") == F.col("labelled"), "left")
            .select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", F.xxhash64("lang").alias("lang_key"),
                    F.col("labelled").isNotNull().alias("trusted"),
                    (F.col("labelled").isNotNull() & ~held_out_fold()).alias("learn"), "text"))
    blocks = materialise(rows.mapInArrow(_pack(block_bytes), BLOCK), "blocks")
    counts = (blocks.mapInArrow(_counts(order), "lang_key long, key long, c long")
              .groupBy("lang_key", "key").agg(F.sum("c").alias("c")))
    counts = materialise(counts, "counts")
    asked = materialise(blocks.mapInArrow(_asked(order), "block long, lang_key long, key long"), "asked")
    logs = _kneser_ney(counts, asked, order)
    none = F.lit(None)
    answers = (asked.join(broadcast_if_few(logs), ["lang_key", "key"])
               .select("block", "lang_key", "key", F.col("log").cast("float").alias("log"), none.cast("binary").alias("docs")))
    waiting = blocks.select("block", none.cast("long").alias("lang_key"), none.cast("long").alias("key"), none.cast("float").alias("log"), "docs")
    scored = (answers.unionByName(waiting).repartition("block").sortWithinPartitions("block", F.col("docs").isNotNull())
              .mapInArrow(_score(order), "doc_id long, lang string, lang_key long, trusted boolean, learn boolean, perplexity double"))
    scored = materialise(scored, "scored")
    # languages with a model
    limits = (scored.where("trusted AND perplexity IS NOT NULL").groupBy("lang_key")
              .agg(F.percentile_approx(F.when(~F.col("learn"), F.col("perplexity")), quantile, 10000).alias("unseen"),
                   F.percentile_approx("perplexity", quantile, 10000).alias("every"),
                   F.count_if("learn").alias("learned")).where("learned > 0")
              .select("lang_key", F.coalesce("unseen", "every").alias("threshold")))
    keep = F.when(F.col("perplexity").isNull(), False).otherwise(F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)))
    return scored.join(broadcast_if_few(limits), "lang_key", "left").select("doc_id", "lang", "perplexity", "threshold", keep.alias("keep"))


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality(docs, labels)

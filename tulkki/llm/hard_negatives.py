"""Hard-negative mining by matrix products in a residue number system.

Vectors become integers.  A block of anchors meets a block of rows as one
float32 matrix product for each of several small primes: components are taken
modulo the prime, centred, and 64 of them at a time sum below 2**24, where
float32 is exact.  The residues of a score then give the score itself, signed
and exact, by Chinese remaindering in balanced mixed radix; the primes are as
many as the largest norm in the data asks for.

Two passes over the blocks select what is wanted: the best rows of the
anchor's label are its positives; then, for each positive, the best rows of
other labels whose score lies in a window below the positive's.  A task keeps
the few best of each anchor as it goes through its blocks, and Spark ranks
what the tasks found.

Anchors are dealt into groups of a fixed number of bytes (8 MB).  One group
at a time is sent to the tasks, so a scan neither shuffles the rows nor holds
more than a group, however many anchors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki.llm.store import discard, materialise

#: Odd primes of at most 1021, so that 64 products of centred residues stay within 2**24; their product exceeds 2**64.
PRIMES = (1021, 1019, 1013, 1009, 997, 991, 983)
STRETCH = 64

BLOCK = "grp long, dims int, ids binary, labels binary, tags binary, vectors binary, limits binary"
FOUND = "anchor_id long, tag long, place int, vec_id long, score long"
RESULT = T.StructType([T.StructField(n, t) for n, t in (
    ("anchor_id", T.LongType()), ("positive_id", T.LongType()), ("rank", T.IntegerType()),
    ("negative_id", T.LongType()), ("positive_score", T.LongType()), ("negative_score", T.LongType()))])


def enough_primes(bound: int) -> tuple[int, ...]:
    """As many primes as tell the integers from ``-bound`` to ``bound`` apart."""
    product = 1
    for n, p in enumerate(PRIMES, 1):
        product *= p
        if product > 2 * bound:
            return PRIMES[:n]
    raise ValueError("scores need more than 64 bits")


def _centred(x: np.ndarray, p: int) -> np.ndarray:
    half = (p - 1) // 2
    return (x + half) % p - half


def exact_products(a: np.ndarray, b: np.ndarray, primes: tuple[int, ...]) -> np.ndarray:
    """``a @ b.T`` of integer matrices, exact, from float32 products modulo each prime."""
    value, modulus = np.zeros((len(a), len(b)), np.int64), 1
    for p in primes:
        left, right = (_centred(m, p).astype(np.float32) for m in (a, b))
        residue = np.zeros(value.shape, np.int64)
        for lo in range(0, a.shape[1], STRETCH):
            residue += (left[:, lo:lo + STRETCH] @ right[:, lo:lo + STRETCH].T).astype(np.int64)
        # the next digit of the balanced mixed-radix number; the last sum is right modulo 2**64 and so is the score
        digit = _centred((residue - value) % p * pow(modulus % p, -1, p), p)
        value += digit * np.int64(modulus)
        modulus *= p
    return value


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the ``k`` highest allowed scores of each row, ties to the smaller column."""
    k = min(k, scores.shape[1])
    masked = np.where(allowed, scores, np.iinfo(np.int64).min)
    kth = np.partition(masked, -k, axis=1)[:, -k]
    rows, cols = np.nonzero((masked >= kth[:, None]) & allowed)
    order = np.lexsort((cols, -masked[rows, cols], rows))
    order = order[np.arange(len(order)) - np.searchsorted(rows, rows) < k]
    return rows[order], cols[order]


def _pack(size: int):
    """Blocks of up to ``size`` rows of one group and length, in the order of vec_id."""
    def block(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks().sort_by("vec_id")
        one = lambda c: t.column(c).combine_chunks()
        limits = one("limits").flatten().to_numpy().astype(np.int64) if "limits" in t.column_names else np.zeros(0, np.int64)
        raw = [one("vec_id").to_numpy(), one("label").to_numpy(), one("tag").to_numpy(), one("x").flatten().to_numpy().astype(np.int32), limits]
        return pa.RecordBatch.from_arrays([one("grp")[:1], one("dims")[:1], *[pa.array([r.tobytes()], pa.binary()) for r in raw]],
                                          names=["grp", "dims", "ids", "labels", "tags", "vectors", "limits"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[pa.RecordBatch]] = {}
        for batch in batches:
            key = np.stack([batch.column("grp").to_numpy(), batch.column("dims").to_numpy().astype(np.int64)], axis=1)
            for g in np.unique(key, axis=0):
                mine = batch.filter(pa.array((key == g).all(axis=1)))
                parts = held.setdefault(tuple(g), [])
                while mine.num_rows:
                    take = mine.slice(0, size - sum(p.num_rows for p in parts))
                    parts.append(take)
                    mine = mine.slice(take.num_rows)
                    if sum(p.num_rows for p in parts) == size:
                        yield block(parts)
                        parts.clear()
        for parts in held.values():
            if parts:
                yield block(parts)
    return task


class _Best:
    """The ``k`` best (score, vec_id) of each (anchor, place) of a block that were seen so far."""

    def __init__(self, k: int):
        self.k, self.slot = k, np.zeros(0, np.int64)
        self.ids = self.scores = self.slot

    def add(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        slot, ids, scores = (np.concatenate(x) for x in ((self.slot, slot), (self.ids, ids), (self.scores, scores)))
        order = np.lexsort((ids, -scores, slot))
        slot = slot[order]
        keep = np.arange(len(slot)) - np.searchsorted(slot, slot) < self.k
        self.slot, self.ids, self.scores = slot[keep], ids[order][keep], scores[order][keep]


class _Anchors:
    """A block of anchors as arrays."""

    def __init__(self, row):
        self.dims = row["dims"]
        self.ids, self.labels, self.tags, self.limits = (np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "tags", "limits"))
        self.vectors = np.frombuffer(row["vectors"], np.int32).reshape(len(self.ids), self.dims).astype(np.int64)


def _scan(group: Broadcast, primes: tuple[int, ...], positives: int, negatives: int, windowed: bool):
    """Every block of rows that a task reads, with every block of a group of anchors."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asking = [(_Anchors(row), _Best(negatives if windowed else positives)) for row in group.value]
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels, vectors = (np.frombuffer(batch.column(c)[i].as_buffer(), t)
                                        for c, t in (("ids", np.int64), ("labels", np.int64), ("vectors", np.int32)))
                dims = batch.column("dims")[i].as_py()
                vectors = vectors.reshape(len(ids), dims).astype(np.int64)
                for a, top in asking:
                    if a.dims != dims:
                        continue
                    scores = exact_products(a.vectors, vectors, primes)
                    same = a.labels[:, None] == labels[None, :]
                    if not windowed:
                        r, c = best(scores, same & (a.ids[:, None] != ids[None, :]), positives)
                        top.add(r * positives, ids[c], scores[r, c])
                        continue
                    limits = a.limits.reshape(len(a.ids), positives, 2)
                    for j in range(positives):
                        r, c = best(scores, ~same & (scores >= limits[:, j, :1]) & (scores <= limits[:, j, 1:]), negatives)
                        top.add(r * positives + j, ids[c], scores[r, c])
        for a, top in asking:
            at = top.slot // positives
            yield pa.RecordBatch.from_arrays([pa.array(a.ids[at]), pa.array(a.tags[at]), pa.array((top.slot % positives).astype(np.int32)),
                                              pa.array(top.ids), pa.array(top.scores)], names=["anchor_id", "tag", "place", "vec_id", "score"])
    return task


def _usable(vectors: DataFrame) -> DataFrame:
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(fine)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   scale: int = 256, block: int = 2048, anchor_block: int = 256, group_bytes: int = 8 << 20) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score):
    for each row of ``vectors`` (vec_id, label, embedding) where ``is_anchor``
    holds, its ``positives`` best other rows of the same label, and for each of
    them the ``negatives`` best rows of other labels whose score is from
    ``low`` to ``high`` per cent of the positive's.

    A score is the integer inner product of ``floor(scale x component)``; ties
    go to the smaller vec_id.  All are returned where there are fewer.  Rows
    with a null vec_id, label or vector, or with a null or non-finite
    component take no part; vectors of different lengths don't meet.  Rows
    that repeat all of vec_id, label and vector count once; rows with the vec_id of
    an anchor are never its positives, and of rows that share a vec_id and
    differ each counts.  Labels are integers.  Other columns may be used by
    ``is_anchor`` and are left out.  An empty table, or one without anchors,
    gives no rows.  Squared norms beyond 2**55 (after scaling) raise an error.
    The anchors of a group (``group_bytes``) pass through the driver to the tasks.
    """
    spark = vectors.sparkSession
    clean = _usable(vectors.withColumn("asks", F.coalesce(is_anchor, F.lit(False))))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + F.pow(F.abs(v.cast("double")) * scale + 1, F.lit(2.0)))
    bound = clean.agg(F.max(norm)).first()[0]
    if bound is None:
        return spark.createDataFrame([], RESULT)
    if bound > 1 << 55:
        raise ValueError("scores need more than 55 bits")
    primes = enough_primes(int(bound) + 1)

    floors = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("int"))
    rows = clean.select("vec_id", F.col("label").cast("long").alias("label"), "asks", F.size("embedding").alias("dims"), floors.alias("x")).distinct()
    rows = materialise(rows.withColumn("tag", F.xxhash64("label", "x")), "vectors")
    total, widest = rows.agg(F.count("*"), F.max("dims")).first()
    # by number, as a block's work is heavy however few its bytes
    parts = max(spark.sparkContext.defaultParallelism, -(-total // (8 * block)))
    blocks = (rows.withColumn("grp", F.lit(0).cast("long")).repartition(parts, "vec_id", "tag").mapInArrow(_pack(block), BLOCK))
    blocks = materialise(blocks, "blocks")
    asking = rows.where("asks")
    groups = -(-asking.count() * (widest + 16) * 4 // group_bytes)
    grouped = asking.withColumn("grp", F.pmod(F.xxhash64("vec_id", "tag"), F.lit(max(groups, 1))))
    anchors = materialise(grouped.repartition("grp").mapInArrow(_pack(anchor_block), BLOCK), "anchors")

    per_anchor = Window.partitionBy("anchor_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    per_positive = Window.partitionBy("anchor_id", "tag", "place").orderBy(F.col("score").desc(), "vec_id")
    results = []
    for g in range(groups):
        group = spark.sparkContext.broadcast(anchors.where(F.col("grp") == g).collect())
        found = blocks.mapInArrow(_scan(group, primes, positives, negatives, False), FOUND)
        chosen = (found.withColumn("r", F.row_number().over(per_anchor)).where(F.col("r") <= positives)
                  .select("anchor_id", "tag", (F.col("r") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
        chosen = materialise(chosen, "positives")
        # the window in whole numbers; a place without a positive gets an empty one
        window = F.struct("place", F.expr(f"-((-positive_score * {low} - pmod(-positive_score * {low}, 100)) div 100)").alias("lo"),
                          F.expr(f"(positive_score * {high} - pmod(positive_score * {high}, 100)) div 100").alias("hi"))
        windows = chosen.groupBy(F.col("anchor_id").alias("vec_id"), "tag").agg(F.collect_list(window).alias("w"))
        at = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda j: F.get(F.filter("w", lambda w: w["place"] == j), 0))
        limits = F.flatten(F.transform(at, lambda w: F.array(F.coalesce(w["lo"], F.lit(1)), F.coalesce(w["hi"], F.lit(0)))))
        again = grouped.where(F.col("grp") == g).join(windows, ["vec_id", "tag"]).select("grp", "vec_id", "label", "tag", "dims", "x", limits.alias("limits"))
        again = spark.sparkContext.broadcast(again.coalesce(1).mapInArrow(_pack(anchor_block), BLOCK).collect())
        near = blocks.mapInArrow(_scan(again, primes, positives, negatives, True), FOUND)
        ranked = near.withColumn("rank", F.row_number().over(per_positive)).where(F.col("rank") <= negatives)
        results.append(materialise(ranked.join(chosen, ["anchor_id", "tag", "place"])
                                   .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        discard(chosen)
        group.destroy()
        again.destroy()
    discard(rows, blocks, anchors)
    if not results:
        return spark.createDataFrame([], RESULT)
    out = results[0]
    for part in results[1:]:
        out = out.unionByName(part)
    return out


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
    CAST(list_dot_product(CAST(a.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id AND len(a.x) = len(c.x)),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

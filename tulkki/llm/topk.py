"""Exact top-k search with vector-approximation files.

Vectors become integers; equal vectors are one class with its smallest ids,
so copies are never scored twice.  The approximation file holds a cell
number (one byte at most) for each component of each class, packed in blocks.

* A scan of the file bounds every score from below and above: with ``y`` the
  query and a component in the cell ``[lo, hi]``, ``y x`` lies between
  ``min(y lo, y hi)`` and ``max(y lo, y hi)``.  The k-th best lower bound of
  a query cuts its candidates.
* Exact vectors are read in the order of their bounds.  After the first few
  the k-th exact score cuts the rest, and only candidates whose upper bound
  reaches it are read; no other vector can be among the best.

Queries are taken in blocks.  A block of queries meets a block of cells as
one matrix product; query blocks of a bounded number of bytes are broadcast at
a time, job by job, so the file is neither shuffled nor held in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise

CELLS = "dims int, keys binary, cells binary"
QUERIES = "dims int, number long, keys binary, vectors binary, floors binary"


def _clean(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dims, x array<long>): scaled and floored, without unusable rows."""
    big = float("inf")
    usable = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
    return (vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(usable)
            .select("vec_id", F.size("embedding").alias("dims"), F.transform("embedding", lambda v: F.floor(v.cast("double") * scale)).alias("x")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _pack_cells(low: int, width: int, block: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("dims").to_numpy()
            for dims in np.unique(every):
                part = batch.filter(pa.array(every == dims))
                for lo in range(0, part.num_rows, block):
                    some = part.slice(lo, block)
                    cells = ((_matrix(some.column("x"), dims) - low) // width).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays([pa.array([dims], pa.int32()), pa.array([some.column("key").to_numpy().tobytes()], pa.binary()),
                                                      pa.array([cells.tobytes()], pa.binary())], names=["dims", "keys", "cells"])
    return task


def _pack_queries(size: int):
    """Blocks of queries with their floors (-inf where none is known).  Rows come sorted by dims and number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("dims").to_numpy().astype(np.int64) << 40 | batch.column("number").to_numpy()
            for one in np.unique(group):
                part = batch.filter(pa.array(group == one))
                dims = part.column("dims")[0].as_py()
                for lo in range(0, part.num_rows, size):
                    some = part.slice(lo, size)
                    yield pa.RecordBatch.from_arrays([
                        some.column("dims")[:1], some.column("number")[:1], pa.array([some.column("key").to_numpy().tobytes()], pa.binary()),
                        pa.array([_matrix(some.column("x"), dims).tobytes()], pa.binary()),
                        pa.array([some.column("floor").to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary()),
                    ], names=["dims", "number", "keys", "vectors", "floors"])
    return task


def _scan(low: int, high: int, width: int, k: int, emit: str):
    """Bounds of every pair of a block of queries and a block of cells.

    ``emit`` "floors": the best ``k`` lower bounds of each query;
    "candidates": the classes whose upper bound reaches the query's floor.
    """
    starts = low + width * np.arange(256, dtype=np.float64)
    stops = np.minimum(starts + width - 1, high)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dims = batch.column("dims")[i].as_py()
                read = lambda c, t, i=i, b=batch: np.frombuffer(b.column(c)[i].as_buffer(), t)
                keys, queries, floors = read("keys", np.int64), read("q_keys", np.int64), read("floors", np.float64)
                cells = read("cells", np.uint8).reshape(len(keys), dims)
                y = read("vectors", np.int64).reshape(len(queries), dims).astype(np.float64)
                rise, fall = np.maximum(y, 0), np.minimum(y, 0)
                lo, hi = starts[cells].T, stops[cells].T
                if emit == "floors":
                    bound = rise @ lo + fall @ hi
                    take = min(k, len(keys))
                    bound = -np.partition(-bound, take - 1, axis=1)[:, :take]
                    q, value, found = np.repeat(queries, take), bound.ravel(), np.zeros(bound.size, np.int64)
                else:
                    bound = rise @ hi + fall @ lo
                    a, b = np.nonzero(bound >= floors[:, None])
                    q, value, found = queries[a], bound[a, b], keys[b]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(found), pa.array(value)], names=["q", "c", "bound"])
    return task


def _each_block(cells: DataFrame, queries: DataFrame, numbers: int, at_once: int, task, name: str) -> DataFrame:
    """Run ``task`` on every block of cells with every block of queries, ``at_once`` blocks of queries a job."""
    out = None
    for lo in range(0, numbers, at_once):
        chosen = F.broadcast(queries.where(F.col("number").between(lo, lo + at_once - 1)).withColumnRenamed("keys", "q_keys"))
        spread = cells.withColumn("number", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(min(lo + at_once, numbers) - 1).cast("long"))))
        part = spread.join(chosen, ["dims", "number"]).mapInArrow(task, "q long, c long, bound double")
        if numbers > at_once:
            part = materialise(part, name)
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(df: DataFrame, by: str, order: list[Column], most: int, name: str = "r") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= most)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, bits: int = 8, block: int = 2048,
          query_block: int = 256, blocks_at_once: int = 64, bytes_at_once: int = 8 << 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``vectors`` (vec_id,
    embedding) where ``is_query`` holds, the ``k`` other rows with the highest
    integer inner product of ``floor(scale x component)``, ties to the smaller
    vec_id, or all if there are fewer.

    Rows with a null vec_id, a null vector or a null or non-finite component
    take no part; vectors of different lengths don't meet.  Rows repeated with
    their vec_id count once.  Other columns may be used by ``is_query`` and
    are left out.  An empty table, or one without queries, gives no rows.
    Scaled components are expected below 2**20 in size, so that bounds are
    exact in doubles.  ``blocks_at_once`` blocks of queries, of no more than about
    ``bytes_at_once``, are broadcast at a time, each time in a job of its own.
    """
    rows = vectors.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    asks = rows.where("asks").select("vec_id").distinct()
    clean = _clean(rows, scale)
    first = clean.distinct().withColumn("i", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("i") <= k + 1)
    classes = first.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("dims").alias("dims"))
    classes = materialise(classes.withColumn("key", F.xxhash64("x", F.element_at("ids", 1))), "classes")
    low, high, widest = classes.agg(F.min(F.array_min("x")), F.max(F.array_max("x")), F.max("dims")).first()
    low, high = low or 0, high or 0
    at_once = max(1, min(blocks_at_once, bytes_at_once // (query_block * 8 * max(1, widest or 1))))
    width = -(-(high - low + 1) // (1 << bits))
    cells = materialise(classes.select("dims", "key", "x").mapInArrow(_pack_cells(low, width, block), CELLS), "cells")

    asked = materialise(clean.join(asks, "vec_id", "left_semi").distinct().join(classes.select("x", "key"), "x").select(F.col("vec_id").alias("query_id"), "key"), "asked")
    distinct = asked.select("key").distinct().join(classes.select("key", "dims", "x"), "key")
    # blocks by a hash of the key: about query_block queries each
    numbers = -(-distinct.count() // query_block) or 1
    numbered = materialise(distinct.withColumn("number", F.pmod(F.xxhash64("key"), F.lit(numbers))).withColumn("floor", F.lit(float("-inf"))), "numbered")

    def packed(df: DataFrame) -> DataFrame:
        return (df.select("dims", "number", "key", "x", "floor").repartition("number").sortWithinPartitions("dims", "number")
                .mapInArrow(_pack_queries(query_block), QUERIES))

    want = k + 1  # the query's own class is among them
    bounds = _each_block(cells, packed(numbered), numbers, at_once, _scan(low, high, width, want, "floors"), "floors")
    floors = _ranked(bounds, "q", [F.col("bound").desc()], want).where(F.col("r") == want).select(F.col("q").alias("key"), F.col("bound").alias("f"))
    cut = numbered.drop("floor").join(floors, "key", "left").withColumn("floor", F.coalesce("f", F.lit(float("-inf"))))
    cut = materialise(cut, "cut")
    found = materialise(_each_block(cells, packed(cut), numbers, at_once, _scan(low, high, width, want, "candidates"), "some"), "candidates")

    mine = classes.select(F.col("key").alias("q"), F.col("x").alias("y"))
    theirs = classes.select(F.col("key").alias("c"), "x", "ids")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0).cast("long"), lambda s, v: s + v)

    def read(pairs: DataFrame) -> DataFrame:
        return pairs.join(theirs, "c").join(mine, "q").select("q", "c", "ids", product.alias("score"))

    nearest = materialise(found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "c"))), "ordered")
    early = materialise(read(nearest.where(F.col("r") <= 2 * want)), "early")
    certain = _ranked(early, "q", [F.col("score").desc()], want).groupBy("q").agg(F.min("score").alias("kth"))
    late = read(nearest.where(F.col("r") > 2 * want).join(certain, "q").where("bound >= kth").select("q", "c"))
    best = _ranked(early.unionByName(late), "q", [F.col("score").desc(), F.element_at("ids", 1), F.col("c")], want)
    each = best.select("q", "score", F.explode("ids").alias("vec_id")).distinct()
    each = _ranked(each, "q", [F.col("score").desc(), F.col("vec_id")], want + 1)
    hits = asked.join(each.drop("r"), asked["key"] == each["q"]).where("vec_id != query_id").select("query_id", "vec_id", "score").distinct()
    discard(numbered)
    return _ranked(hits, "query_id", [F.col("score").desc(), F.col("vec_id")], k, "rank").select("query_id", "rank", "vec_id", "score")


def op2_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
"""

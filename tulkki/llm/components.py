"""Connected components of an undirected graph held as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("a").bitwiseXOR(F.col("b")).cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable.

    Alternates two contractions until nothing changes: every node points its
    larger neighbours, then its smaller ones, at the smallest it knows.  The
    number of rounds grows with the logarithm of the graph, and no
    neighbourhood is gathered: minima are partial aggregates, joined back.
    Loops and repeated edges are fine; a table without edges gives no rows.
    """
    current = materialise(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _summary(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialise(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a")
                 .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a != b").distinct())
        small = materialise(small, "small")
        discard(current, large)
        current, before, seen = small, seen, _summary(small)
        if before == seen:
            break
    return (current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))

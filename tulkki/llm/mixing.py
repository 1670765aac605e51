"""Mixing sources to target weights by pivotal dependent rounding.

Every document starts with the fraction of copies that its source's target
asks for.  Whole copies are certain; what is left is a probability.  Two
documents meet at a time: word mass moves from one to the other, in a random
direction with the odds that keep both expectations, until one of them is
integral (0 or 1 more copy).  The words of a source are kept exactly by every
meeting, so that a source ends within one document of its target.

A source's documents are dealt into blocks of bounded size, whatever the size
of the source.  Each block leaves one document undecided at most; these meet
in blocks of the next level, and so on up a reduction tree until a source has
one left, which is rounded to the nearer side.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tulkki.llm.store import broadcast_if_few, materialise

WORD = r"[^\x20\x09-\x0D]+"
STATE = "doc_id long, src int, size long, whole int, p double, u double, leaf long, open boolean"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """(source, src, source_size, target, docs) from rows (source, size).

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` of all words; a target stops at ``most`` times its source and
    the excess goes to the others by weight.  That ends where every source
    gets min(cap, weight x level) for one common level, which is read off the
    sources in order of the level at which each is full.  The windows run over
    one row for each source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    rows = (totals.withColumn("src", F.row_number().over(order) - 1)
            .withColumn("weight", F.get(listed, F.col("src") % len(weights)))
            .withColumn("cap", F.col("source_size") * F.lit(float(most)))
            .withColumn("full_at", F.col("cap") / F.col("weight")))
    everything = Window.partitionBy()
    upward = Window.orderBy("full_at", "src")
    fits = F.col("level") <= F.col("full_at")
    before = upward.rowsBetween(Window.unboundedPreceding, -1)
    onward = upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = (rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
            .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
            # the level is that of the first source, in this order, that it doesn't fill
            .withColumn("level", F.min(F.when(fits, F.struct("full_at", "src", "level"))).over(everything)["level"]))
    return rows.select("source", "src", "source_size", "docs",
                       F.least("cap", F.coalesce(F.col("weight") * F.col("level"), F.col("cap"))).alias("target"))


def _meet(pdf: pd.DataFrame) -> pd.DataFrame:
    """Settle the documents of one block; one at most stays open, the rest is integral."""
    pdf = pdf.sort_values(["size", "u", "doc_id", "leaf"], ascending=[False, True, True, True], ignore_index=True)
    mass = (pdf["p"] * pdf["size"]).to_numpy().copy()
    size, u = pdf["size"].to_numpy(float), pdf["u"].to_numpy()
    more, left = np.zeros(len(pdf), np.int32), np.zeros(len(pdf), bool)
    held = -1
    for i in range(len(pdf)):
        slack = 1e-9 * size[i]
        if mass[i] <= slack or mass[i] >= size[i] - slack:
            more[i] = mass[i] > slack
            continue
        if held < 0:
            held = i
            continue
        j = held
        to_j, to_i = min(size[j] - mass[j], mass[i]), min(mass[j], size[i] - mass[i])
        # the uniform number of the pair is fixed by both documents, so that reruns agree
        if (u[i] + u[j]) % 1.0 * (to_j + to_i) < to_i:
            mass[j] += to_j
            mass[i] -= to_j
        else:
            mass[j] -= to_i
            mass[i] += to_i
        held = -1
        for x in (j, i):
            slack = 1e-9 * size[x]
            if slack < mass[x] < size[x] - slack:
                held = x
            else:
                more[x] = mass[x] > slack
    if held >= 0:
        left[held] = True
    pdf["p"] = np.where(size > 0, mass / np.maximum(size, 1), 0.0)
    pdf["whole"] = (pdf["whole"].to_numpy() + more).astype(np.int32)
    pdf["open"] = left
    return pdf[["doc_id", "src", "size", "whole", "p", "u", "leaf", "open"]]


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
                block: int = 4096, seed: int = 17) -> DataFrame:
    """How often the mix takes each document.

    One row per input row: doc_id, size (words; a null text has none), source,
    source_size, target (its source's), copies, taken (copies x size).  Rows
    without words are never taken.  A null source is a source of its own; null
    and repeated doc_ids are rows like others (equal rows may swap their
    results).  Other columns are left out; an empty table gives an empty
    result.  The same rows and ``seed`` give the same mix in any partitioning.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("mark"))
    # equal rows are numbered by counting them, so that no row, however often it is repeated, ends in one block with all its copies
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies")).select("doc_id", "source", "size", "mark", F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    sizes = materialise(rows, "sizes")
    targets = materialise(source_targets(sizes, weights, share, most), "targets")
    fraction = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    hashed = F.xxhash64(F.lit(seed), "doc_id", "mark", "copy")
    state = (sizes.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
             .withColumn("f", fraction)
             .select("doc_id", "src", "size", F.floor("f").cast("int").alias("whole"), (F.col("f") - F.floor("f")).alias("p"),
                     ((F.xxhash64(hashed, F.lit(1)).bitwiseAND((1 << 53) - 1)) / F.lit(float(1 << 53))).alias("u"),
                     F.pmod(hashed, F.ceil(F.col("docs") / block).cast("long")).alias("leaf"),
                     F.lit(True).alias("open")))
    leaves = -(-(targets.agg(F.max("docs")).first()[0] or 0) // block)
    settled = []
    while True:
        done = materialise(state.groupBy("src", "leaf").applyInPandas(_meet, STATE), "met")
        settled.append(done.where("NOT open"))
        if leaves <= 1:
            settled.append(done.where("open").withColumn("whole", (F.col("whole") + (F.col("p") >= 0.5).cast("int")).cast("int")))
            break
        leaves = -(-leaves // block)
        state = done.where("open").withColumn("leaf", F.expr(f"leaf div {block}"))
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    result = result.withColumn("copies", F.when(F.col("size") > 0, F.col("whole")).otherwise(0))
    return (result.join(broadcast_if_few(targets.drop("docs")), "src")
            .select("doc_id", "size", "source", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).cast("long").alias("taken")))


def op4_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")

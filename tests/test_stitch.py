"""B5 stitching: chunk, map, stitch gives the text back, and overlaps follow their definition."""

import random

import pytest

from pyspark.sql import functions as F

from tulkki.operators.infer import chunk_items, overlap_chunks
from tulkki.operators.stitch import stitch_chunks, stitched_text


def chunked(spark, docs, size=30, left=4, right=2):
    df = spark.createDataFrame(docs, "rec string, ws array<string>")
    return (df.select("rec", "ws", F.explode(overlap_chunks("ws", size, left, right)).alias("c"))
            .select("rec", "c.*", chunk_items("ws", "c.start", size).alias("words")))


def texts(stitched):
    return {r["rec"]: r["text"] for r in stitched_text(stitched, ["rec"]).collect()}


@pytest.mark.parametrize("size,left,right", [(30, 4, 2), (8, 3, 3), (5, 1, 0)])
def test_identity_model_gives_the_text_back(spark, size, left, right):
    rng = random.Random(size)
    docs = [(f"r{n}", [f"w{rng.randrange(1 + n)}" for _ in range(n)]) for n in (1, 2, 5, 6, 7, 23, 24, 25, 30, 31, 54, 55, 200)] + [(None, ["a", "b"])]
    got = texts(stitch_chunks(chunked(spark, docs, size, left, right).repartition(5), ["rec"], left + right))
    assert got == {rec: " ".join(ws) for rec, ws in docs}


def brute(outputs, most, share):
    """Pairwise overlaps in order, each cut in the middle."""
    drops = [[0, 0] for _ in outputs]
    for k, (a, b) in enumerate(zip(outputs, outputs[1:], strict=False)):
        fits = [n for n in range(1, min(most, len(a), len(b)) + 1) if sum(x == y for x, y in zip(a[-n:], b[:n], strict=True)) >= n * share]
        if fits:
            drops[k][1], drops[k + 1][0] = max(fits) // 2, max(fits) - max(fits) // 2
    return [(k, lo, hi, w[lo:len(w) - hi]) for k, (w, (lo, hi)) in enumerate(zip(outputs, drops, strict=True))]


@pytest.mark.parametrize("share", [1.0, 0.6])
def test_overlaps_against_brute_force(spark, share):
    rng = random.Random(11)
    recs = {f"r{i}": [[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(1, 12))] for i in range(40)}
    rows = [(rec, k, words) for rec, outs in recs.items() for k, words in enumerate(outs)]
    df = spark.createDataFrame(rows, "rec string, chunk_no long, words array<string>").repartition(6)
    got = {}
    for r in stitch_chunks(df, ["rec"], 6, least_share=share).collect():
        got.setdefault(r["rec"], []).append((r["chunk_no"], r["dropped_left"], r["dropped_right"], r["words"]))
    assert {k: sorted(v) for k, v in got.items()} == {rec: brute(outs, 6, share) for rec, outs in recs.items()}


def test_failed_chunk_is_empty_and_no_overlap_drops_nothing(spark):
    df = spark.createDataFrame([("a", 0, ["x", "y"]), ("a", 1, None), ("a", 2, ["y", "z"]), ("b", 0, ["p"]), ("b", 1, ["q"])], "rec string, chunk_no long, words array<string>")
    assert texts(stitch_chunks(df, ["rec"], 4)) == {"a": "x y y z", "b": "p q"}


def test_one_long_recording_is_spread(spark):
    """No task has more than its share of a recording: the joins are keyed by chunk too."""
    df = chunked(spark, [("long", [f"w{i}" for i in range(60_000)])])
    out = stitch_chunks(df, ["rec"], 6)
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    plan = out._jdf.queryExecution().toString()
    assert "Window" not in plan
    assert sum(per_task) == 2500
    assert texts(out)["long"] == " ".join(f"w{i}" for i in range(60_000))

"""Hard-negative mining against brute force, and the residue products against exact integers."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tulkki.llm.hard_negatives import enough_primes, exact_products, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, tag string, score string, rank string, x string, w string"


def brute(rows, positives=5, negatives=3, low=50, high=95):
    seen = {(v, lab, tuple(math.floor(256 * float(np.float32(c))) for c in e)) for v, e, lab in rows
            if v is not None and lab is not None and e is not None and all(c is not None and math.isfinite(c) for c in e)}
    out = []
    for a in (r for r in seen if r[0] % 50 == 0):
        scored = sorted((-sum(p * q for p, q in zip(a[2], r[2], strict=True)), r[0], r[1] == a[1]) for r in seen if len(r[2]) == len(a[2]))
        own = [(-s, i) for s, i, same in scored if same and i != a[0]][:positives]
        for score, i in own:
            hard = [(-s, n) for s, n, same in scored if not same and low * score <= 100 * -s and 100 * -s <= high * score][:negatives]
            out += [(a[0], i, rank, n, score, s) for rank, (s, n) in enumerate(hard, 1)]
    return sorted(out)


@pytest.fixture()
def make(spark):
    return lambda rows: spark.createDataFrame([(*r, *"abcde") for r in rows], SCHEMA)


def mined(df, **options):
    return sorted(tuple(r) for r in hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect())


@pytest.mark.parametrize("dims,size", [(1, 5), (64, 256), (130, 1 << 20), (200, 1 << 24)])
def test_products_are_exact(dims, size):
    rng = np.random.default_rng(dims)
    a, b = (rng.integers(-size, size + 1, (n, dims)) for n in (7, 9))
    bound = dims * size * size
    got = exact_products(a, b, enough_primes(bound))
    want = a.astype(object) @ b.astype(object).T
    assert (got == want.astype(np.int64)).all()
    extreme = np.full((1, dims), size)
    assert exact_products(extreme, -extreme, enough_primes(bound))[0, 0] == -bound


def test_matches_brute_force(spark, make):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0.1, 0.2) for _ in range(8)], rng.randrange(4)) for i in range(600)]
    df = make(rows).repartition(7)
    assert mined(df) == brute(rows)
    assert mined(df, block=16, anchor_block=3, group_bytes=200) == brute(rows)


def test_one_vector_on_a_third_of_the_rows(spark, make):
    rng = random.Random(5)
    same = [0.5, 0.25, 0.125, 0.75]
    rows = [(i, same if i % 3 == 0 else [rng.random() for _ in range(4)], rng.randrange(3)) for i in range(400)]
    assert mined(make(rows), block=32) == brute(rows)


def test_unusable_and_repeated_rows(spark, make):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(9)
    rows = [(i, [rng.random(), rng.random()], i % 2) for i in range(100, 160)]
    rows += rows[:10] + [(100, [0.1, 0.2], 0), (150, [0.3, 0.2], 1), (None, [1.0, 1.0], 0), (1, None, 0), (2, [1.0, None], 1), (3, [nan, 1.0], 0),
                         (4, [inf, 1.0], 0), (5, [1.0, 1.0], None), (200, [1.0], 0), (201, [0.9], 0), (202, [0.7], 1), (250, [], 0), (251, [], 0), (252, [], 1)]
    assert mined(make(rows)) == brute(rows)


def test_no_rows_no_anchors_no_positives(spark, make):
    assert mined(make([])) == []
    assert mined(make([(1, [1.0], 0), (2, [1.0], 1)])) == []
    assert mined(make([(50, [1.0], 0), (2, [1.0], 1)])) == []
    assert hard_negatives(make([]), F.lit(True)).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_scores_beyond_range_are_refused(spark, make):
    with pytest.raises(ValueError):
        mined(make([(50, [1e30], 0), (2, [1.0], 0)]))

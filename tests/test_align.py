"""M1 (alignment counts), M2/M3 and M7 against a full-matrix brute force."""

import random

import pytest

from tulkki.operators.align import align_words

GOLDEN = [
    ("p q", "q p", (1, 0, 1, 1), 1.0, 0.75),
    ("a b c d", "a x c d e", (3, 1, 0, 1), 0.5, 0.55),
    ("a b", "z z", (0, 2, 0, 0), 1.0, 1.0),
    ("a b c d e f", "a b c d e f", (6, 0, 0, 0), 0.0, 0.0),
    ("a c b", "c b b", (1, 2, 0, 0), 2 / 3, 1 - 1 / 9),
    ("a a", "", (0, 0, 2, 0), 1.0, 1.0),
]


def brute(ref, hyp):
    """Full matrix + traceback with the same tie rule; independent of the bit-parallel code."""
    n0, m0 = len(ref), len(hyp)
    lim = min(n0, m0)
    pre = 0
    while pre < lim and ref[pre] == hyp[pre]:
        pre += 1
    suf = 0
    while suf < lim - pre and ref[n0 - 1 - suf] == hyp[m0 - 1 - suf]:
        suf += 1
    r, h = ref[pre:n0 - suf], hyp[pre:m0 - suf]
    n, m = len(r), len(h)
    D = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n + 1):
        D[i][0] = i
    for j in range(m + 1):
        D[0][j] = j
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            D[i][j] = min(D[i - 1][j] + 1, D[i][j - 1] + 1, D[i - 1][j - 1] + (r[i - 1] != h[j - 1]))
    i, j, hits = n, m, pre + suf
    while i > 0 and j > 0:
        if D[i][j] == D[i - 1][j] + 1:
            i -= 1
        elif D[i][j - 1] == D[i - 1][j - 1] - 1:
            j -= 1
        else:
            hits += r[i - 1] == h[j - 1]
            i, j = i - 1, j - 1
    s = n0 + m0 - 2 * hits - D[n][m]
    return hits, s, n0 - hits - s, m0 - hits - s


@pytest.mark.parametrize("ref,hyp,counts,wer,wil", GOLDEN)
def test_golden(ref, hyp, counts, wer, wil):
    assert align_words(ref.split(), hyp.split()) == counts


def test_random_against_brute_force():
    rnd = random.Random(7)
    for _ in range(5000):
        v = rnd.randint(1, 6)
        r = [str(rnd.randrange(v)) for _ in range(rnd.randint(0, 12))]
        h = [str(rnd.randrange(v)) for _ in range(rnd.randint(0, 12))]
        got = align_words(r, h)
        assert got == brute(r, h)
        hits, s, d, i = got
        assert hits + s + d == len(r) and hits + s + i == len(h)


def test_many_blocks():
    rnd = random.Random(11)
    for _ in range(500):
        r = [str(rnd.randrange(4)) for _ in range(rnd.randint(0, 40))]
        h = [str(rnd.randrange(4)) for _ in range(rnd.randint(0, 40))]
        assert align_words(r, h) == brute(r, h)


def test_long_pair_is_exact_and_whole():
    rnd = random.Random(3)
    r = [str(rnd.randrange(50)) for _ in range(3000)]
    h = [w if rnd.random() > 0.2 else "x" for w in r]
    hits, s, d, i = align_words(r, h)
    assert hits + s + d == 3000 and hits + s + i == 3000


def test_spark_udf_metrics_and_m7(spark):
    from tulkki.operators.align import align_texts, word_distance
    from tulkki.operators.metrics import wer, wil
    rows = [(i, r, h) for i, (r, h, *_ ) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "id int, r string, h string")
    out = df.select("id", align_texts("r", "h").alias("al")).select(
        "id", "al", wer("al").alias("wer"), wil("al").alias("wil")).orderBy("id").collect()
    for row, (_, _, counts, w, wl) in zip(out, GOLDEN):
        assert tuple(row["al"]) == counts
        assert row["wer"] == pytest.approx(w)
        assert row["wil"] == pytest.approx(wl)
    dist = {r["id"]: r["d"] for r in df.select("id", align_texts("r", "h").alias("al")).select("id", word_distance("al").alias("d")).collect()}
    for i, (_, _, (hits, s, d, ins), *_r) in enumerate(GOLDEN):
        assert dist[i] == s + d + ins


def test_many_pairs_at_a_time_against_brute_force(monkeypatch):
    """Pairs of several widths in one call, by limbs of 64 columns; ordinary ones aren't aligned one by one."""
    from tulkki.operators import align
    rnd = random.Random(11)
    pairs = []
    for most, count in ((8, 400), (70, 150), (300, 60)):
        for _ in range(count):
            r = [str(rnd.randrange(rnd.choice([2, 9, 60]))) for _ in range(rnd.randrange(most))]
            h = [w for w in r if rnd.random() > 0.2] if rnd.random() < 0.7 else [str(rnd.randrange(4)) for _ in range(rnd.randrange(most))]
            pairs.append((r, [w + "q" if rnd.random() < 0.2 else w for w in h]))
    pairs += [([], []), (["a"], []), ([], ["a"]), (["a"] * 64, ["b"] * 64), (["a"] * 65, ["b"] * 128)]
    want = [brute(r, h) for r, h in pairs]
    assert align.align_many(pairs) == want
    assert align.align_many(pairs[:3]) == want[:3]
    monkeypatch.setattr(align, "_hits_and_cost", None)
    assert align.align_many(pairs[:400]) == want[:400]


def test_rows_of_an_ordinary_pair_are_made_once(monkeypatch):
    from tulkki.operators import align
    made = []
    rows = align._rows

    def counted(places, *rest):
        made.append(len(places))
        return rows(places, *rest)

    monkeypatch.setattr(align, "_rows", counted)
    rng = random.Random(4)
    ref = [rng.randrange(50) for _ in range(700)]
    hyp = [w for w in ref if rng.random() > 0.3]
    whole = align.align_words(ref, hyp)
    assert sum(made) <= 700
    monkeypatch.setattr(align, "_KEPT", 0)
    assert align.align_words(ref, hyp) == whole and sum(made) > 1400

"""METEOR's stem and synonym stages as relations against the in-row matching with whole dictionaries."""

import os
import random
import re

import pytest

from tulkki.functions.stem import stem
from tulkki.operators.lexicon import meteor_pairs
from tulkki.operators.scoring import meteor_counts

WORDS = ["run", "running", "runs", "ran", "cat", "cats", "dog", "hound", "quick", "fast", "fasting", "big", "large", "huge", "the", "a"]
SYNONYMS = [("dog", "hound"), ("hound", "dog"), ("quick", "fast"), ("big", "large"), ("big", "huge"), ("large", "huge"), ("ran", "run"), ("the", "the"), ("a", "the"), ("ran", "run")]


def text(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(14)))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    some = [(i, text(rng), text(rng)) for i in range(300)]
    return some + some[:20] + [(None, None, "run"), (-1, "run", None), (-2, None, None), (-3, "", ""), (-4, "dog " * 200, "hound " * 150 + "dog")]


@pytest.mark.parametrize("stems", [True, False])
@pytest.mark.parametrize("synonyms", [True, False])
def test_stages_against_the_whole_dictionary(spark, rows, stems, synonyms):
    df = spark.createDataFrame(rows, "k long, ref string, hyp string").repartition(6)
    table = spark.createDataFrame(SYNONYMS, "word string, synonym string") if synonyms else None
    got = meteor_pairs(df, stemmer=stem if stems else None, synonyms=table).collect()
    known = {}
    for word, other in dict.fromkeys(SYNONYMS):
        if word != other:
            known.setdefault(word, []).append(other)
    assert len(got) == len(rows)
    for r in got:
        ref, hyp = (r["ref"] or "").split(), (r["hyp"] or "").split()
        want = meteor_counts(ref, hyp, stems, known if synonyms else None)
        assert tuple(r["scores"]) == (*want, len(ref), len(hyp)), r


def test_each_distinct_word_is_stemmed_once(spark, tmp_path):
    log = str(tmp_path / "stemmed")

    def logged(word):
        fd = os.open(log, os.O_WRONLY | os.O_APPEND | os.O_CREAT)
        os.write(fd, (word + "\n").encode())
        os.close(fd)
        return word[:3]

    pairs = spark.createDataFrame([(f"x{i % 7}y same {i % 3}q", f"x{i % 7}z same") for i in range(500)], "ref string, hyp string")
    meteor_pairs(pairs, stemmer=logged).collect()
    words = open(log).read().split()
    assert len(words) == len(set(words)) == 7 + 7 + 3


def test_pairs_are_made_twice_at_most_and_their_words_are_not_broadcast(spark):
    """Once for the words left over, once for the result, whatever the stages."""
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    pairs = spark.createDataFrame([(f"x{i}y same {i % 3}q", f"x{i}z same") for i in range(200)], "ref string, hyp string").mapInPandas(count, "ref string, hyp string")
    got = meteor_pairs(pairs, stemmer=lambda w: w[:3], synonyms=spark.createDataFrame(SYNONYMS, "word string, synonym string"))
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 200 and got.agg({"scores.matches": "sum"}).first()[0] > 0
    made.value = 0
    meteor_pairs(pairs, stemmer=lambda w: w[:3], synonyms=spark.createDataFrame(SYNONYMS, "word string, synonym string")).collect()
    assert made.value == 400


def test_no_pairs(spark):
    df = spark.createDataFrame([], "ref string, hyp string")
    assert meteor_pairs(df, synonyms=spark.createDataFrame(SYNONYMS, "word string, synonym string")).count() == 0


def test_mt_records_take_the_stages(spark, rows):
    from tulkki.operators.scoring import meteor_score
    from tulkki.plans.evaluate import evaluate_mt
    seg = spark.createDataFrame([(i % 7, r, h) for i, (_, r, h) in enumerate(rows) if r and h], "doc_id long, ref string, hyp string")
    seg = seg.selectExpr("doc_id", "'fi' AS src_lang", "'en' AS tgt_lang", "'nllb' AS mt_model", "'s' AS src", "ref", "hyp")
    table = spark.createDataFrame(SYNONYMS, "word string, synonym string")
    got = {r["doc_id"]: r["METEOR"] for r in evaluate_mt(seg, lexicon={"stemmer": stem, "synonyms": table}, ter=False).collect()}
    scored = meteor_pairs(seg, synonyms=table).select("doc_id", meteor_score("scores").alias("m")).groupBy("doc_id").avg("m")
    want = {r[0]: r[1] for r in scored.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    exact = {r["doc_id"]: r["METEOR"] for r in evaluate_mt(seg, ter=False).collect()}
    assert all(exact[k] <= got[k] + 1e-9 for k in got) and sum(got.values()) > sum(exact.values())


def test_words_leave_their_chunk_once(spark, monkeypatch):
    """Pairs go on in chunks whose words and stems meet; a chunk ends where it is full, with the same counts."""
    from tulkki.operators import lexicon

    rng = random.Random(5)
    pairs = [(text(rng), text(rng)) for _ in range(200)] + [("", "dog"), ("  cat\x1cdog ", "dogs")]

    def counted(most):
        monkeypatch.setattr(lexicon, "_MOST_LEFT", most)
        monkeypatch.setattr(lexicon, "_MOST_TEXT", 100)
        keys = [lexicon.pa.array(range(len(pairs)), lexicon.pa.int64())] * 2
        batch = lexicon.pa.RecordBatch.from_arrays([*keys, *map(lexicon.pa.array, zip(*pairs, strict=True))], ["a", "b", "ref", "hyp"])
        chunks = [b.to_pylist()[0] for b in lexicon._chunked(iter([batch]))]
        found = []
        for c in chunks:
            stages = lexicon._Stages(c["state"], c["words"], True)
            stages.stemmed(lexicon.np.arange(len(c["words"])), [stem(w) for w in c["words"]])
            for word, other in dict.fromkeys(SYNONYMS):
                if word != other and word in c["words"]:
                    stages.linked(lexicon.np.array([c["words"].index(word)]), [other])
            found += zip(*[x.tolist() for k, x in stages.counts().items() if k in lexicon.COUNT_NAMES], strict=True)
        return chunks, found

    known = {}
    for word, other in dict.fromkeys(SYNONYMS):
        if word != other:
            known.setdefault(word, []).append(other)
    want = [(*meteor_counts(r.split(), h.split(), True, known), len(r.split()), len(h.split())) for r, h in pairs]
    (one,), whole = counted(1 << 20)
    many, cut = counted(50)
    assert whole == cut == want and len(many) > 5
    assert len(one["words"]) == len(set(one["words"])) <= len(WORDS) + 1


def test_texts_are_not_shuffled(spark):
    """Neither by the pass that takes the words left over nor by the one of the result."""
    pairs = spark.range(50).selectExpr("id", "concat('x', id, 'y same') AS ref", "concat('x', id, 'z same') AS hyp")
    got = meteor_pairs(pairs, synonyms=spark.createDataFrame(SYNONYMS, "word string, synonym string")).select("id", "scores.matches")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join.*\n\s*:- Project \[id#\d+L, xxhash64\(.*\) AS _pair_a#\d+L, xxhash64\(.*\) AS _pair_b#\d+L\]\n", plan), plan
    assert got.count() == 50

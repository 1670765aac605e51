"""METEOR's stages, Porter stems and the one-pass pair scores."""

import random

import pytest
from pyspark.sql import functions as F

from tulkki.functions.stem import stem
from tulkki.operators.scoring import meteor_counts, meteor_score, pair_scores

# Words and stems from the published description of the algorithm.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope
goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens irritant irrit
replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize(("word", "want"), list(zip(STEMS[::2], STEMS[1::2], strict=True)))
def test_published_stems(word, want):
    assert stem(word) == want


def literal(ref, hyp, fits):
    """METEOR matching as a greedy loop from the back, stage by stage."""
    r, h, pairs = list(enumerate(ref)), list(enumerate(hyp)), {}
    for fit in fits:
        for i in range(len(h) - 1, -1, -1):
            for j in range(len(r) - 1, -1, -1):
                if fit(h[i][1], r[j][1]):
                    pairs[h.pop(i)[0]] = r.pop(j)[0]
                    break
    order = sorted(pairs.items())
    chunks = sum(1 for k, (x, y) in enumerate(order) if not k or order[k - 1] != (x - 1, y - 1))
    return len(pairs), chunks


def test_stages_are_the_greedy_loop():
    rng = random.Random(1)
    words = "run running runs ran hope hoping hopeful cat cats a the".split()
    table = {"ran": ["run", "cat"], "a": ["the"], "hope": ["hoping"]}
    exact, by_stem, by_table = (lambda x, y: x == y), (lambda x, y: stem(x) == stem(y)), (lambda x, y: y in table.get(x, []))
    for _ in range(2000):
        r, h = ([rng.choice(words) for _ in range(rng.randrange(9))] for _ in range(2))
        assert meteor_counts(r, h) == literal(r, h, [exact])
        assert meteor_counts(r, h, stems=True) == literal(r, h, [exact, by_stem])
        assert meteor_counts(r, h, synonyms=table) == literal(r, h, [exact, by_table])
        assert meteor_counts(r, h, True, table) == literal(r, h, [exact, by_stem, by_table])


GOLDEN = [("p q", "q p", 0.5), ("a b c d", "a x c d e", 0.623306), ("a b", "z z", 0.0), ("a b c d e f", "a b c d e f", 0.997685),
          ("a c b", "c b b", 0.333333), ("a a", "", 0.0), ("same", "same", 0.5)]


def test_meteor_keeps_null_and_clashing_keys(spark):
    df = spark.createDataFrame([(None, *g) for g in GOLDEN] + [("k", None, "x", 0.0), ("k", None, None, None)], "k string, word string, chunks string, m double")
    rows = df.select("k", "m", meteor_score(pair_scores("word", "chunks")).alias("got")).collect()
    assert len(rows) == len(GOLDEN) + 2
    for r in rows:
        assert r["got"] == (None if r["m"] is None else pytest.approx(r["m"], abs=1e-6))


def test_what_is_not_asked_for_is_null(spark):
    df = spark.createDataFrame([("a b", "b a")], "r string, h string")
    s = df.select(pair_scores("r", "h", meteor=False, ter=False).alias("s")).first()["s"]
    assert (s["hits"], s["matches"], s["ter_edits"], s["ref_len"]) == (1, None, None, 2)
    s = df.select(pair_scores("r", "h", words=False).alias("s")).first()["s"]
    assert (s["hits"], s["matches"], s["ter_edits"]) == (None, 2, 1)


def test_mt_plan_scans_once_and_shuffles_once(spark):
    from tulkki.plans.catalog import overlap_scorer
    from tulkki.plans.evaluate import evaluate_mt
    seg = spark.range(100).select((F.col("id") % 7).alias("doc_id"), F.lit("en").alias("src_lang"), F.lit("fr").alias("tgt_lang"), F.lit("nllb").alias("mt_model"),
                                  F.lit("x y").alias("src"), F.lit("a b").alias("ref"), F.lit("b a").alias("hyp"))
    df = evaluate_mt(seg, overlap_scorer)
    row = df.first()
    assert (row["TER"], row["METEOR"], row["COMET"], row["ASR_WER_Status"], row["WER"], row["Line_Index"], row["Noise_Type"]) == (50.0, 0.5, 1.0, "Human Source", 0.0, -1, "N/A")
    assert row["Pred_File"] == "data/results/mt/facebook_nllb-200-distilled-600M/en_SOURCE_nllb_en2fr_results.txt"
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Range (") == 1 and plan.count("Exchange hashpartitioning") <= 3


def test_sources_of_transcripts_are_flagged(spark):
    from tulkki.plans import checkdata
    from tulkki.plans.evaluate import evaluate_asr, evaluate_mt_on_asr
    docs = checkdata.table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 12")
    asr = evaluate_asr(spark, checkdata.asr_outputs(spark, docs))
    lists = checkdata.mt_on_asr_lists(spark, docs)
    assert lists.where("src_lines = ref_lines").count() == 0
    rows = evaluate_mt_on_asr(lists, asr).collect()
    own = {(r["doc_id"], r["Model"]): r for r in asr.collect()}
    assert len(rows) == lists.count()
    for r in rows:
        a = own[r["doc_id"], r["asr_model"]]
        assert (r["Condition_Code"], r["Speaker_Group"], r["Audio_File_Name"], r["Line_Index"]) == (a["Condition_Code"], a["Speaker_Group"], a["Audio_File_Name"], a["Line_Index"])
        assert r["ASR_WER_Status"].startswith(f"ASR Source ({r['Source_Lang']}_")
        same = [x["WER"] for x in own.values() if x["Language"] == r["Source_Lang"] and x["Model"] == r["asr_model"] and x["reject_reason"] is None]
        assert r["WER"] == pytest.approx(sum(same) / len(same))


def test_segments_keep_null_and_repeated_rows(spark):
    from tulkki.plans.evaluate import score_mt_segments
    rows = [(None, "s", "a b", "a b"), (None, "s", "a b", "a b"), ("k", None, None, "x"), ("k", "s", None, None), ("k", "s", "a c", None), ("z", "t", "A, b!", "a b")]
    df = spark.createDataFrame(rows, "meta string, src string, ref string, hyp string")
    got = sorted((r["meta"] or "", r["meteor"], r["ter_edits"], r["ter_ref_len"]) for r in score_mt_segments(df).where("ter_edits IS NOT NULL").collect())
    assert got == [("", 0.9375, 0, 2), ("", 0.9375, 0, 2), ("k", 0.0, 1, 0), ("k", 0.0, 2, 2), ("z", 0.9375, 0, 2)]
    assert score_mt_segments(df).count() == len(rows)


def test_small_batches_are_scored_together_and_equal_pairs_once(monkeypatch):
    from tulkki.operators import scoring
    calls = []

    def score(pairs):
        calls.append(list(pairs))
        return [len(r or "") for r, _ in pairs]

    batches = [[("a" * (i % 7), "b"), (None, "b"), ("a" * (i % 7), None)] for i in range(50)]
    assert list(scoring._scored(iter(batches), score)) == [[i % 7, 0, i % 7] for i in range(50)]
    assert len(calls) == 1 and len(calls[0]) == len(set(calls[0])) == 7 + 1 + 7
    calls.clear()
    monkeypatch.setattr(scoring, "_MOST_CHARS", 20)
    assert list(scoring._scored(iter(batches), score)) == [[i % 7, 0, i % 7] for i in range(50)]
    assert len(calls) > 5 and all(sum(map(scoring._size, c[:-1])) < 20 for c in calls)


def test_prepared_text_takes_one_pass(spark):
    import random

    from pyspark.sql import functions as F

    from tulkki.functions import text as tx
    from tulkki.plans.evaluate import _prepared_text
    rng = random.Random(7)
    some = ["A", "b.", " ", "\t", "-", "\u00a0", "\u0130", "\u03a3", "", "'x'", "\u2003y", None]
    rows = [(i, [None if x is None else "".join(rng.choices([s for s in some if s is not None], k=4)) for x in rng.choices(some, k=rng.randrange(5))]) for i in range(300)]
    df = spark.createDataFrame([*rows, (-1, None)], "k long, lines array<string>")
    twice = tx.normalize(F.array_join(F.transform("lines", tx.normalize), " "))
    got = df.select(_prepared_text(F.col("lines")).alias("a"), twice.alias("b")).collect()
    assert len(got) == 301 and all(r["a"] == r["b"] for r in got)
    assert str(_prepared_text(F.col("lines"))).count("regexp_replace") * 2 == str(twice).count("regexp_replace")


def test_transcripts_are_scored_once_for_their_quality(spark):
    from tulkki.plans import evaluate
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    asr = spark.createDataFrame([(i, "en", "m", None, 0.1 * i, 0.2, None if i else "empty_prediction", "a/f/x.txt", *[None] * 8) for i in range(5)],
                                "doc_id long, Language string, Model string, Line_Index long, WER double, WIL double, reject_reason string, Pred_File_Path string, "
                                + ", ".join(f"{c} string" for c in evaluate.META))
    quality = evaluate.asr_quality(asr.mapInPandas(count, asr.schema)).collect()
    assert made.value == 5 and [round(r["WER"], 6) for r in quality] == [0.25] * 4

"""The corruption of check data against its definition."""

import random

from tulkki.plans.checkdata import corrupted_line


def remainder(x, y):
    return x % y if x >= 0 else -(-x % y)


def by_definition(line, doc, pos, k, c):
    out = []
    for i, w in enumerate(line.split(" ")):
        h = None if doc is None else remainder(doc * 13 + pos * 7 + i * 5 + k * 3, 31)
        if h is not None and h >= 2 * c + k:
            out.append(w)
        elif h is None or remainder(h, 3) not in (0, 1):
            out += [w, w]
        elif remainder(h, 3) == 1:
            out.append(w + "q")
    return " ".join(out)


def test_corruption_against_its_definition():
    rng = random.Random(3)
    for _ in range(3000):
        line = " ".join(rng.choice(["a", "bb", "", "é"]) for _ in range(rng.randrange(90)))
        doc = rng.choice([None, 0, rng.randrange(10**9), -rng.randrange(40), 1 << 55])
        c = None if doc is None else remainder(doc, 6) + 1
        at = doc, rng.randrange(50), rng.choice([1, 5, 11, 12]), c
        assert corrupted_line(line, *at) == by_definition(line, *at)


def test_line_pairs_are_corrupted_once(spark):
    """One Arrow UDF gives a recording's hypotheses; no word-by-word lambda is left."""
    from tulkki.plans.checkdata import line_pairs, recordings
    docs = spark.createDataFrame([(1, "en", "a b c\n\nd"), (2, "fr", None), (3, "en", ""), (4, "en", "x")], "doc_id long, lang string, text string")
    pairs = line_pairs(spark, docs)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "% 31" not in plan
    rows = {(r["doc_id"], r["pos"], r["model_no"]): (r["ref"], r["hyp"]) for r in pairs.collect()}
    cond = {r["doc_id"]: r["cond_no"] for r in recordings(docs).collect()}
    lines = {(1, 0): "a b c", (1, 1): "d", (4, 0): "x"}
    assert {(d, p) for d, p, _ in rows} == set(lines)
    for (d, p, k), (ref, hyp) in rows.items():
        assert ref == lines[d, p] and hyp == by_definition(ref, d, p, k, cond[d]).strip()


def test_documents_travel_once_and_before_the_models(spark):
    """Dealt to the session's number of tasks by doc_id; the models come from what arrives."""
    from tulkki.plans import checkdata
    docs = spark.createDataFrame([(i, "A b. c\nd e", "en") for i in range(20)], "doc_id long, text string, lang string")
    for made in (checkdata.line_pairs(spark, docs), checkdata.asr_outputs(spark, docs), checkdata.mt_segments(spark, docs)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("RepartitionByExpression") == 1 and "asr_model" not in plan[plan.index("RepartitionByExpression"):]
        assert made.select("doc_id").distinct().count() == 20
        dealt = plan[plan.index("RepartitionByExpression"):].splitlines()[0]
        assert dealt.endswith(f"], {spark.conf.get('spark.sql.shuffle.partitions')}"), dealt

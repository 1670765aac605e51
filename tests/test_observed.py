"""A9/P6 counts and warnings in one pass, A1 in stretches, F17, P10, languages of the data."""

import pytest

from pyspark.sql import functions as F

from tulkki.functions import text as tx
from tulkki.operators import relational as rel


def outputs(spark):
    rows = [(1, "fi", "data/x/m1/fi-nat-m-c1_transcription.txt", ["a b"], ["a b"]), (2, "fi", "data/x/m1/notes_transcription.txt", ["a b"], ["a"]),
            (3, "fi", "data/x/m1/fi-nat-m-c3_transcription.txt", ["a"], []), (4, "fi", "data/x/m1/fi-nat-m-c9_transcription.txt", ["..."], ["a"])]
    return spark.createDataFrame([(*r[:2], "m1", *r[2:]) for r in rows], "doc_id long, lang string, asr_model string, pred_path string, ref_lines array<string>, pred_lines array<string>")


def test_one_job_gives_records_counts_and_warnings(spark, tmp_path):
    from tulkki.plans.evaluate import evaluate_asr, flagged_asr
    records, run = flagged_asr(evaluate_asr(spark, outputs(spark)), "asr run")
    group = "one pass"
    spark.sparkContext.setJobGroup(group, group)
    records.write.parquet(f"{tmp_path}/records")
    spark.sparkContext.setJobGroup("after", "after")
    counts = run.get
    # the counts come with the write: its jobs are all there are
    tracker = spark.sparkContext.statusTracker()
    assert tracker.getJobIdsForGroup(group) and not tracker.getJobIdsForGroup("after")
    got = {r["doc_id"]: (r["reject_reason"], r["warnings"]) for r in spark.read.parquet(f"{tmp_path}/records").collect()}
    assert got == {1: (None, []), 2: (None, ["unparsed_metadata"]), 3: ("empty_prediction", []), 4: ("invalid_line_index", [])}
    want = {"n": 4, "accepted": 2, "rejected": 2, "other_reasons": 0, "reject_empty_prediction": 1, "reject_invalid_line_index": 1, "warned": 1, "warning_unparsed_metadata": 1}
    assert {k: v for k, v in counts.items() if v or k in want} == want


def test_lists_of_other_lengths_are_flagged_and_kept(spark):
    from tulkki.plans.evaluate import evaluate_asr, flagged_mt_on_asr
    asr = evaluate_asr(spark, outputs(spark))
    lists = spark.createDataFrame(
        [(1, "fi", "en", "m1", "nllb", "s/fi.txt", ["a", "b"], ["x", "y"], ["x", "y"]), (2, "fi", "en", "m1", "nllb", "s/fi.txt", ["a", "b", "c"], ["x"], ["x", "z"])],
        "doc_id long, src_lang string, tgt_lang string, asr_model string, mt_model string, Source_File string, src_lines array<string>, ref_lines array<string>, hyp_lines array<string>")
    records, run = flagged_mt_on_asr(lists, asr)
    got = {r["doc_id"]: (r["warnings"], r["METEOR"] > 0) for r in records.collect()}
    assert got == {1: ([], True), 2: (["count_mismatch", "unparsed_metadata"], True)}
    assert (run.get["n"], run.get["warned"], run.get["warning_count_mismatch"]) == (2, 1, 1)


@pytest.mark.parametrize("stretch,block", [(7, 2), (50, 3), (1 << 20, 10_000)])
def test_stretches_make_up_the_text(spark, stretch, block):
    rows = [(k, p, "ab cd" * (p % 4)) for k in ("x", "y", None) for p in range(0, 40, 1 + len(k or ""))] + [("n", 0, None), ("n", 3, "z"), ("e", 0, "")]
    df = spark.createDataFrame(rows, "k string, pos int, text string").repartition(5)
    got = {}
    for r in rel.join_stretches(df, ["k"], stretch=stretch, block=block).orderBy("stretch").collect():
        got.setdefault(r["k"], []).append(r["text"])
        assert len(r["text"]) <= stretch + 15
    whole = {r["k"]: r["text"] for r in rel.join_lines(df, ["k"]).collect()}
    assert {k: " ".join(v) for k, v in got.items()} == whole


def test_a_large_file_has_rows_of_bounded_size(spark):
    lines = spark.range(400_000).select(F.lit("f").alias("k"), F.col("id").alias("pos"), F.concat(F.lit("line of some length, number "), F.col("id")).alias("text"))
    rows = rel.join_stretches(lines, ["k"], stretch=1 << 16).select("stretch", F.length("text").alias("n"), F.md5("text").alias("m")).orderBy("stretch").collect()
    assert [r["stretch"] for r in rows] == list(range(len(rows))) and max(r["n"] for r in rows) <= (1 << 16) + 40
    assert sum(r["n"] + 1 for r in rows) == sum(len(f"line of some length, number {i}") + 1 for i in range(400_000))


def test_prepared_references_in_stretches(spark):
    from tulkki.plans.evaluate import prepare_reference_stretches, prepare_references
    docs = [(1, ["A b.", "...", " C-d  E ", "f"]), (2, ["only"])]
    lines = spark.createDataFrame([(d, i, t) for d, ls in docs for i, t in enumerate(ls)], "doc_id long, pos int, text string")
    whole = {r["doc_id"]: r["ref_text"] for r in prepare_references(spark.createDataFrame(docs, "doc_id long, ref_lines array<string>"), ["doc_id"]).collect()}
    for stretch in (3, 1000):
        got = {}
        for r in prepare_reference_stretches(lines, ["doc_id"], stretch=stretch).orderBy("stretch").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        assert {k: " ".join(v) for k, v in got.items()} == whole


def test_only_and_lower(spark):
    df = spark.createDataFrame([("a", "ÄB"), ("b", "Ǆ"), (None, None)], "k string, t string")
    assert [r["t"] for r in rel.only(df, "k", "a").collect()] == ["ÄB"]
    assert rel.only(df, "k", "zz").count() == 0
    assert [r["x"] for r in df.select(tx.lower("t").alias("x")).collect()] == ["äb", "ǆ", None]


def test_languages_come_from_the_data(spark):
    from tulkki.plans.checkdata import languages
    df = spark.createDataFrame([("fi",), ("xx",), (None,), ("fi",)], "lang string")
    assert languages(df) == ["fi", "xx"]
    with pytest.raises(ValueError):
        languages(df, most=1)


def test_a_dimension_beyond_the_bound_is_not_broadcast(spark):
    from tulkki.operators.tables import small
    df = spark.range(50)
    plan = lambda x: x.join(small(df, 20 if x is df else 100), "id")._jdf.queryExecution().toString()
    other = spark.range(10)
    assert "ResolvedHint" not in small(df, 20)._jdf.queryExecution().toString() and "broadcast" in plan(other).lower()

"""The pipeline's stages on a small table and on given documents."""

import hashlib
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tulkki.llm.catalog import ORACLES, QUERIES

TINY = "/root/testdata/sf0.001"


def run_stage(spark, name, docs):
    return dict(corpus_pipeline.STAGES)[name](spark, docs, TINY)


def test_run_is_all_stages(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    rows = corpus_pipeline.run(spark, TINY).collect()
    assert 0 < len(rows) < docs.count()
    assert len({r.doc_id for r in rows}) == len(rows)
    again = corpus_pipeline.run(spark, TINY).collect()
    assert sorted(rows, key=lambda r: r.doc_id) == sorted(again, key=lambda r: r.doc_id)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_return_documents(spark, make_docs, words, name):
    rng = random.Random(2)
    given = spark.read.parquet(f"{TINY}/documents.parquet")
    odd = make_docs([(10**6, None), (10**6 + 1, ""), (10**6 + 2, " "), (None, words(rng, 60)), (10**6 + 3, words(rng, 60)), (10**6 + 3, words(rng, 60))])
    docs = given.unionByName(odd.select(given.columns)).withColumns({c: F.lit("x") for c in ("tag", "node", "row", "hits")})
    out = run_stage(spark, name, docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [t for _, t in out.dtypes] == [t for _, t in given.dtypes]
    rows = out.collect()
    assert rows and len(rows) <= docs.count()
    assert run_stage(spark, name, docs.where("doc_id < 0")).collect() == []


def test_language_stage_rejects_texts_without_letters(spark, make_docs):
    docs = make_docs([(i, "the cat and the dog of the house " * 5) for i in range(1, 30)] + [(100, None), (101, "12 34 !"), (102, "")])
    assert {r.doc_id for r in run_stage(spark, "language_id", docs).collect()} == set(range(1, 30))


def test_one_of_each_group_stays(spark, make_docs, words):
    rng = random.Random(4)
    a, b = words(rng, 200), words(rng, 200)
    near = a.rsplit(" ", 1)[0] + " changed"
    docs = make_docs([(5, a), (3, near), (9, a), (9, a), (7, b), (None, b), (None, "alone " * 8), (None, "alone " * 8), (11, None), (12, None)])
    got = sorted(((r.doc_id, r.text) for r in run_stage(spark, "ngram_jaccard", docs).collect()), key=repr)
    assert got == sorted([(3, near), (7, b), (None, "alone " * 8), (11, None), (12, None)], key=repr)


def test_line_stage_keeps_order_and_columns(spark, make_docs):
    docs = make_docs([(i, f"Menu\nown {i}\nmenu ", "fr", f"s{i}") for i in range(12)] + [(50, "own", None, None)])
    got = {r.doc_id: (r.text, r.lang, r.source, r.n_chars) for r in run_stage(spark, "line_dedup", docs).collect()}
    assert got == {i: (f"own {i}", "fr", f"s{i}", len(f"own {i}")) for i in range(12)} | {50: ("own", None, None, 3)}


def test_decontamination_stage_drops_items(spark, make_docs, words):
    rng = random.Random(4)
    item = spark.read.parquet(f"{TINY}/benchmark.parquet").first().text
    docs = make_docs([(1, words(rng, 40)), (2, words(rng, 40) + ". " + item), (None, item), (3, None)])
    assert sorted((r.doc_id for r in run_stage(spark, "decontaminate", docs).collect()), key=repr) == [1, 3]


def test_every_operator_is_registered():
    assert {q.split("_")[0] for q in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


def test_substring_query_digests_are_hex(spark):
    row = QUERIES["op1_substring_dedup"](spark, TINY).where("n_words = 0 OR n_removed = 0").first()
    assert len(row.kept_sha256) == len(hashlib.sha256(b"").hexdigest())

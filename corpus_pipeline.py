"""Corpus pipeline: five stages over ``documents``, each written and read again.

1. ``language_id``: documents whose language can't be told go.
2. ``line_dedup``: lines found in ten documents or more go from all of them.
3. ``ngram_jaccard``: of each group of near duplicates, the document with the
   smallest id stays.
4. ``decontaminate``: documents with a benchmark question go.
5. ``mix_sources``: each document gets the number of times the mix takes it.

Every stage but the last returns the columns of ``documents``.  Rows with a
null doc_id pass the stages like others; where a stage makes a text empty, the
document stays with an empty text until the mix, which takes none of its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tulkki.llm.decontaminate import contaminated
from tulkki.llm.language_id import UNDETERMINED, fit, held_out_fold, identify
from tulkki.llm.line_dedup import line_dedup
from tulkki.llm.mixing import mix_sources
from tulkki.llm.ngram_jaccard import jaccard_components
from tulkki.llm.store import broadcast_if_few, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of the predicted language.  Half of it is what two languages at a tie get.
LEAST_SCORE = 0.3


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters whose predicted language has a score of ``LEAST_SCORE`` at least."""
    docs = docs.select(*COLUMNS)
    net = fit(docs.where(~held_out_fold()))
    # without any labelled text nothing can be told about a language, and texts with letters stay
    if net is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    return identify(docs, net, COLUMNS).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more of them share."""
    kept = line_dedup(docs.select(*COLUMNS), carry=["lang", "source"])
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates: that with the smallest id, and of repeated rows one."""
    docs = docs.select(*COLUMNS)
    found = materialise(jaccard_components(docs).select("doc_id", "tag", "root"), "components")
    stays = (found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "tag"))["tag"].alias("tag")).select("tag"))
    gone = found.select("tag").distinct().join(stays, "tag", "left_anti")
    repeated = found.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select("tag")
    gone, repeated = materialise(gone, "gone"), materialise(repeated, "repeated")
    tagged = docs.withColumn("tag", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    left = tagged.join(broadcast_if_few(gone), "tag", "left_anti")
    once = left.join(broadcast_if_few(repeated), "tag", "left_anti")
    again = left.join(broadcast_if_few(repeated), "tag", "left_semi").dropDuplicates(["tag"])
    return once.unionByName(again).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item was found."""
    docs = docs.select(*COLUMNS)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = materialise(contaminated(docs, benchmark).select(F.col("tag").alias("found")).distinct(), "found")
    return (docs.withColumn("tag", F.xxhash64("doc_id", "text"))
            .join(broadcast_if_few(found), F.col("tag") == F.col("found"), "left_anti").select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: doc_id, size, source_size, target, copies and taken of each document."""
    return mix_sources(docs.select(*COLUMNS)).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix),
]

#: A trained network and a random rounding have no SQL; the stages are tested on their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again as the next one's documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs

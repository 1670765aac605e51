"""Incremental ASR evaluation as a Structured Streaming job.

New transcript files are picked up by the file source (its checkpoint
remembers what was seen), joined to the prepared references and scored by the
plan of the batch job, rejects included.  ``availableNow`` processes
everything new and stops, so a rerun scores only files that arrived since the
last run, and transcripts whose reference has come only now.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tulkki.functions import text as tx
from tulkki.plans.evaluate import evaluate_asr
from tulkki.sources.files import append_results, files_exist, stream_name


def transcripts(files: DataFrame, key_col: str = "recording") -> DataFrame:
    """Whole transcript files (path, value) as the input of ``evaluate_asr``; a transcript is one recording's text."""
    base = tx.recording_base(tx.file_name("path"))
    return files.select(base.alias(key_col), tx.parse_recording(base)["lang"].alias("lang"), tx.model_folder("path").alias("asr_model"),
                        F.col("path").alias("pred_path"), tx.file_lines("value").alias("pred_lines"))


def evaluate_files(spark: SparkSession, files: DataFrame, refs: DataFrame, key_col: str = "recording") -> DataFrame:
    """E1 on whole transcript files: a record each, with ``reject_reason`` where there is no score."""
    given = set(refs.columns)
    refs = refs.select(key_col, "ref_text", *[c for c in ("ref_path", "n_ref_lines") if c in given])
    if "n_ref_lines" not in given:
        refs = refs.withColumn("n_ref_lines", (F.col("ref_text") != "").cast("int"))
    return evaluate_asr(spark, transcripts(files, key_col), refs, (key_col,))


def stream_evaluate(spark: SparkSession, in_dir: str, refs: DataFrame, out_dir: str,
                    checkpoint: str, key_col: str = "recording", pending_dir: str | None = None) -> None:
    """Score transcripts arriving under ``in_dir`` (``<model>/<name>_transcription.txt``).

    ``refs``: key_col, ref_text (normalised; see ``prepare_references``).
    Appends the records of ``evaluate_files`` to ``out_dir``, in runs, so that
    a repeated batch replaces itself.

    A transcript without a reference gets a record that says so, and waits in
    ``pending_dir`` (beside the checkpoint unless given).  Every run scores
    those whose reference has come since, once; ``current_records`` shows each
    transcript's latest state.
    """
    name, pending = stream_name(checkpoint), pending_dir or f"{checkpoint.rstrip('/')}-pending"

    def score(batch: DataFrame, number: int) -> None:
        run = f"{name}-{number}"
        waiting = _keyed(batch, key_col).join(refs.select(key_col).distinct(), key_col, "left_anti")
        append_results(waiting.select(key_col, "path", "value"), pending, run=run)
        append_results(evaluate_files(spark, batch, refs, key_col), out_dir, run=run)

    files = (spark.readStream.format("text").option("wholetext", True)
             .option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True)
             .load(in_dir).select(F.col("_metadata.file_path").alias("path"), "value"))
    files.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    _score_late(spark, refs, out_dir, pending, f"{name}-late", key_col)


def _keyed(files: DataFrame, key_col: str) -> DataFrame:
    return files.withColumn(key_col, tx.recording_base(tx.file_name("path")))


def _score_late(spark: SparkSession, refs: DataFrame, out_dir: str, pending: str, name: str, key_col: str) -> None:
    """Score the waiting transcripts that have a reference now and no score yet.

    What is settled is told by ``out_dir`` alone, so that a run that was
    stopped before or after its records were written is repeated safely."""
    if not files_exist(spark, f"{pending}/run=*"):
        return
    waiting = spark.read.schema(f"`{key_col}` string, path string, value string").parquet(pending)
    settled = spark.read.option("mergeSchema", True).parquet(out_dir).where(_SETTLED).select(F.col("Pred_File_Path").alias("path")).distinct()
    ready = waiting.join(refs.select(key_col).distinct(), key_col, "left_semi").join(settled, "path", "left_anti").select("path", "value")
    if not ready.isEmpty():
        append_results(evaluate_files(spark, ready, refs, key_col), out_dir, run=f"{name}-{uuid.uuid4().hex}")


_SETTLED = "reject_reason IS NULL OR reject_reason != 'missing_reference'"


def current_records(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records under ``out_dir`` as they stand: a transcript that was scored late no longer counts as one without a reference."""
    rows = spark.read.option("mergeSchema", True).parquet(out_dir).drop("run")
    settled = rows.where(_SETTLED)
    late = rows.where("reject_reason = 'missing_reference'").join(settled.select("Pred_File_Path").distinct(), "Pred_File_Path", "left_anti")
    return settled.unionByName(late)

"""Transcription and translation jobs (B3, B4) around the user's model functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tulkki import dims
from tulkki.functions import text as tx
from tulkki.operators import relational as rel
from tulkki.operators.infer import batch_map, chunk_items, overlap_chunks
from tulkki.operators.stitch import stitch_chunks, stitched_text


def translate_job(lines: DataFrame, make_predict: Callable, langs: list[str], lang_col: str | None = None,
                  batch_size: int = 4) -> tuple[DataFrame, DataFrame]:
    """Translate every line into each other language with every model for that direction.

    ``lines``: file_name, pos, text; the source language is the file name's
    leading code, or ``lang_col``.  Returns the translations (path, file_name,
    src_lang, tgt_lang, mt_model, pos, text) and the rejects (with
    ``reject_reason``): files without a known language, and lines for which a
    model failed or gave nothing.
    """
    lang = F.col(lang_col) if lang_col else F.lower(F.regexp_extract("file_name", r"^([A-Za-z]{2})[-_]", 1))
    rows = lines.select("file_name", "pos", "text", lang.alias("src_lang"))
    rows = rows.withColumn("reject_reason", rel.first_reason((~F.coalesce(rel.known_language("src_lang", langs), F.lit(False)), "unknown_language")))
    known, unknown = rel.split_rejects(rows)
    fan = rel.fan_out(known, langs, "src_lang")
    models = F.array(*[F.lit(m) for m in dims.MT_MODELS])
    routed = fan.withColumn("mt_model", F.explode(F.filter(models, lambda m: rel.mt_model_applies(m, F.col("src_lang"), F.col("tgt_lang")))))
    done = batch_map(routed, make_predict, ["text"], "translation", batch_size, model_col="mt_model")
    folder = F.element_at(F.create_map(*[F.lit(x) for kv in dims.MT_MODELS.items() for x in kv]), F.col("mt_model"))
    name = tx.result_name("mt_prediction", base=F.regexp_replace(tx.file_stem("file_name"), "-", "_"), model=tx.model_family("mt_model"),
                          src="src_lang", tgt="tgt_lang")
    path = F.concat_ws("/", F.lit("data/results/mt"), folder, name)
    good = done.where("translation_error IS NULL").select(path.alias("path"), "file_name", "src_lang", "tgt_lang", "mt_model", "pos",
                                                          tx.strip(F.col("translation")).alias("text"))
    bad = done.where("translation_error IS NOT NULL").withColumnRenamed("translation_error", "reject_reason").drop("translation")
    return good, unknown.unionByName(bad, allowMissingColumns=True)


def transcribe_job(spark: SparkSession, manifest: DataFrame, make_predict: Callable, done: DataFrame | None = None,
                   batch_size: int = 8) -> tuple[DataFrame, DataFrame]:
    """Transcribe every recording with every model for its language.

    ``manifest``: path, file_name, Language (see ``audio_manifest``); the
    model gets paths and returns texts.  What ``done`` (path, asr_model) lists
    is left out.  Returns the transcripts (pred_path, path, Language,
    asr_model, text) and the rejects.
    """
    rows = manifest.select("path", "file_name", "Language")
    rows = rows.withColumn("reject_reason", rel.first_reason((F.col("Language").isNull(), "unknown_language")))
    known, unknown = rel.split_rejects(rows)
    work = rel.applicable_asr(known, F.broadcast(dims.asr_models(spark)), "Language").drop("model_no")
    if done is not None:
        work = rel.skip_done(work, done, ["path", "asr_model"])
    out = batch_map(work, make_predict, ["path"], "text", batch_size, model_col="asr_model")
    pred = F.format_string("data/results/asr/%s/%s_transcription.txt", "asr_folder", tx.file_stem("file_name"))
    good = out.where("text_error IS NULL").select(pred.alias("pred_path"), "path", "Language", "asr_model", tx.strip(F.col("text")).alias("text"))
    bad = out.where("text_error IS NOT NULL").withColumnRenamed("text_error", "reject_reason").drop("text", "asr_folder")
    return good, unknown.unionByName(bad, allowMissingColumns=True)


def transcribe_recordings(spark: SparkSession, root: str, make_predict: Callable, done: DataFrame | None = None, pattern: str = "*.wav",
                          batch_size: int = 8, max_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """B3 with the recordings' bytes: the model gets contents and returns texts.

    Recordings under ``root`` are read where they are mapped, once for each
    model that applies to their language: contents are never shuffled, and the
    tasks of one model follow those of another, so that a worker loads each
    once.  A call has ``batch_size`` recordings and ``max_bytes`` at most (or
    one longer recording).  ``done``, transcripts and rejects are those of
    ``transcribe_job``; recordings of an unknown language are rejects.  Files
    of no bytes at all aren't listed by Spark and give no row.
    """
    from tulkki.sources.files import audio_manifest
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    named = files.select("path", tx.file_name("path").alias("file_name"), "content")
    named = named.withColumn("Language", tx.parse_recording(tx.file_stem("file_name"))["lang"])
    out = None
    for model, folder in dims.ASR_MODELS.items():
        work = named.where(F.col("Language").isNotNull() & rel.asr_model_applies(F.lit(model), F.col("Language")))
        if done is not None:
            work = work.join(done.where(F.col("asr_model") == model).select("path").distinct(), "path", "left_anti")
        work = work.select("path", "file_name", "Language", F.lit(model).alias("asr_model"), F.lit(folder).alias("asr_folder"), "content")
        part = batch_map(work, make_predict, ["content"], "text", batch_size, model=model, max_bytes=max_bytes, drop_inputs=True)
        out = part if out is None else out.unionByName(part)
    pred = F.format_string("data/results/asr/%s/%s_transcription.txt", "asr_folder", tx.file_stem("file_name"))
    good = out.where("text_error IS NULL").select(pred.alias("pred_path"), "path", "Language", "asr_model", tx.strip(F.col("text")).alias("text"))
    bad = out.where("text_error IS NOT NULL").withColumnRenamed("text_error", "reject_reason").drop("text", "asr_folder")
    unknown = audio_manifest(spark, root, pattern).where("Language IS NULL").select("path", "file_name", "Language", F.lit("unknown_language").alias("reject_reason"))
    return good, unknown.unionByName(bad, allowMissingColumns=True)


def transcribe_in_chunks(recordings: DataFrame, make_predict: Callable, keys: list[str], samples: str = "samples", chunk_len: int = 30, left: int = 4,
                         right: int = 2, overlap_words: int | None = None, least_share: float = 0.6, batch_size: int = 8, model: str = "default",
                         max_bytes: int | None = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """B3 and B5 together: recordings (keys, an array of ``samples``) in overlapping chunks, the model's texts stitched.

    The model gets each chunk's samples and returns its text.  Neighbouring
    texts share ``overlap_words`` words at most (as many as samples, unless
    given).  Returns keys and text of each recording, and the chunks for which
    the model failed or gave nothing, with ``reject_reason``; their
    recordings' texts lack what only those chunks have.
    """
    chunks = recordings.select(*keys, samples, F.explode(overlap_chunks(samples, chunk_len, left, right)).alias("c"))
    chunks = chunks.select(*keys, "c.chunk_no", "c.start", chunk_items(samples, "c.start", chunk_len).alias(samples))
    heard = batch_map(chunks, make_predict, [samples], "text", batch_size, model=model, max_bytes=max_bytes, drop_inputs=True)
    words = heard.select(*keys, "chunk_no", tx.words("text").alias("words"))
    good = stitched_text(stitch_chunks(words, keys, left + right if overlap_words is None else overlap_words, least_share=least_share), keys)
    return good, heard.where("text_error IS NOT NULL").select(*keys, "chunk_no", "start", F.col("text_error").alias("reject_reason"))

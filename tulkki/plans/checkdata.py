"""Evaluation inputs derived by Spark from the driver's tables.

The evaluated setup (recordings, transcripts, translations) is not shipped,
so it is derived from ``documents``: each document is one recording whose
reference is the document's own text; each applicable ASR model yields a
transcript whose words are a deterministic corruption of the reference, with
an error rate that rises with the recording condition.  Every document and
every line takes part; nothing is sampled.

All derivations stay inside one row (array higher-order functions; the words
are corrupted by an Arrow UDF, once for each line).  One repartition by document comes before them, whatever the input: it
spreads the work that follows, which is done row by row and heavy.  Models come after it, so that a text travels and is cut into lines once.
"""

from __future__ import annotations

from functools import lru_cache, partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki import dims
from tulkki.functions import text as tx
from tulkki.functions.columns import materialize

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- fixed values of the derivation (mirrored in the oracle SQL) ----------
# corruption hash h = (doc*13 + line*7 + word*5 + model*3) % 31;
# keep the word when h >= 2*condition + model, else by h % 3:
# 0 drop, 1 misspell (append 'q'), 2 repeat
# condition = 1 + doc % 6, speaker group = SPEAKER_GROUPS[(doc / 6) % 4]
# ---------------------------------------------------------------------------


@lru_cache(maxsize=1 << 12)
def _changes(start: int, least: int) -> list[tuple[int, int]]:
    """The words of a cycle of 31 that don't stay, and what becomes of them, for a line whose first word has hash ``start``."""
    return [(i, h % 3) for i in range(31) if (h := (start + 5 * i) % 31) < least]


def corrupted_line(line: str, doc: int | None, pos: int, k: int, c: int | None) -> str:
    """The corruption above, of the words of one line; without a key every word is repeated."""
    words = line.split(" ")
    first = None if doc is None else doc * 13 + pos * 7 + k * 3
    if first is None:
        changes, step = [(0, 2)], 1
    elif first >= 0:
        changes, step = _changes(first % 31, c * 2 + k), 31
    else:
        # remainders have the sign of the hash, as in Spark and SQL
        hashes = [x % 31 if x >= 0 else -(-x % 31) for x in range(first, first + 5 * len(words), 5)]
        changes, step = [(i, h % 3 if h >= 0 or h % 3 == 0 else 2) for i, h in enumerate(hashes) if h < c * 2 + k], len(words)
    dropped = False
    for i, change in changes:
        if i >= len(words):
            break
        if change == 0:
            words[i::step] = [None] * len(words[i::step])
            dropped = True
        else:
            words[i::step] = [w + "q" if change == 1 else f"{w} {w}" for w in words[i::step]]
    return " ".join([w for w in words if w is not None] if dropped else words)


@partial(F.pandas_udf, returnType=T.StringType())
def _corrupt_texts(texts: pd.Series, doc: pd.Series, pos: pd.Series, k: pd.Series, c: pd.Series) -> pd.Series:
    keys = ([None if pd.isna(x) else int(x) for x in column] for column in (doc, pos, k, c))
    return pd.Series([None if t is None else "\n".join(corrupted_line(line, d, p + n, m, e) for n, line in enumerate(t.split("\n")))
                      for t, d, p, m, e in zip(texts, *keys, strict=True)], dtype=object)


def _corrupt_line(line: Column, doc: Column, pos: Column, k: Column, c: Column) -> Column:
    """One line, which holds no line break."""
    # a key of 64 bits doesn't fit the floats that pandas has for columns with nulls
    return _corrupt_texts(line, doc.cast("string"), pos.cast("long"), k.cast("long"), c.cast("string"))


def _corrupt_lines(df: DataFrame, lines: str, k: Column, out: str) -> DataFrame:
    """``df`` with the list ``out`` of its corrupted ``lines`` (none of them empty), by doc_id and cond_no."""
    text = _corrupt_line(F.array_join(lines, "\n"), F.col("doc_id"), F.lit(0), k, F.col("cond_no"))
    df = df.withColumn("_corrupted", text)
    return materialize(df, **{out: F.when(F.size(lines) == 0, F.array().cast("array<string>")).otherwise(F.split("_corrupted", "\n"))}).drop("_corrupted")


def recordings(documents: DataFrame) -> DataFrame:
    """One recording per document: key, language, speaker group, condition, name.

    Names follow the recording grammar (``en-nat-m-c3-17``); one document in
    ten gets an upper-case ``_`` spelling (no metadata, index still found) and
    one in ten a free name (no metadata, no index), as real folders have.
    """
    d = documents.select("doc_id", "lang", "text")
    c = (F.col("doc_id") % 6 + 1).cast("int")
    g = F.element_at(F.array(*[F.lit(s) for s in dims.SPEAKER_GROUPS]),
                     (F.floor(F.col("doc_id") / 6) % 4 + 1).cast("int"))
    cond = F.concat(F.lit("c"), c.cast("string"))
    doc = F.col("doc_id").cast("string")
    name = (F.when(F.col("doc_id") % 10 == 9, F.concat(F.lit("notes-"), doc))
             .when(F.col("doc_id") % 10 == 7, F.concat_ws("_", F.upper("lang"), g, cond, doc))
             .otherwise(F.concat_ws("-", "lang", F.regexp_replace(g, "_", "-"), cond, doc)))
    return d.withColumn("cond_no", c).withColumn("group", g).withColumn("recording", name)


def _parts(df: DataFrame) -> int:
    """Given as a number, so that few bytes, whose scores are heavy, aren't put together in fewer tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fanned_lines(documents: DataFrame) -> DataFrame:
    """Recording x applicable ASR model -> ref_lines."""
    rec = recordings(documents)
    # the 5-entry model registry as a literal array: P1 applicability is an
    # in-row filter + explode, so the fan-out needs no join
    reg = F.array(*[F.struct(F.lit(n).alias("asr_model"), F.lit(f).alias("asr_folder"),
                             F.lit(i + 1).alias("model_no"))
                    for i, (n, f) in enumerate(dims.ASR_MODELS.items())])
    from tulkki.operators.relational import asr_model_applies
    lines = materialize(rec.repartition(_parts(documents), "doc_id"), ref_lines=tx.split_lines(F.col("text"))).drop("text")
    return (lines.withColumn("m", F.explode(F.filter(reg, lambda m: asr_model_applies(m["asr_model"], F.col("lang")))))
                 .select("*", "m.*").drop("m"))


def asr_outputs(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Recording x applicable ASR model -> reference lines and transcript lines.

    Columns: doc_id, lang, asr_model, asr_folder, model_no, cond_no, recording,
    pred_path, ref_lines array<string>, pred_lines array<string>.
    """
    out = _corrupt_lines(_fanned_lines(documents), "ref_lines", F.col("model_no"), "hyp_lines")
    out = materialize(out, pred_lines=F.filter(F.transform("hyp_lines", tx.strip), lambda x: x != "")).drop("hyp_lines")
    return out.withColumn("pred_path", transcript_path(F.col("asr_folder"), F.col("recording")))


def transcript_path(folder: Column, recording: Column) -> Column:
    return F.format_string("data/results/asr/%s/%s_transcription.txt", folder, recording)


def line_pairs(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Line-level (reference, hypothesis) pairs: every non-blank line x ASR model.

    Columns: doc_id, pos, lang, asr_model, model_no, cond_no, group, ref, hyp.
    """
    lines = _fanned_lines(documents).select("doc_id", "lang", "asr_model", "model_no", "cond_no", "group", F.posexplode("ref_lines").alias("pos", "ref"))
    # line by line, as a batch of lines is far smaller than one of recordings; an emptied line stays, as ''
    hyp = _corrupt_line(F.col("ref"), F.col("doc_id"), F.col("pos"), F.col("model_no"), F.col("cond_no"))
    return lines.withColumn("hyp", hyp).withColumn("hyp", tx.strip("hyp"))


# --- fixed values: corpus languages used as MT sources ------------------------
CORPUS_LANGS = ["en", "fr", "de", "es"]
# ---------------------------------------------------------------------------


def languages(documents: DataFrame, most: int = 1000) -> list[str]:
    """The languages of the documents, of which there may be ``most``: more are no language codes."""
    found = [r["lang"] for r in documents.select("lang").where("lang IS NOT NULL").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} languages")
    return sorted(found)


def benchmark_pairs(spark: SparkSession, benchmark: DataFrame) -> DataFrame:
    """Every benchmark item x ASR model x condition: the normalised text and a corruption of it.

    Columns: item_id, asr_model, Condition_Code, ref, hyp."""
    models = F.array(*[F.struct(F.lit(n).alias("asr_model"), F.lit(i + 1).alias("model_no")) for i, n in enumerate(dims.ASR_MODELS)])
    codes = F.array(*[F.struct(F.lit(c[0]).alias("Condition_Code"), F.lit(int(c[0][1:])).alias("cond_no")) for c in dims.CONDITIONS])
    b = benchmark.select("item_id", tx.normalize("text").alias("ref"), F.explode(models).alias("m"))
    b = b.select("item_id", "ref", "m.*", F.explode(codes).alias("c")).select("item_id", "ref", "asr_model", "model_no", "c.*")
    hyp = _corrupt_line(F.col("ref"), F.col("item_id"), F.lit(0), F.col("model_no"), F.col("cond_no"))
    return b.select("item_id", "asr_model", "Condition_Code", "ref", hyp.alias("hyp"))


def _mt_model(src: Column, tgt: Column, doc: Column) -> Column:
    """The Opus model of the pair for even keys when there is one, else NLLB."""
    opus = F.concat(F.lit("opus_mt_"), src, F.lit("_"), tgt)
    return F.when(opus.isin(*dims.MT_MODELS.keys()) & (doc % 2 == 0), opus).otherwise(F.lit("nllb"))


def _other_language(lang: Column, doc: Column) -> Column:
    others = F.filter(F.array(*[F.lit(x) for x in CORPUS_LANGS]), lambda x: x != lang)
    return F.element_at(others, (doc % F.size(others) + 1).cast("int"))


def _translated(line: Column) -> Column:
    """The stand-in for a reference translation: the words in reverse, so that source and reference differ."""
    return F.array_join(F.reverse(F.split(line, " ")), " ")


def _mt_number(model: Column) -> Column:
    return F.when(model == "nllb", F.lit(11)).otherwise(F.lit(12))


def mt_segments(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Sentence segments of every document as translation test items.

    Each document is translated into one other corpus language (chosen by
    key).  The reference is the source sentence with its words in reverse, the
    hypothesis a deterministic corruption of the reference.

    Columns: doc_id, pos, src_lang, tgt_lang, mt_model, cond_no, src, ref, hyp.
    """
    d = documents.select("doc_id", "lang", "text").repartition(_parts(documents), "doc_id")
    seg = (d.select("doc_id", F.col("lang").alias("src_lang"), F.posexplode(tx.sentence_array("text")).alias("pos", "src"))
            .withColumn("tgt_lang", _other_language(F.col("src_lang"), F.col("doc_id"))))
    seg = (seg.withColumn("mt_model", _mt_model(F.col("src_lang"), F.col("tgt_lang"), F.col("doc_id")))
              .withColumn("cond_no", (F.col("doc_id") % 6 + 1).cast("int")))
    seg = materialize(seg, ref=_translated(F.col("src")))
    hyp = tx.strip(_corrupt_line(F.col("ref"), F.col("doc_id"), F.col("pos"), _mt_number(F.col("mt_model")), F.col("cond_no")))
    return seg.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "src_lang", "tgt_lang", "mt_model", "cond_no", "src", "ref", hyp.alias("hyp"))


def mt_on_asr_lists(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Translations of transcripts: recording x ASR model -> three lists of lines.

    The source is the transcript itself (blank lines dropped), the reference
    one line for each line of the recording, the hypothesis a corruption of
    the reference; the lists may differ in length.

    Columns: doc_id, src_lang, tgt_lang, asr_model, mt_model, Source_File, src_lines, ref_lines, hyp_lines.
    """
    o = asr_outputs(spark, documents).withColumn("tgt_lang", _other_language(F.col("lang"), F.col("doc_id")))
    o = o.withColumn("mt_model", _mt_model(F.col("lang"), F.col("tgt_lang"), F.col("doc_id")))
    o = materialize(o, refs=F.transform("ref_lines", _translated))
    o = _corrupt_lines(o, "refs", _mt_number(F.col("mt_model")), "hyps")
    return o.select("doc_id", F.col("lang").alias("src_lang"), "tgt_lang", "asr_model", "mt_model", F.col("pred_path").alias("Source_File"),
                    F.col("pred_lines").alias("src_lines"), F.col("refs").alias("ref_lines"), F.transform("hyps", tx.strip).alias("hyp_lines"))

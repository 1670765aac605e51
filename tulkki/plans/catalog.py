"""Registered queries: one per operator of the inventory, on the driver's tables.

Each entry is ``name -> (builder(spark, sf_dir) -> DataFrame, oracle SQL or None)``.
Every query reads whole tables (or data Spark derives from them); doubles are
rounded to 6 places on both sides so the oracle compare is exact.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki import dims
from tulkki.functions import text as tx
from tulkki.operators import relational as rel
from tulkki.functions.columns import materialize
from tulkki.plans import checkdata as corpus
from tulkki.plans import sqltext as q

CATALOG: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        CATALOG[name] = (fn, sql)
        return fn
    return deco


def _t(spark, sf_dir, name):
    return corpus.table(spark, sf_dir, name)


def _r6(c):
    return F.round(c, 6)


# ----------------------------------------------------------------- F: scalar text

@register("f1_normalize", f"""
SELECT doc_id, lang, {q.normalize('text')} AS norm FROM documents""")
def f1_normalize(spark, d):
    return _t(spark, d, "documents").select("doc_id", "lang", tx.normalize("text").alias("norm"))


_ABBR = "|".join(tx.ABBREVIATIONS)
_PH = "' || chr(57344) || '"  # SQL text: the private-use placeholder


@register("f2_split_sentences", rf"""
WITH s AS (
  SELECT doc_id,
    replace(regexp_replace(regexp_replace({q.strip('text')},
        '(^|[^\pL\pN_])({_ABBR})\.\s*', '\1\2{_PH}', 'gi'), '\.\s*', '.' || chr(10), 'g'), '{_PH}', '. ') AS t
  FROM documents),
l AS (SELECT doc_id, {q.split_lines('t')} AS sents FROM s)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, sents[i] AS sentence
FROM l, unnest(range(1, len(sents) + 1)) u(i)""")
def f2_split_sentences(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(tx.sentence_array("text")).alias("pos", "sentence")) \
               .withColumn("pos", F.col("pos").cast("bigint"))


@register("s1_read_lines", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS line FROM l, unnest(range(1, len(ls) + 1)) u(i)""")
def s1_read_lines(spark, d):
    """S1/F16 line-explode core on whole documents: strip, drop blanks, dense pos."""
    return (_t(spark, d, "documents")
            .select("doc_id", F.posexplode(tx.split_lines("text")).alias("pos", "line"))
            .withColumn("pos", F.col("pos").cast("bigint")))


@register("f17_lower", "SELECT doc_id, lower(text) AS lowered FROM documents")
def f17_lower(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.lower("text").alias("lowered"))


@register("f18_f19_words", f"""
SELECT doc_id, CAST(len({q.words('text')}) AS BIGINT) AS n_words,
       array_to_string({q.words('text')}[1:512], ' ') AS head512
FROM documents""")
def f18_f19_words(spark, d):
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.size(tx.words("text")).cast("bigint").alias("n_words"),
                       tx.truncate_tokens("text", 512).alias("head512"))


_META_SQL = rf"""
WITH {q.corpus_ctes()},
b AS (
  SELECT doc_id, asr_model, pred_path,
         regexp_extract(pred_path, '[^/]*$') AS fname
  FROM outs),
c AS (
  SELECT *, CASE WHEN regexp_matches(fname, '(?i)_transcription\.txt$')
                 THEN regexp_replace(fname, '(?i)_transcription\.txt$', '')
                 ELSE regexp_replace(fname, '^(.*[^.].*)\.[^.]*$', '\1') END AS base
  FROM b),
m AS (
  SELECT *, regexp_matches(base, '{tx.RECORDING_RE}') AS ok,
         regexp_extract(base, '(?i)[-_]c(\d+)', 1) AS num
  FROM c)
SELECT doc_id, asr_model, base,
  CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 1) END AS lang,
  CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 2) END AS speaker_type,
  CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 3) END AS speaker_gender,
  CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 4) END AS condition,
  CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 2) || '_' || regexp_extract(base, '{tx.RECORDING_RE}', 3) END AS speaker_group,
  coalesce(TRY_CAST(num AS BIGINT) - 1, -1) AS line_index,
  CASE WHEN ok THEN concat_ws('-', regexp_extract(base, '{tx.RECORDING_RE}', 1), regexp_extract(base, '{tx.RECORDING_RE}', 2),
                              regexp_extract(base, '{tx.RECORDING_RE}', 3), regexp_extract(base, '{tx.RECORDING_RE}', 4))
       ELSE base END || '.wav' AS audio_name,
  CASE WHEN len(string_split(pred_path, '/')) >= 2 THEN string_split(pred_path, '/')[-2] ELSE 'unknown_model' END AS model_folder,
  translate(asr_model, '/-.', '___') AS safe_model,
  split_part(asr_model, '_', 1) AS family,
  printf('asr_eval_%s_%s.json', coalesce(CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 1) END, 'xx'),
         CASE WHEN len(string_split(pred_path, '/')) >= 2 THEN string_split(pred_path, '/')[-2] ELSE 'unknown_model' END) AS eval_name
FROM m"""


@register("f3_f10_recording_meta", _META_SQL)
def f3_f10_recording_meta(spark, d):
    """F3-F8, F10, F13, F15 on the transcript paths derived from documents."""
    out = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    base = tx.recording_base(tx.file_name("pred_path"))
    df = out.select("doc_id", "asr_model", "pred_path", base.alias("base"))
    meta = tx.parse_recording(F.col("base"))
    folder = tx.model_folder("pred_path")
    return df.select(
        "doc_id", "asr_model", "base",
        meta["lang"].alias("lang"), meta["speaker_type"].alias("speaker_type"),
        meta["speaker_gender"].alias("speaker_gender"), meta["condition"].alias("condition"),
        meta["speaker_group"].alias("speaker_group"),
        tx.line_index("base").alias("line_index"),
        tx.audio_name(F.col("base"), meta).alias("audio_name"),
        folder.alias("model_folder"),
        tx.safe_name("asr_model").alias("safe_model"),
        tx.model_family("asr_model").alias("family"),
        tx.result_name("asr_eval", lang=F.coalesce(meta["lang"], F.lit("xx")), model=folder).alias("eval_name"))


@register("f9_f12_page_names", r"""
WITH p AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS fname FROM pages)
SELECT page_id, fname AS file_name,
  regexp_replace(fname, '^(.*[^.].*)\.[^.]*$', '\1') AS file_stem,
  split_part(fname, '.', 1) AS stem_before_dot,
  CASE WHEN lower(substr(fname, 1, 2)) IN ('fi', 'en', 'fr') THEN lower(substr(fname, 1, 2)) END AS lang_from_name,
  regexp_extract(url, '[^/]*$') AS short_name
FROM p""")
def f9_f12_page_names(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", tx.file_name("url").alias("file_name"), tx.file_stem("url").alias("file_stem"),
                    tx.stem_before_dot("url").alias("stem_before_dot"),
                    tx.lang_from_name("url").alias("lang_from_name"),
                    tx.short_name("url").alias("short_name"))


@register("f11_lang_from_path", r"""
WITH p AS (SELECT doc_id, 'data/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path FROM documents),
s AS (SELECT doc_id, string_split(path, '/') AS parts FROM p),
a AS (SELECT doc_id, parts, list_position(parts, 'data') AS pa FROM s)
SELECT doc_id, CASE WHEN pa > 0 AND len(parts) > pa AND parts[pa + 1] IN ('fi', 'en', 'fr') THEN parts[pa + 1] END AS lang
FROM a""")
def f11_lang_from_path(spark, d):
    docs = _t(spark, d, "documents")
    path = F.concat_ws("/", F.lit("data"), "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", tx.lang_from_path(path).alias("lang"))


# ----------------------------------------------------------------- P: predicates

@register("p1_applicable_asr", f"""
SELECT d.doc_id, m.asr_model FROM documents d JOIN {q.ASR_MODELS} m
  ON (NOT contains(m.asr_model, 'wav2vec2') OR suffix(m.asr_model, d.lang))""")
def p1_applicable_asr(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    return rel.applicable_asr(docs, F.broadcast(dims.asr_models(spark)), "lang").select("doc_id", "asr_model")


@register("p2_j5_applicable_mt", f"""
WITH l AS (SELECT DISTINCT lang FROM documents),
p AS (SELECT a.lang AS src_lang, b.lang AS tgt_lang FROM l a, l b WHERE a.lang <> b.lang)
SELECT p.src_lang, p.tgt_lang, m.mt_model FROM p JOIN {q.MT_MODELS} m
  ON (contains(m.mt_model, p.src_lang || '_' || p.tgt_lang) OR starts_with(m.mt_model, 'nllb'))""")
def p2_j5_applicable_mt(spark, d):
    langs = _t(spark, d, "documents").select("lang").distinct()
    pairs = rel.language_pairs(langs)
    return rel.applicable_mt(pairs, F.broadcast(dims.mt_models(spark))).select("src_lang", "tgt_lang", "mt_model")


@register("p3_valid_text", r"""
WITH t AS (SELECT conv_id, turn, role, CASE conv_id % 4 WHEN 1 THEN text || ' ERROR: no audio' WHEN 2 THEN repeat(' ', CAST(turn AS INT) + 1) || chr(9)
    WHEN 3 THEN NULL ELSE text END AS text FROM conversations)
SELECT conv_id, turn, role,
  (text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 0 AND NOT contains(text, 'ERROR')) AS valid
FROM t""")
def p3_valid_text(spark, d):
    """P3 on turns of which some are marked as failed, blank or missing."""
    kind = F.col("conv_id") % 4
    text = (F.when(kind == 1, F.concat("text", F.lit(" ERROR: no audio")))
             .when(kind == 2, F.concat(F.repeat(F.lit(" "), (F.col("turn") + 1).cast("int")), F.lit("\t")))
             .when(kind != 3, F.col("text")))
    c = _t(spark, d, "conversations").withColumn("text", text)
    return c.select("conv_id", "turn", "role", F.coalesce(rel.valid_text("text"), F.lit(False)).alias("valid"))


@register("p4_known_language", """
SELECT lang, lang IN ('fi', 'en', 'fr') AS known, count(*) AS n FROM documents GROUP BY lang""")
def p4_known_language(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")) \
               .select("lang", rel.known_language("lang").alias("known"), "n")


@register("p5_p6_rejects", rf"""
WITH {q.corpus_ctes()},
c AS (
  SELECT doc_id, asr_model, len(ref_lines) AS n_ref_lines, pred_lines,
         regexp_extract(regexp_extract(pred_path, '[^/]*$'), '(?i)[-_]c(\d+)', 1) AS num
  FROM outs),
i AS (
  SELECT *, CASE WHEN n_ref_lines = 1 THEN 0 ELSE coalesce(TRY_CAST(num AS BIGINT) - 1, -1) END AS line_index FROM c)
SELECT doc_id, asr_model, line_index, CAST(n_ref_lines AS BIGINT) AS n_ref_lines,
  CASE WHEN line_index < 0 OR line_index >= n_ref_lines THEN 'invalid_line_index'
       WHEN len(pred_lines) = 0 THEN 'empty_prediction' END AS reject_reason
FROM i""")
def p5_p6_rejects(spark, d):
    """P5 against the raw reference's line count, P6 first failing reason."""
    out = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    n = F.size("ref_lines")
    idx = rel.effective_line_index(tx.line_index(tx.file_name("pred_path")), n)
    df = out.select("doc_id", "asr_model", idx.alias("line_index"), n.cast("bigint").alias("n_ref_lines"), "pred_lines")
    reason = rel.first_reason((~rel.line_index_ok(F.col("line_index"), F.col("n_ref_lines")), "invalid_line_index"),
                              (F.size("pred_lines") == 0, "empty_prediction"))
    return df.select("doc_id", "asr_model", "line_index", "n_ref_lines", reason.alias("reject_reason"))


# ----------------------------------------------------------------- J: joins

@register("p10_only", f"""
WITH {q.corpus_ctes()}
SELECT doc_id, lang, pred_path, len(pred_lines) AS n_lines FROM outs WHERE asr_model = 'parakeet'""")
def p10_only(spark, d):
    """P10: the transcripts of one model, by the filter that makes a job a single slice's."""
    out = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    return rel.only(out, "asr_model", "parakeet").select("doc_id", "lang", "pred_path", F.size("pred_lines").cast("bigint").alias("n_lines"))


@register("p6_warnings", f"""
WITH {q.corpus_ctes()},
b AS (SELECT doc_id, asr_model, len(ref_lines) AS n_ref, len(pred_lines) AS n_pred, regexp_matches(recording, '{tx.RECORDING_RE}') AS ok FROM outs)
SELECT doc_id, asr_model, concat_ws(',', CASE WHEN n_ref <> n_pred THEN 'count_mismatch' END, CASE WHEN NOT ok THEN 'unparsed_metadata' END,
  CASE WHEN n_pred = 0 THEN 'missing_prediction' END) AS warnings FROM b""")
def p6_warnings(spark, d):
    """What each transcript is flagged for, on rows that stay."""
    from tulkki.operators.observed import warned
    out = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    base = tx.recording_base(tx.file_name("pred_path"))
    flags = warned((F.size("ref_lines") != F.size("pred_lines"), "count_mismatch"), (tx.parse_recording(base)["lang"].isNull(), "unparsed_metadata"),
                   (F.size("pred_lines") == 0, "missing_prediction"))
    return out.select("doc_id", "asr_model", F.array_join(flags, ",").alias("warnings"))


@register("j1_align_by_position", """
WITH u AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'assistant')
SELECT u.conv_id, CAST(u.pos AS BIGINT) AS pos, u.text AS user_text, a.text AS assistant_text
FROM u JOIN a ON u.conv_id = a.conv_id AND u.pos = a.pos""")
def j1_align_by_position(spark, d):
    c = _t(spark, d, "conversations")
    u = rel.dense_pos(c.filter(F.col("role") == "user"), ["conv_id"], "turn").select("conv_id", "pos", F.col("text").alias("user_text"))
    a = rel.dense_pos(c.filter(F.col("role") == "assistant"), ["conv_id"], "turn").select("conv_id", "pos", F.col("text").alias("assistant_text"))
    return rel.align_by_position(u, a, ["conv_id"])


@register("j1_count_mismatch", """
WITH u AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id),
a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.n, 0) AS n_left, coalesce(a.n, 0) AS n_right,
       coalesce(u.n, 0) <> coalesce(a.n, 0) AS count_mismatch
FROM u FULL JOIN a ON u.conv_id = a.conv_id""")
def j1_count_mismatch(spark, d):
    c = _t(spark, d, "conversations")
    return rel.count_mismatch(c.filter(F.col("role") == "user"), c.filter(F.col("role") == "assistant"), ["conv_id"])


@register("j2_with_condition", f"""
WITH {q.corpus_ctes()}
SELECT r.doc_id, 'c' || r.cond_no AS Condition_Code, c.Noise_Level, c.Noise_Type, c.Voice_Volume
FROM rec r LEFT JOIN {q.CONDITIONS} c ON 'c' || r.cond_no = c.Condition_Code""")
def j2_with_condition(spark, d):
    rec = corpus.recordings(_t(spark, d, "documents"))
    df = rec.select("doc_id", F.concat(F.lit("c"), F.col("cond_no").cast("string")).alias("Condition_Code"))
    return rel.with_condition(df, dims.conditions(spark))


@register("j3_with_mt_model", f"""
WITH l AS (SELECT DISTINCT lang FROM documents),
p AS (SELECT a.lang AS src_lang, b.lang AS tgt_lang FROM l a, l b WHERE a.lang <> b.lang)
SELECT p.src_lang, p.tgt_lang, o.opus_model, CASE WHEN o.opus_model IS NULL THEN 'unsupported_pair' END AS pair_reject
FROM p LEFT JOIN {q.OPUS} o ON p.src_lang = o.src_lang AND p.tgt_lang = o.tgt_lang""")
def j3_with_mt_model(spark, d):
    langs = _t(spark, d, "documents").select("lang").distinct()
    return rel.with_mt_model(rel.language_pairs(langs), dims.opus_pairs(spark)) \
              .select("src_lang", "tgt_lang", "opus_model", "pair_reject")


@register("j4_with_code", f"""
SELECT d.doc_id, coalesce(n.nllb_code, d.lang) AS code FROM documents d LEFT JOIN {q.NLLB} n ON d.lang = n.lang""")
def j4_with_code(spark, d):
    docs = _t(spark, d, "documents").select("doc_id", "lang")
    return rel.with_code(docs, dims.languages(spark), "lang", "lang", "nllb_code", "code").select("doc_id", "code")


@register("j6_fan_out", f"""
WITH l AS (SELECT DISTINCT lang FROM documents),
s AS (SELECT doc_id, lang, {q.split_lines('text')} AS ls FROM documents),
x AS (SELECT doc_id, lang, CAST(i - 1 AS BIGINT) AS pos FROM s, unnest(range(1, len(ls) + 1)) u(i))
SELECT x.doc_id, x.pos, x.lang AS src_lang, l.lang AS tgt_lang FROM x JOIN l ON x.lang <> l.lang""")
def j6_fan_out(spark, d):
    docs = _t(spark, d, "documents")
    lines = docs.select("doc_id", "lang", F.posexplode(tx.split_lines("text")).alias("pos", "line")) \
                .withColumn("pos", F.col("pos").cast("bigint"))
    return rel.fan_out(lines, corpus.languages(docs)).select("doc_id", "pos", F.col("lang").alias("src_lang"), "tgt_lang")


@register("j7_task_grid", f"""
WITH {q.corpus_ctes()},
langs AS (SELECT DISTINCT lang FROM documents),
pairs AS (SELECT a.lang AS src_lang, b.lang AS tgt_lang FROM langs a, langs b WHERE a.lang <> b.lang),
g AS (SELECT p.src_lang, p.tgt_lang, a.asr_model, s.grp, c.Condition_Code, m.mt_model
      FROM pairs p, {q.ASR_MODELS} a, (SELECT unnest({q.GROUPS}) AS grp) s, {q.CONDITIONS} c, {q.MT_MODELS} m
      WHERE (NOT contains(a.asr_model, 'wav2vec2') OR suffix(a.asr_model, p.src_lang))
        AND (contains(m.mt_model, p.src_lang || '_' || p.tgt_lang) OR starts_with(m.mt_model, 'nllb'))),
have AS (SELECT DISTINCT lang AS src_lang, asr_model, grp, 'c' || cond_no AS Condition_Code FROM outs)
SELECT g.* FROM g SEMI JOIN have USING (src_lang, asr_model, grp, Condition_Code)""")
def j7_task_grid(spark, d):
    """ASR model x speaker group x condition x MT model, limited to existing transcripts."""
    docs = _t(spark, d, "documents")
    pairs = rel.language_pairs(docs.select("lang").distinct())
    grid = (pairs.crossJoin(F.broadcast(dims.asr_models(spark).select("asr_model")))
                 .filter(rel.asr_model_applies(F.col("asr_model"), F.col("src_lang")))
                 .crossJoin(F.broadcast(dims.speaker_groups(spark).withColumnRenamed("Speaker_Group", "grp")))
                 .crossJoin(F.broadcast(dims.conditions(spark).select("Condition_Code")))
                 .crossJoin(F.broadcast(dims.mt_models(spark).select("mt_model")))
                 .filter(rel.mt_model_applies(F.col("mt_model"), F.col("src_lang"), F.col("tgt_lang"))))
    out = corpus.asr_outputs(spark, docs)
    have = out.select(F.col("lang").alias("src_lang"), "asr_model", F.col("group").alias("grp"),
                      F.concat(F.lit("c"), F.col("cond_no").cast("string")).alias("Condition_Code"))
    ok, _ = rel.require_inputs(grid, have, ["src_lang", "asr_model", "grp", "Condition_Code"])
    return ok.select("src_lang", "tgt_lang", "asr_model", "grp", "Condition_Code", "mt_model")


# ----------------------------------------------------------------- E: evaluation

def asr_results(spark, d):
    from tulkki.plans.evaluate import evaluate_asr
    return evaluate_asr(spark, corpus.asr_outputs(spark, _t(spark, d, "documents")))


@register("e1_a2_a3_quality_report")
def flagship(spark, d):
    """A2/A3 over E1: mean WER, mean WIL, high-WER share by language, model, condition."""
    res = asr_results(spark, d)
    rep = rel.quality_report(res, ["Language", "Model", "Condition_Code"],
                             accepted=F.col("reject_reason").isNull())
    return rep.select("Language", "Model", "Condition_Code", _r6(F.col("mean_wer")).alias("mean_wer"),
                      _r6(F.col("mean_wil")).alias("mean_wil"),
                      _r6(F.col("high_wer_share")).alias("high_wer_share"),
                      F.col("n_files").cast("bigint").alias("n_files"))


# ----------------------------------------------------------------- A, W, O, U, S

@register("a1_join_lines", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def a1_join_lines(spark, d):
    c = _t(spark, d, "conversations")
    return rel.join_lines(c, ["conv_id"], pos="turn", text="text", out="text")


@register("a1_join_stretches", """
WITH c AS (SELECT conv_id, turn, text, sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) - 1 AS place FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, CAST(place // 200 AS BIGINT) AS stretch, string_agg(text, ' ' ORDER BY turn) AS text FROM c GROUP BY ALL""")
def a1_join_stretches(spark, d):
    """A1 in stretches of bounded length, two turns a block."""
    return rel.join_stretches(_t(spark, d, "conversations"), ["conv_id"], "turn", "text", stretch=200, block=2)


@register("s12_reference_stretches", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents),
n AS (SELECT doc_id, i, {q.normalize('ls[i]')} AS t FROM l, unnest(range(1, len(ls) + 1)) u(i)),
c AS (SELECT *, sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(t) - 1 AS place FROM n WHERE t <> '')
SELECT doc_id, CAST(place // 1000 AS BIGINT) AS stretch, string_agg(t, ' ' ORDER BY i) AS text FROM c GROUP BY ALL""")
def s12_reference_stretches(spark, d):
    """S12 of every document in stretches of a thousand characters."""
    from tulkki.plans.evaluate import prepare_reference_stretches
    docs = _t(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(tx.split_lines("text")).alias("pos", "text"))
    return prepare_reference_stretches(lines, ["doc_id"], stretch=1000)


@register("a8_first_metadata", """
SELECT user_id, first(event_type ORDER BY ts, event_id) AS event_type, first(value ORDER BY ts, event_id) AS value
FROM events GROUP BY user_id""")
def a8_first_metadata(spark, d):
    e = _t(spark, d, "events").withColumn("ord", F.struct("ts", "event_id"))
    return rel.first_metadata(e, ["user_id"], "ord", ["event_type", "value"])


@register("a9_run_counts", f"""
WITH {q.corpus_ctes()}
SELECT lang, asr_model, count(*) AS n, count_if(len(pred_lines) = 0) AS n_empty FROM outs GROUP BY lang, asr_model""")
def a9_run_counts(spark, d):
    out = corpus.asr_outputs(spark, _t(spark, d, "documents")).withColumn("empty", F.size("pred_lines") == 0)
    return rel.run_counts(out, ["lang", "asr_model"], "empty")


@register("w1_latest", """
SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def w1_latest(spark, d):
    e = _t(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    e = e.withColumn("ord", F.struct("ts", "event_id"))
    return rel.latest(e, ["user_id", "event_type"], "ord").select("user_id", "event_type", "event_id", "value")


@register("w2_batch_no", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, CAST((i - 1) // 8 AS BIGINT) AS batch_no
FROM l, unnest(range(1, len(ls) + 1)) u(i)""")
def w2_batch_no(spark, d):
    lines = s1_read_lines(spark, d)
    return rel.batch_no(lines, ["doc_id"], "pos", 8).select("doc_id", "pos", "batch_no")


@register("o1_sort_inputs", "SELECT page_id, url FROM pages ORDER BY url")
def o1_sort_inputs(spark, d):
    return rel.sort_inputs(_t(spark, d, "pages").select("page_id", "url"), "url")


@register("o2_head_n", """
WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT u.conv_id, u.turn, CAST(u.pos AS BIGINT) AS pos FROM u JOIN a ON u.conv_id = a.conv_id WHERE u.pos < a.n""")
def o2_head_n(spark, d):
    c = _t(spark, d, "conversations")
    u = rel.dense_pos(c.filter(F.col("role") == "user"), ["conv_id"], "turn").select("conv_id", "turn", "pos")
    a = c.filter(F.col("role") == "assistant").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return rel.head_n(u.join(a, "conv_id"), "pos", F.col("n")).select("conv_id", "turn", "pos")


@register("u1_p7_p8_compile_results", f"""
WITH {q.corpus_ctes()},
asr AS (SELECT 'ASR' AS Task, asr_model AS Model, lang AS Language, 'c' || cond_no AS Condition_Code,
               lang AS Source_Lang, pred_path AS Pred_File_Path FROM outs),
langs AS (SELECT DISTINCT lang FROM documents),
pairs AS (SELECT a.lang AS src_lang, b.lang AS tgt_lang FROM langs a, langs b WHERE a.lang <> b.lang),
mt AS (SELECT 'MT' AS Task, m.mt_model AS Model, p.tgt_lang AS Language, p.src_lang AS Source_Lang,
              p.tgt_lang AS Target_Lang, 'Human Source' AS ASR_WER_Status
       FROM pairs p JOIN {q.MT_MODELS} m ON (contains(m.mt_model, p.src_lang || '_' || p.tgt_lang) OR starts_with(m.mt_model, 'nllb')))
SELECT * FROM asr UNION ALL BY NAME SELECT * FROM mt""")
def u1_p7_p8_compile_results(spark, d):
    docs = _t(spark, d, "documents")
    out = corpus.asr_outputs(spark, docs)
    asr = rel.with_task(out.select(F.col("asr_model").alias("Model"), F.col("lang").alias("Language"),
                                   F.concat(F.lit("c"), F.col("cond_no").cast("string")).alias("Condition_Code"),
                                   F.col("lang").alias("Source_Lang"), F.col("pred_path").alias("Pred_File_Path")), "ASR")
    pairs = rel.language_pairs(docs.select("lang").distinct())
    mt = rel.with_task(rel.applicable_mt(pairs, F.broadcast(dims.mt_models(spark)))
                       .select(F.col("mt_model").alias("Model"), F.col("tgt_lang").alias("Language"),
                               F.col("src_lang").alias("Source_Lang"), F.col("tgt_lang").alias("Target_Lang"),
                               F.lit(dims.HUMAN_SOURCE).alias("ASR_WER_Status")), "MT")
    return rel.compile_results(asr, mt)


@register("u2_union_files", rf"""
WITH {q.corpus_ctes()},
f AS (SELECT doc_id, asr_model, CASE WHEN doc_id % 3 = 0 THEN replace(regexp_extract(pred_path, '[^/]*$'), '-', '_')
    ELSE regexp_extract(pred_path, '[^/]*$') END AS fname FROM outs)
SELECT doc_id, asr_model, fname FROM f WHERE regexp_matches(fname, '^[a-z]{{2}}-')
UNION ALL
SELECT doc_id, asr_model, fname FROM f WHERE regexp_matches(fname, '^[a-z]{{2}}_')""")
def u2_union_files(spark, d):
    """Names in either spelling; every third recording has its name with ``_``."""
    name = tx.file_name("pred_path")
    out = corpus.asr_outputs(spark, _t(spark, d, "documents")).select(
        "doc_id", "asr_model", F.when(F.col("doc_id") % 3 == 0, F.replace(name, F.lit("-"), F.lit("_"))).otherwise(name).alias("fname"))
    return rel.union_files(out.filter(F.col("fname").rlike("^[a-z]{2}-")),
                           out.filter(F.col("fname").rlike("^[a-z]{2}_")))


@register("f7_f8_f12_f15_model_names", f"""
WITH {q.corpus_ctes()},
ids AS (SELECT unnest([{', '.join(repr(x) for x in [*dims.WAV2VEC2_MODELS.values(), *dims.OPUS_MODELS.values(), 'facebook/nllb-200-distilled-600M', 'nvidia/parakeet-tdt-0.6b-v3'])}]) AS model_id),
x AS (SELECT doc_id, asr_model, regexp_extract(pred_path, '[^/]*$') AS fname FROM outs)
SELECT doc_id, asr_model, model_id, translate(model_id, '/-.', '___') AS safe, regexp_extract(model_id, '[^/]*$') AS short, split_part(asr_model, '_', 1) AS family,
  CASE WHEN lower(substr(fname, 1, 2)) IN ('fi', 'en', 'fr') THEN lower(substr(fname, 1, 2)) END AS lang_from_name
FROM x, ids""")
def f7_f8_f12_f15_model_names(spark, d):
    """F7, F8 on the model ids, F12 on transcript names, F15 on model names: every transcript x model id."""
    ids = [*dims.WAV2VEC2_MODELS.values(), *dims.OPUS_MODELS.values(), "facebook/nllb-200-distilled-600M", "nvidia/parakeet-tdt-0.6b-v3"]
    x = corpus.asr_outputs(spark, _t(spark, d, "documents")).select("doc_id", "asr_model", tx.lang_from_name("pred_path").alias("lang_from_name"),
                                                                     tx.model_family("asr_model").alias("family"),
                                                                     F.explode(F.array(*[F.lit(i) for i in ids])).alias("model_id"))
    return x.select("doc_id", "asr_model", "model_id", tx.safe_name("model_id").alias("safe"), tx.short_name("model_id").alias("short"), "family", "lang_from_name")


@register("f13_f14_result_names", f"""
WITH {q.corpus_ctes()},
n AS (SELECT doc_id, asr_model, asr_folder, recording, lang, (['en', 'fr', 'de', 'es'])[doc_id % 4 + 1] AS tgt FROM outs)
SELECT doc_id, asr_model, recording || '_' || asr_model || '_transcription.txt' AS transcript,
  recording || '_nllb_' || lang || '2' || tgt || '_results.txt' AS prediction, 'asr_eval_' || lang || '_' || asr_folder || '.json' AS asr_eval,
  'mt_evaluation_nllb_' || lang || '2' || tgt || '.json' AS mt_eval,
  CASE WHEN doc_id % 5 = 0 THEN 'Human Source' WHEN doc_id % 5 = 1 THEN 'N/A (ASR Task)' ELSE 'ASR Source (' || lang || '_' || asr_folder || ')' END AS status
FROM n""")
def f13_f14_result_names(spark, d):
    """all four kinds of names; F14: source status of human, ASR and MT rows."""
    o = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    tgt = F.element_at(F.array(*[F.lit(x) for x in corpus.CORPUS_LANGS]), (F.col("doc_id") % 4 + 1).cast("int"))
    o = o.withColumn("tgt", tgt).withColumn("asr_eval", tx.result_name("asr_eval", lang="lang", model="asr_folder"))
    path = F.when(F.col("doc_id") % 10 == 0, F.lit("Human Source")).when(F.col("doc_id") % 5 != 0, F.concat(F.lit("data/results/evaluation/asr/"), "asr_eval"))
    task = F.when(F.col("doc_id") % 5 == 1, F.lit("ASR")).otherwise(F.lit("MT"))
    return o.select("doc_id", "asr_model", tx.result_name("asr_transcript", base="recording", model="asr_model").alias("transcript"),
                    tx.result_name("mt_prediction", base="recording", model=F.lit("nllb"), src="lang", tgt="tgt").alias("prediction"), "asr_eval",
                    tx.result_name("mt_eval", model=F.lit("nllb"), src="lang", tgt="tgt").alias("mt_eval"), tx.source_status(path, task).alias("status"))


@register("j4_language_lookups", f"""
SELECT d.doc_id, coalesce(l.lang_full, d.lang) AS lang_full, coalesce(l.wav2vec2_model, d.lang) AS wav2vec2_model
FROM documents d LEFT JOIN {q.values([(c, dims.LANGUAGE_NAMES[c], dims.WAV2VEC2_MODELS[c]) for c in dims.LANGUAGES], ["lang", "lang_full", "wav2vec2_model"])} l ON d.lang = l.lang""")
def j4_language_lookups(spark, d):
    """Language name and wav2vec2 model, the code itself where there is none."""
    docs, langs = _t(spark, d, "documents").select("doc_id", "lang"), dims.languages(spark)
    named = rel.with_code(docs, langs, "lang", "lang", "lang_full", "lang_full")
    return rel.with_code(named, langs, "lang", "lang", "wav2vec2_model", "wav2vec2_model").select("doc_id", "lang_full", "wav2vec2_model")


@register("b4_translate_job", f"""
WITH f AS (SELECT CASE WHEN doc_id % 7 = 0 THEN 'x' || CAST(doc_id AS VARCHAR) || '.txt' ELSE lang || '-' || CAST(doc_id AS VARCHAR) || '.part.txt' END AS file_name,
    lang, doc_id % 7 = 0 AS unknown, {q.split_lines('text')} AS ls FROM documents),
l AS (SELECT file_name, lang, unknown, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS line FROM f, unnest(range(1, len(ls) + 1)) u(i)),
x AS (SELECT l.file_name, l.lang, l.pos, l.line, t.tgt, m.mt_model, m.mt_folder
      FROM l, (SELECT DISTINCT lang AS tgt FROM documents) t, {q.MT_MODELS} m
      WHERE NOT unknown AND lang <> tgt AND (contains(m.mt_model, lang || '_' || tgt) OR starts_with(m.mt_model, 'nllb')))
SELECT 'data/results/mt/' || mt_folder || '/' || replace(regexp_replace(file_name, '\\.[^.]*$', ''), '-', '_') || '_' || split_part(mt_model, '_', 1) || '_' || lang || '2' || tgt || '_results.txt' AS path,
  pos, split_part(mt_model, '_', 1) || ': ' || array_to_string(list_reverse(string_split(line, ' ')), ' ') AS text, NULL AS reject_reason FROM x
UNION ALL
SELECT file_name, pos, line, 'unknown_language' FROM l WHERE unknown""")
def b4_translate_job(spark, d):
    """B4 on all documents as files; the names of some tell no language."""
    from tulkki.plans.jobs import translate_job
    doc = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), doc, F.lit(".txt"))).otherwise(F.concat("lang", F.lit("-"), doc, F.lit(".part.txt")))
    docs = _t(spark, d, "documents")
    lines = docs.select(name.alias("file_name"), F.posexplode(tx.split_lines("text")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    good, bad = translate_job(lines, tagged_reverse_model, corpus.languages(docs))
    return (good.select("path", "pos", "text", F.lit(None).cast("string").alias("reject_reason"))
            .unionByName(bad.select(F.col("file_name").alias("path"), "pos", "text", "reject_reason")))


@register("s10_skip_done", f"""
WITH {q.corpus_ctes()},
done AS (SELECT DISTINCT doc_id, 'whisper_large_v2' AS asr_model FROM labels)
SELECT doc_id, asr_model FROM outs ANTI JOIN done USING (doc_id, asr_model)""")
def s10_skip_done(spark, d):
    """Transcripts still to do; labelled documents already have a whisper transcript."""
    todo = corpus.asr_outputs(spark, _t(spark, d, "documents")).select("doc_id", "asr_model")
    done = _t(spark, d, "labels").select("doc_id", F.lit("whisper_large_v2").alias("asr_model"))
    return rel.skip_done(todo, done, ["doc_id", "asr_model"])


@register("s11_require_inputs", """
SELECT doc_id, lang, NULL AS reject_reason FROM documents SEMI JOIN labels USING (doc_id)
UNION ALL
SELECT doc_id, lang, 'missing_input' AS reject_reason FROM documents ANTI JOIN labels USING (doc_id)""")
def s11_require_inputs(spark, d):
    """Documents whose label input exists; the others become reject rows."""
    todo = _t(spark, d, "documents").select("doc_id", "lang")
    ok, rej = rel.require_inputs(todo, _t(spark, d, "labels"), ["doc_id"])
    return ok.withColumn("reject_reason", F.lit(None).cast("string")).unionByName(rej)


@register("s12_prepare_references", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents),
n AS (SELECT doc_id, {q.normalize("array_to_string(list_transform(ls, lambda x: " + q.normalize('x') + "), ' ')")} AS ref_text FROM l)
SELECT doc_id, ref_text, CAST(ref_text <> '' AS INTEGER) AS n_ref_lines FROM n""")
def s12_prepare_references(spark, d):
    from tulkki.plans.evaluate import prepare_references
    docs = _t(spark, d, "documents").withColumn("ref_lines", tx.split_lines("text"))
    return prepare_references(docs, ["doc_id"]).select("doc_id", "ref_text", "n_ref_lines")


@register("j8_with_reference", f"""
WITH {q.corpus_ctes()},
h AS (SELECT doc_id, asr_model, CAST(i - 1 AS BIGINT) AS pos, pred_lines[i] AS hyp FROM outs, unnest(range(1, len(pred_lines) + 1)) u(i)),
r AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS ref FROM (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents), unnest(range(1, len(ls) + 1)) u(i))
SELECT h.doc_id, h.asr_model, h.pos, h.hyp, r.ref FROM h LEFT JOIN r ON h.doc_id = r.doc_id AND h.pos = r.pos""")
def j8_with_reference(spark, d):
    """Transcript lines (blanks dropped, positions re-densified) with the reference line at the same position."""
    out = corpus.asr_outputs(spark, _t(spark, d, "documents"))
    hyp = out.select("doc_id", "asr_model", F.posexplode("pred_lines").alias("pos", "hyp")) \
             .withColumn("pos", F.col("pos").cast("bigint"))
    refs = s1_read_lines(spark, d).withColumnRenamed("line", "ref")
    return rel.with_reference(hyp, refs, ["doc_id", "pos"]).select("doc_id", "asr_model", "pos", "hyp", "ref")


# ----------------------------------------------------------------- M4, B: metrics and model map

def _line_pairs_sql() -> str:
    hyp = q.strip(q.corrupt_line("ref_lines[p]", "doc_id", "p-1", "model_no", "cond_no"))
    return f"""{q.corpus_ctes()},
lp AS (SELECT doc_id, asr_model, lang, cond_no, CAST(p - 1 AS BIGINT) AS pos, ref_lines[p] AS ref, {hyp} AS hyp
       FROM outs, unnest(range(1, len(ref_lines) + 1)) u(p)),
pw AS (SELECT doc_id, asr_model, lang, cond_no, pos, ref, hyp,
              {q.words(q.normalize('ref'))} AS r, {q.words(q.normalize('hyp'))} AS h FROM lp)"""


def line_pair_words(spark, d):
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    return lp.withColumn("pos", F.col("pos").cast("bigint")) \
             .withColumn("ref_words", tx.words(tx.normalize("ref"))) \
             .withColumn("hyp_words", tx.words(tx.normalize("hyp")))


_METEOR_SQL = f"""
WITH {_line_pairs_sql()},
hw AS (SELECT doc_id, asr_model, pos, word, hp, row_number() OVER (PARTITION BY doc_id, asr_model, pos, word ORDER BY hp DESC) AS k
       FROM (SELECT doc_id, asr_model, pos, unnest(h) AS word, unnest(range(len(h))) AS hp FROM pw)),
rw AS (SELECT doc_id, asr_model, pos, word, rp, row_number() OVER (PARTITION BY doc_id, asr_model, pos, word ORDER BY rp DESC) AS k
       FROM (SELECT doc_id, asr_model, pos, unnest(r) AS word, unnest(range(len(r))) AS rp FROM pw)),
m AS (SELECT hw.doc_id, hw.asr_model, hw.pos, hw.hp, rw.rp FROM hw JOIN rw USING (doc_id, asr_model, pos, word, k)),
c AS (SELECT m.doc_id, m.asr_model, m.pos, count(*) AS mm, count(*) - count(n.hp) AS ch
      FROM m LEFT JOIN m n ON m.doc_id = n.doc_id AND m.asr_model = n.asr_model AND m.pos = n.pos AND n.hp = m.hp + 1 AND n.rp = m.rp + 1
      GROUP BY ALL),
s AS (SELECT pw.doc_id, pw.asr_model, pw.lang, pw.pos,
        CASE WHEN coalesce(c.mm, 0) = 0 THEN 0.0 ELSE
          ((c.mm::DOUBLE / len(h)) * (c.mm::DOUBLE / len(r)) / (0.9 * (c.mm::DOUBLE / len(h)) + 0.1 * (c.mm::DOUBLE / len(r))))
          * (1 - 0.5 * power(c.ch::DOUBLE / c.mm, 3)) END AS meteor
      FROM pw LEFT JOIN c USING (doc_id, asr_model, pos))"""


def _meteor(spark, d):
    from tulkki.operators.scoring import meteor_score, pair_scores
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    sc = lp.select("doc_id", "lang", "asr_model", F.col("pos").cast("bigint").alias("pos"),
                   pair_scores(tx.normalize("ref"), tx.normalize("hyp"), words=False, ter=False).alias("s"))
    return sc.withColumn("meteor", meteor_score("s"))


@register("m4_meteor_exact", _METEOR_SQL + "\nSELECT doc_id, asr_model, pos, round(meteor, 6) AS meteor FROM s")
def m4_meteor_exact(spark, d):
    return _meteor(spark, d).select("doc_id", "asr_model", "pos", _r6(F.col("meteor")).alias("meteor"))


def _stages_sql(stems: bool) -> str:
    """METEOR by stages: equal words, equal words without a final q (``stems``), synonyms by ordered greedy matching."""
    def ranked(side: str, at: str, key: str) -> str:
        return f"(SELECT pair, {key} AS key, {at}, row_number() OVER (PARTITION BY pair, {key} ORDER BY {at} DESC) AS k FROM {side})"
    left = lambda n: (f"hw{n + 1} AS (SELECT * FROM hw{n} ANTI JOIN m{n} USING (pair, hp)),\n"  # noqa: E731
                      f"rw{n + 1} AS (SELECT * FROM rw{n} ANTI JOIN m{n} USING (pair, rp)),")
    join = "SELECT pair, hp, rp FROM {0} a JOIN {1} b USING (pair, key, k)"
    second = join.format(ranked("hw1", "hp", "rtrim(word, 'q')"), ranked("rw1", "rp", "rtrim(word, 'q')")) if stems else "SELECT * FROM m0 LIMIT 0"
    return f"""
WITH {_line_pairs_sql()},
x AS (SELECT row_number() OVER () AS pair, * FROM pw),
hw0 AS (SELECT pair, unnest(h) AS word, unnest(range(len(h))) AS hp FROM x),
rw0 AS (SELECT pair, unnest(r) AS word, unnest(range(len(r))) AS rp FROM x),
m0 AS ({join.format(ranked("hw0", "hp", "word"), ranked("rw0", "rp", "word"))}),
{left(0)}
m1 AS ({second}),
{left(1)}
voc AS (SELECT DISTINCT unnest({q.words(q.normalize('text'))}) AS word FROM documents),
syn AS (SELECT word || 'q' AS word, word AS synonym FROM voc
        UNION SELECT word, min(word) OVER (PARTITION BY substr(word, 1, 2)) FROM voc),
cand AS (SELECT hw2.pair, list({{'hp': hp, 'rp': rp}} ORDER BY hp DESC, rp DESC) AS c
         FROM hw2 JOIN syn ON hw2.word = syn.word AND syn.word <> syn.synonym JOIN rw2 ON rw2.pair = hw2.pair AND rw2.word = syn.synonym GROUP BY hw2.pair),
m2 AS (SELECT pair, unnest(list_reduce(c, lambda a, y: CASE WHEN len(list_filter(a, lambda z: z.hp = y.hp OR z.rp = y.rp)) > 0 THEN a ELSE list_append(a, y) END,
         []::STRUCT(hp BIGINT, rp BIGINT)[])) AS p FROM cand),
m AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT pair, p.hp, p.rp FROM m2),
c AS (SELECT m.pair, count(*) AS mm, count(*) - count(n.hp) AS ch FROM m LEFT JOIN m n ON m.pair = n.pair AND n.hp = m.hp + 1 AND n.rp = m.rp + 1 GROUP BY m.pair)
SELECT doc_id, asr_model, pos, coalesce(mm, 0) AS matches, coalesce(ch, 0) AS chunks, len(r) AS ref_len, len(h) AS hyp_len
FROM x LEFT JOIN c USING (pair)"""


def misspelling_stemmer(word):
    """Stand-in for a stemmer that SQL has too: without the final q's that misspelt words get."""
    return word.rstrip("q")


def synonym_table(spark, d):
    """(word, synonym) from the words of all documents: a misspelt word stands for the right one, and a word for the first with its two first letters."""
    voc = _t(spark, d, "documents").select(F.explode(tx.words(tx.normalize("text"))).alias("word")).distinct()
    first = voc.groupBy(F.substring("word", 1, 2).alias("start")).agg(F.min("word").alias("synonym"))
    return (voc.select(F.concat("word", F.lit("q")).alias("word"), F.col("word").alias("synonym"))
            .unionByName(voc.join(first, F.substring("word", 1, 2) == F.col("start")).select("word", "synonym")))


def _meteor_stages(spark, d, **how):
    from tulkki.operators.lexicon import meteor_pairs
    from tulkki.operators.scoring import meteor_score
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    lp = lp.select("doc_id", "asr_model", F.col("pos").cast("bigint").alias("pos"), tx.normalize("ref").alias("ref"), tx.normalize("hyp").alias("hyp"))
    scored = meteor_pairs(lp, synonyms=synonym_table(spark, d), **how)
    counts = ["doc_id", "asr_model", "pos", *[f"scores.{c}" for c in ("matches", "chunks", "ref_len", "hyp_len")]]
    return scored.select(*counts, _r6(meteor_score("scores")).alias("meteor"))


@register("m4_meteor_synonyms", _stages_sql(False))
def m4_meteor_synonyms(spark, d):
    """M4 on every line pair: equal words, then synonyms of a table.  The counts, which are whole numbers; m4_meteor_exact has the score."""
    return _meteor_stages(spark, d, stemmer=None).drop("meteor")


@register("m4_meteor_stages", _stages_sql(True))
def m4_meteor_stages(spark, d):
    """M4 on every line pair, all three stages; the stemmer is one that SQL has too."""
    return _meteor_stages(spark, d, stemmer=misspelling_stemmer).drop("meteor")


@register("m4_meteor_porter")
def m4_meteor_porter(spark, d):
    """M4 on every line pair with Porter stems and synonyms, as METEOR is published."""
    return _meteor_stages(spark, d)


@register("a6_corpus_meteor", _METEOR_SQL + "\nSELECT lang, asr_model, round(avg(meteor), 6) AS meteor, count(*) AS n FROM s GROUP BY lang, asr_model")
def a6_corpus_meteor(spark, d):
    return (_meteor(spark, d).groupBy("lang", "asr_model").agg(F.avg("meteor").alias("meteor"), F.count(F.lit(1)).alias("n"))
            .select("lang", "asr_model", _r6(F.col("meteor")).alias("meteor"), "n"))


def reverse_words_model(name):
    """Deterministic stand-in for a translation model: reverse the word order."""
    def predict(texts):
        return [" ".join(reversed(t.split(" "))) if t is not None else None for t in texts]
    return predict


def tagged_reverse_model(name):
    """Deterministic stand-in routed by model: family tag + reversed words."""
    fam = name.split("_")[0]

    def predict(texts):
        return [fam + ": " + " ".join(reversed(t.split(" "))) for t in texts]
    return predict


@register("b1_batch_map", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, array_to_string(list_reverse(string_split(ls[i], ' ')), ' ') AS prediction,
       NULL AS prediction_error
FROM l, unnest(range(1, len(ls) + 1)) u(i)""")
def b1_batch_map(spark, d):
    from tulkki.operators.infer import batch_map
    lines = s1_read_lines(spark, d)
    return batch_map(lines, reverse_words_model, ["line"], "prediction", batch_size=8) \
        .select("doc_id", "pos", "prediction", "prediction_error")


@register("b1_length_buckets", f"""
WITH l AS (SELECT doc_id, {q.split_lines('text')} AS ls FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS pos, array_to_string(list_reverse(string_split(ls[i], ' ')), ' ') AS prediction,
       NULL AS prediction_error
FROM l, unnest(range(1, len(ls) + 1)) u(i)""")
def b1_length_buckets(spark, d):
    """B1 with calls of lines of like length: the same rows as b1_batch_map."""
    from tulkki.operators.infer import batch_map
    lines = s1_read_lines(spark, d)
    return batch_map(lines, reverse_words_model, ["line"], "prediction", batch_size=8, length=F.size(F.split("line", " "))) \
        .select("doc_id", "pos", "prediction", "prediction_error")


@register("b2_route_and_map", f"""
WITH langs AS (SELECT DISTINCT lang FROM documents),
s AS (SELECT doc_id, lang, {q.split_lines('text')} AS ls FROM documents),
x AS (SELECT doc_id, lang, CAST(i - 1 AS BIGINT) AS pos, ls[i] AS line FROM s, unnest(range(1, len(ls) + 1)) u(i)),
f AS (SELECT x.*, l.lang AS tgt_lang FROM x JOIN langs l ON x.lang <> l.lang)
SELECT f.doc_id, f.pos, f.tgt_lang, m.mt_model,
       split_part(m.mt_model, '_', 1) || ': ' || array_to_string(list_reverse(string_split(f.line, ' ')), ' ') AS prediction
FROM f JOIN {q.MT_MODELS} m ON (contains(m.mt_model, f.lang || '_' || f.tgt_lang) OR starts_with(m.mt_model, 'nllb'))""")
def b2_route_and_map(spark, d):
    from tulkki.operators.infer import batch_map
    docs = _t(spark, d, "documents")
    lines = s1_read_lines(spark, d).join(docs.select("doc_id", "lang"), "doc_id")
    fan = rel.fan_out(lines, corpus.languages(docs))
    routed = rel.applicable_mt(fan, F.broadcast(dims.mt_models(spark).select("mt_model")), "lang", "tgt_lang")
    return batch_map(routed, tagged_reverse_model, ["line"], "prediction", batch_size=4, model_col="mt_model") \
        .select("doc_id", "pos", "tgt_lang", "mt_model", "prediction")


@register("b5_overlap_chunks", f"""
WITH w AS (SELECT doc_id, {q.words('text')} AS ws FROM documents),
s AS (SELECT doc_id, ws, list_filter(range(0, len(ws), 24), lambda s: s = 0 OR s - 24 + 30 < len(ws)) AS starts FROM w)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_no, CAST(starts[k] AS BIGINT) AS start,
       CAST(least(30, len(ws) - starts[k]) AS BIGINT) AS n_items,
       CAST(CASE WHEN starts[k] = 0 THEN 0 ELSE 4 END AS BIGINT) AS stride_left,
       CAST(CASE WHEN starts[k] + 30 >= len(ws) THEN 0 ELSE 2 END AS BIGINT) AS stride_right,
       array_to_string(ws[starts[k] + 1: starts[k] + 30], ' ') AS text
FROM s, unnest(range(1, len(starts) + 1)) u(k)""")
def b5_overlap_chunks(spark, d):
    from tulkki.operators.infer import chunk_items, overlap_chunks
    docs = _t(spark, d, "documents")
    ws = materialize(docs.select("doc_id", "text"), ws=tx.words("text")).drop("text")
    ch = ws.select("doc_id", "ws", F.explode(overlap_chunks("ws", 30, 4, 2)).alias("c"))
    return ch.select("doc_id", "c.chunk_no", "c.start", "c.n_items", "c.stride_left", "c.stride_right",
                     F.array_join(chunk_items("ws", "c.start", 30), " ").alias("text"))


def echo_model(name):
    """Stand-in for a chunked transcription model that hears every word right."""
    return lambda texts: list(texts)


def edge_mishearing_model(name):
    """Stand-in for a chunked model that mishears the first and the last word of whatever it gets."""
    def predict(texts):
        out = []
        for t in texts:
            words = t.split(" ")
            words[0] = "~" + words[0]
            words[-1] += "~"
            out.append(" ".join(words))
        return out
    return predict


def _stitched(spark, d, model, **how):
    from tulkki.operators.infer import batch_map
    from tulkki.operators.stitch import stitch_chunks, stitched_text
    heard = batch_map(b5_overlap_chunks(spark, d), model, ["text"], "heard", batch_size=16)
    words = heard.select("doc_id", "chunk_no", F.split("heard", " ").alias("words"))
    return stitched_text(stitch_chunks(words, ["doc_id"], 6, **how), ["doc_id"])


@register("b5_stitch", f"""
WITH w AS (SELECT doc_id, {q.words('text')} AS ws FROM documents)
SELECT doc_id, array_to_string(ws, ' ') AS text FROM w WHERE len(ws) > 0""")
def b5_stitch(spark, d):
    """Chunk every document, run the model on the chunks and stitch its outputs: the text comes back."""
    return _stitched(spark, d, echo_model)


@register("b5_stitch_misheard_edges", f"""
WITH w AS (SELECT doc_id, {q.words('text')} AS ws FROM documents)
SELECT doc_id, '~' || array_to_string(ws, ' ') || '~' AS text FROM w WHERE len(ws) > 0""")
def b5_stitch_misheard_edges(spark, d):
    """B5 with a model that errs at the edges of chunks: only the edges of the whole text keep the error."""
    return _stitched(spark, d, edge_mishearing_model, least_share=0.6)


def overlap_scorer(name):
    """Deterministic stand-in for a learned segment scorer: word-set overlap of hypothesis and reference."""
    def score(rows):
        out = []
        for src, hyp, ref in rows:
            h, r = set(hyp.split()), set(ref.split())
            u = h | r
            out.append(round(len(h & r) / len(u), 6) if u else None)
        return out
    return score


@register("m6_a7_score_segments", f"""
WITH {_line_pairs_sql()},
sc AS (SELECT lang, asr_model,
         CASE WHEN len(list_distinct(list_concat(h, r))) = 0 THEN NULL
              ELSE round(len(list_intersect(list_distinct(h), list_distinct(r)))::DOUBLE / len(list_distinct(list_concat(h, r))), 6) END AS score
       FROM pw)
SELECT lang, asr_model, round(avg(score), 6) AS comet, count(score) AS n_scored FROM sc GROUP BY lang, asr_model""")
def m6_a7_score_segments(spark, d):
    """M6 through B1 with three inputs (source, hypothesis, reference); A7 mean, failures skipped."""
    from tulkki.operators.infer import batch_map
    pw = line_pair_words(spark, d).select(
        "lang", "asr_model", F.array_join("ref_words", " ").alias("src"),
        F.array_join("hyp_words", " ").alias("hyp"), F.array_join("ref_words", " ").alias("ref"))
    sc = batch_map(pw, overlap_scorer, ["src", "hyp", "ref"], "score", batch_size=64, out_type=T.DoubleType())
    return sc.groupBy("lang", "asr_model").agg(_r6(F.avg("score")).alias("comet"),
                                               F.count("score").alias("n_scored"))


# ----------------------------------------------------------------- M1, M5, M7, A4, A5, E2-E4 (no SQL oracle:
# the word-level dynamic programmes are far too slow as DuckDB recursive SQL on whole texts;
# tests check them against brute force instead)

@register("m1_align_lines")
def m1_align_lines(spark, d):
    """M1-M3 per line pair (every line of every document x ASR model)."""
    from tulkki.operators.align import align_texts
    from tulkki.operators.metrics import wer, wil
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    a = lp.select("doc_id", "asr_model", F.col("pos").cast("bigint").alias("pos"),
                  align_texts(tx.normalize("ref"), tx.normalize("hyp")).alias("al"))
    return a.select("doc_id", "asr_model", "pos", "al.hits", "al.subs", "al.dels", "al.ins",
                    _r6(wer("al")).alias("wer"), _r6(wil("al")).alias("wil"))


@register("m7_word_distance")
def m7_word_distance(spark, d):
    """M7: word edit distance per line pair, read off the alignment counts."""
    from tulkki.operators.align import align_texts, word_distance
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    w = lp.select("doc_id", "asr_model", F.col("pos").cast("bigint").alias("pos"), align_texts(tx.normalize("ref"), tx.normalize("hyp")).alias("al"))
    return w.select("doc_id", "asr_model", "pos", word_distance("al").alias("distance"))


@register("a4_corpus_wer")
def a4_corpus_wer(spark, d):
    """A4: micro WER/WIL by language and model over all line pairs."""
    from tulkki.operators.align import align_texts
    lp = corpus.line_pairs(spark, _t(spark, d, "documents"))
    a = lp.select("lang", "asr_model", align_texts(tx.normalize("ref"), tx.normalize("hyp")).alias("al"))
    r = rel.corpus_wer(a, ["lang", "asr_model"], "al")
    return r.select("lang", "asr_model", _r6(F.col("corpus_wer")).alias("corpus_wer"),
                    _r6(F.col("corpus_wil")).alias("corpus_wil"), "hits", "subs", "dels", "ins")


@register("m5_a5_ter")
def m5_a5_ter(spark, d):
    """M5 per sentence segment, A5 corpus TER by language pair and MT model."""
    from tulkki.operators.ter import ter_edits
    seg = corpus.mt_segments(spark, _t(spark, d, "documents"))
    t = seg.select("src_lang", "tgt_lang", "mt_model",
                   ter_edits(tx.normalize("hyp"), tx.normalize("ref")).alias("t"))
    t = t.select("src_lang", "tgt_lang", "mt_model", F.col("t.edits").alias("ter_edits"),
                 F.col("t.ref_len").alias("ter_ref_len"))
    return rel.corpus_ter(t, ["src_lang", "tgt_lang", "mt_model"]).select(
        "src_lang", "tgt_lang", "mt_model", _r6(F.col("corpus_ter")).alias("corpus_ter"))


def mt_results(spark, d, **how):
    from tulkki.plans.evaluate import evaluate_mt
    seg = corpus.mt_segments(spark, _t(spark, d, "documents"))
    return evaluate_mt(seg, overlap_scorer, **how)


@register("e2_mt_human_source")
def e2_mt_human_source(spark, d):
    """The MT record of each translated document, human source, with all its fields."""
    r = mt_results(spark, d).drop("src_lang", "tgt_lang", "mt_model", "asr_model")
    return r.withColumns({c: _r6(F.col(c)) for c in ("METEOR", "TER", "COMET")})


_OPUS = f"({', '.join(repr(x) for x in dims.MT_MODELS)})"


def _mt_segments_sql(p: str = "") -> str:
    """CTEs, their names prefixed with ``p``: the sentences of documents as translation segments (``seg``) and their words (``pw``)."""
    return f"""
{p}s AS (SELECT doc_id, lang, cond_no, sents FROM (
  SELECT doc_id, lang, CAST(doc_id % 6 + 1 AS INTEGER) AS cond_no, {q.split_lines('t')} AS sents FROM (
    SELECT doc_id, lang, replace(regexp_replace(regexp_replace({q.strip('text')},
        '(^|[^\\pL\\pN_])({_ABBR})\\.\\s*', '\\1\\2{_PH}', 'gi'), '\\.\\s*', '.' || chr(10), 'g'), '{_PH}', '. ') AS t FROM documents))),
{p}t AS (SELECT *, list_filter(['en', 'fr', 'de', 'es'], lambda x: x <> lang) AS others FROM {p}s),
{p}u AS (SELECT doc_id, cond_no, sents, lang AS src_lang, others[doc_id % len(others) + 1] AS tgt_lang FROM {p}t),
{p}v AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND 'opus_mt_' || src_lang || '_' || tgt_lang IN {_OPUS}
             THEN 'opus_mt_' || src_lang || '_' || tgt_lang ELSE 'nllb' END AS mt_model FROM {p}u),
{p}g AS (SELECT doc_id, src_lang, tgt_lang, mt_model, cond_no, i - 1 AS pos, CASE WHEN mt_model = 'nllb' THEN 11 ELSE 12 END AS k,
        array_to_string(list_reverse(string_split(sents[i], ' ')), ' ') AS ref FROM {p}v, unnest(range(1, len(sents) + 1)) x(i)),
{p}seg AS (SELECT *, {q.strip(q.corrupt_line('ref', 'doc_id', 'pos', 'k', 'cond_no'))} AS hyp FROM {p}g),
{p}pw AS (SELECT doc_id, pos, src_lang, tgt_lang, mt_model, {q.words(q.normalize('ref'))} AS r, {q.words(q.normalize('hyp'))} AS h FROM {p}seg)"""


_MT_SEGMENTS = _mt_segments_sql()


@register("e2_meteor_comet", f"""
WITH {_MT_SEGMENTS},
hw AS (SELECT doc_id, pos, word, hp, row_number() OVER (PARTITION BY doc_id, pos, word ORDER BY hp DESC) AS k
       FROM (SELECT doc_id, pos, unnest(h) AS word, unnest(range(len(h))) AS hp FROM pw)),
rw AS (SELECT doc_id, pos, word, rp, row_number() OVER (PARTITION BY doc_id, pos, word ORDER BY rp DESC) AS k
       FROM (SELECT doc_id, pos, unnest(r) AS word, unnest(range(len(r))) AS rp FROM pw)),
m AS (SELECT hw.doc_id, hw.pos, hw.hp, rw.rp FROM hw JOIN rw USING (doc_id, pos, word, k)),
c AS (SELECT m.doc_id, m.pos, count(*) AS mm, count(*) - count(n.hp) AS ch
      FROM m LEFT JOIN m n ON m.doc_id = n.doc_id AND m.pos = n.pos AND n.hp = m.hp + 1 AND n.rp = m.rp + 1 GROUP BY ALL),
sc AS (SELECT pw.*, CASE WHEN coalesce(c.mm, 0) = 0 THEN 0.0 ELSE
          ((c.mm::DOUBLE / len(h)) * (c.mm::DOUBLE / len(r)) / (0.9 * (c.mm::DOUBLE / len(h)) + 0.1 * (c.mm::DOUBLE / len(r))))
          * (1 - 0.5 * power(c.ch::DOUBLE / c.mm, 3)) END AS meteor,
          CASE WHEN len(list_distinct(list_concat(h, r))) = 0 THEN NULL
              ELSE round(len(list_intersect(list_distinct(h), list_distinct(r)))::DOUBLE / len(list_distinct(list_concat(h, r))), 6) END AS comet
      FROM pw LEFT JOIN c USING (doc_id, pos))
SELECT doc_id, mt_model AS Model, src_lang AS Source_Lang, tgt_lang AS Target_Lang, 'Human Source' AS ASR_WER_Status,
  CAST(sum(CAST(round(meteor * 1e9) AS BIGINT)) AS DOUBLE) / count(meteor) / 1e9 AS METEOR,
  CAST(sum(CAST(round(comet * 1e9) AS BIGINT)) AS DOUBLE) / count(comet) / 1e9 AS COMET,
  'data/' || src_lang || '/' || src_lang || '_SOURCE.txt' AS Source_File, 'data/' || tgt_lang || '/' || tgt_lang || '_SOURCE.txt' AS Ref_File
FROM sc GROUP BY doc_id, mt_model, src_lang, tgt_lang""")
def e2_meteor_comet(spark, d):
    """E2 without TER, over all documents."""
    r = mt_results(spark, d, ter=False)
    # not rounded: the means come from whole sums, so that both engines have the same doubles
    return r.select("doc_id", "Model", "Source_Lang", "Target_Lang", "ASR_WER_Status", "METEOR", "COMET", "Source_File", "Ref_File")


@register("e3_j9_mt_on_asr_source")
def e3_j9_mt_on_asr_source(spark, d):
    """Translations of transcripts, flagged with the transcripts' quality, beside those of a human source."""
    from tulkki.plans.evaluate import evaluate_mt_on_asr
    lists = corpus.mt_on_asr_lists(spark, _t(spark, d, "documents"))
    r = evaluate_mt_on_asr(lists, asr_results(spark, d), overlap_scorer)
    r = r.unionByName(mt_results(spark, d)).drop("src_lang", "tgt_lang", "mt_model")
    return r.withColumns({c: _r6(F.col(c)) for c in ("WER", "WIL", "High_WER_Percentage", "METEOR", "TER", "COMET")})


@register("e4_summary")
def e4_summary(spark, d):
    """ASR and MT records unioned by name, known columns first (U1 + P7)."""
    asr = asr_results(spark, d).drop("al", "reject_reason", "doc_id")
    mt = mt_results(spark, d).drop("doc_id", "src_lang", "tgt_lang", "mt_model", "asr_model")
    return rel.compile_results(asr.drop("Ref_Text_Normalized", "Pred_Text_Normalized"), mt)


# ----------------------------------------------------------------- alignment and plain edit rate on the whole benchmark
# table, where SQL can run the dynamic programme: every item x ASR model x condition

_BENCH_PAIRS = f"""
p AS (SELECT b.item_id, m.asr_model, m.model_no, c.Condition_Code, CAST(substr(c.Condition_Code, 2) AS INTEGER) AS cond_no, {q.normalize('b.text')} AS ref
      FROM benchmark b, {q.ASR_MODELS} m, {q.CONDITIONS} c),
pairs AS (SELECT row_number() OVER () AS pair_id, item_id, asr_model, Condition_Code, {q.words('ref')} AS r,
            {q.words(q.corrupt_line('ref', 'item_id', '0', 'model_no', 'cond_no'))} AS h FROM p)"""
_BENCH_COUNTS = f"""WITH RECURSIVE {_BENCH_PAIRS},
{q.ALIGN_CTES},
counts AS (SELECT p.item_id, p.asr_model, p.Condition_Code, e.* FROM e JOIN pairs p USING (pair_id))"""


def _bench_scores(spark, d, **how):
    from tulkki.operators.scoring import pair_scores
    b = corpus.benchmark_pairs(spark, _t(spark, d, "benchmark"))
    return b.withColumn("s", pair_scores("ref", "hyp", **how))


@register("m1_m3_m7_align_benchmark", _BENCH_COUNTS + """
SELECT item_id, asr_model, Condition_Code, hits, subs, dels, ins, subs + dels + ins AS distance,
  CASE WHEN nr > 0 THEN round((subs + dels + ins)::DOUBLE / nr, 6) END AS wer,
  CASE WHEN nr > 0 THEN round(CASE WHEN nh = 0 THEN 1.0 ELSE 1 - hits::DOUBLE / nr * (hits::DOUBLE / nh) END, 6) END AS wil
FROM counts""")
def m1_m3_m7_align_benchmark(spark, d):
    """M1, M2, M3, M7 of every benchmark item x ASR model x condition."""
    from tulkki.operators.align import word_distance
    from tulkki.operators.metrics import wer, wil
    a = _bench_scores(spark, d, meteor=False, ter=False)
    return a.select("item_id", "asr_model", "Condition_Code", "s.hits", "s.subs", "s.dels", "s.ins", word_distance("s").alias("distance"),
                    _r6(wer("s")).alias("wer"), _r6(wil("s")).alias("wil"))


@register("a2_a3_report_benchmark", _BENCH_COUNTS + """,
w AS (SELECT *, CASE WHEN nr > 0 THEN (subs + dels + ins)::DOUBLE / nr END AS wer,
        CASE WHEN nr > 0 THEN CASE WHEN nh = 0 THEN 1.0 ELSE 1 - hits::DOUBLE / nr * (hits::DOUBLE / nh) END END AS wil FROM counts)
SELECT asr_model, Condition_Code, round(avg(wer), 6) AS mean_wer, round(avg(wil), 6) AS mean_wil,
  round(count(*) FILTER (WHERE wer > 0.4)::DOUBLE / count(*), 6) AS high_wer_share, count(*) AS n_files
FROM w GROUP BY ALL""")
def a2_a3_report_benchmark(spark, d):
    """A2, A3 by ASR model and condition."""
    from tulkki.operators.metrics import wer, wil
    a = _bench_scores(spark, d, meteor=False, ter=False).select("asr_model", "Condition_Code", wer("s").alias("WER"), wil("s").alias("WIL"))
    r = rel.quality_report(a, ["asr_model", "Condition_Code"])
    return r.withColumns({c: _r6(F.col(c)) for c in ("mean_wer", "mean_wil", "high_wer_share")})


@register("a4_corpus_wer_benchmark", _BENCH_COUNTS + """
SELECT asr_model, round(sum(subs + dels + ins)::DOUBLE / sum(nr), 6) AS corpus_wer,
  round(1 - sum(hits)::DOUBLE * sum(hits) / (sum(nr)::DOUBLE * sum(nh)), 6) AS corpus_wil,
  CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(subs) AS BIGINT) AS subs, CAST(sum(dels) AS BIGINT) AS dels, CAST(sum(ins) AS BIGINT) AS ins
FROM counts GROUP BY asr_model""")
def a4_corpus_wer_benchmark(spark, d):
    """A4 by ASR model."""
    r = rel.corpus_wer(_bench_scores(spark, d, meteor=False, ter=False), ["asr_model"], "s")
    return r.withColumns({c: _r6(F.col(c)) for c in ("corpus_wer", "corpus_wil")})


@register("m5_a5_edit_rate_benchmark", _BENCH_COUNTS + """
SELECT asr_model, Condition_Code, round(100.0 * sum(subs + dels + ins) / sum(nr), 6) AS corpus_ter FROM counts GROUP BY ALL""")
def m5_a5_edit_rate_benchmark(spark, d):
    """M5, A5 without shifts and beam: plain edit rate."""
    from tulkki.operators.ter import TerLimits
    a = _bench_scores(spark, d, meteor=False, words=False, limits=TerLimits(max_shifts=0, beam=None))
    a = a.select("asr_model", "Condition_Code", F.col("s.ter_edits").alias("ter_edits"), F.col("s.ref_len").alias("ter_ref_len"))
    return rel.corpus_ter(a, ["asr_model", "Condition_Code"]).withColumn("corpus_ter", _r6(F.col("corpus_ter")))


# ----------------------------------------------------------------- E1-E4, J9, P9 with all fields, on recordings of the benchmark table:
# six recordings an item, one for each condition; TER without shifts and beam, which SQL can run

_BENCH_DOCS = """documents AS (SELECT item_id * 6 + c AS doc_id, ['en', 'fr', 'de', 'es'][CAST(item_id % 4 + 1 AS INTEGER)] AS lang, text FROM benchmark, range(6) r(c))"""


def bench_documents(spark, d):
    langs = F.array(*[F.lit(x) for x in corpus.CORPUS_LANGS])
    b = _t(spark, d, "benchmark").select("item_id", "text", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c"))
    return b.select((F.col("item_id") * 6 + F.col("c")).alias("doc_id"), F.element_at(langs, (F.col("item_id") % 4 + 1).cast("int")).alias("lang"), "text")


_RECORDS = f"""
WITH RECURSIVE {_BENCH_DOCS},
{q.corpus_ctes()},
ra AS (SELECT *, {q.normalize("array_to_string(list_transform(ref_lines, lambda x: " + q.normalize('x') + "), ' ')")} AS ref_text,
         {q.normalize("array_to_string(pred_lines, ' ')")} AS pred_text, recording AS base FROM outs),
rb AS (SELECT *, 'a' || row_number() OVER () AS pair_id, CAST(ref_text <> '' AS INTEGER) AS n_ref, regexp_matches(base, '{tx.RECORDING_RE}') AS ok,
         coalesce(TRY_CAST(regexp_extract(base, '(?i)[-_]c(\\d+)', 1) AS BIGINT) - 1, -1) AS parsed FROM ra),
rc AS (SELECT *, CASE WHEN n_ref = 1 THEN 0 ELSE parsed END AS line_index,
         CASE WHEN NOT (CASE WHEN n_ref = 1 THEN 0 ELSE parsed END BETWEEN 0 AND n_ref - 1) THEN 'invalid_line_index'
              WHEN len(pred_lines) = 0 THEN 'empty_prediction' END AS reject_reason FROM rb),
{_mt_segments_sql('mt_')},
oa AS (SELECT *, list_filter(['en', 'fr', 'de', 'es'], lambda x: x <> lang) AS others FROM outs),
ob AS (SELECT *, others[doc_id % len(others) + 1] AS tgt_lang FROM oa),
oc AS (SELECT *, CASE WHEN doc_id % 2 = 0 AND 'opus_mt_' || lang || '_' || tgt_lang IN {_OPUS} THEN 'opus_mt_' || lang || '_' || tgt_lang ELSE 'nllb' END AS mt_model,
         list_transform(ref_lines, lambda x: array_to_string(list_reverse(string_split(x, ' ')), ' ')) AS refs FROM ob),
od AS (SELECT *, CASE WHEN mt_model = 'nllb' THEN 11 ELSE 12 END AS k FROM oc),
oe AS (SELECT doc_id, lang AS src_lang, tgt_lang, asr_model, mt_model, pred_path, cond_no, k, i - 1 AS pos, refs[i] AS ref
       FROM od, unnest(range(1, least(len(pred_lines), len(refs)) + 1)) u(i)),
segs AS (
  SELECT 'h' || row_number() OVER () AS pair_id, doc_id, src_lang, tgt_lang, CAST(NULL AS VARCHAR) AS asr_model, mt_model, CAST(NULL AS VARCHAR) AS source_file, r, h FROM mt_pw
  UNION ALL
  SELECT 't' || row_number() OVER (), doc_id, src_lang, tgt_lang, asr_model, mt_model, pred_path, {q.words(q.normalize('ref'))},
    {q.words(q.normalize(q.strip(q.corrupt_line('ref', 'doc_id', 'pos', 'k', 'cond_no'))))} FROM oe),
pairs AS (SELECT pair_id, r, h FROM segs UNION ALL
          SELECT pair_id, {q.words('ref_text')}, {q.words('pred_text')} FROM rc WHERE reject_reason IS NULL),
{q.ALIGN_CTES},
asr AS (
  SELECT doc_id, 'ASR' AS Task, asr_model AS Model, lang AS Language,
    CASE WHEN ok THEN concat_ws('-', regexp_extract(base, '{tx.RECORDING_RE}', 1), regexp_extract(base, '{tx.RECORDING_RE}', 2),
      regexp_extract(base, '{tx.RECORDING_RE}', 3), regexp_extract(base, '{tx.RECORDING_RE}', 4)) ELSE base END || '.wav' AS Audio_File_Name,
    CAST(line_index AS BIGINT) AS Line_Index,
    CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 2) || '_' || regexp_extract(base, '{tx.RECORDING_RE}', 3) END AS Speaker_Group,
    CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 2) END AS Speaker_Type,
    CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 3) END AS Speaker_Gender,
    d.Condition_Code, d.Noise_Level, d.Noise_Type, d.Voice_Volume, lang AS Source_Lang, CAST(NULL AS VARCHAR) AS Target_Lang,
    'N/A (ASR Task)' AS ASR_WER_Status, CAST(NULL AS DOUBLE) AS High_WER_Percentage,
    CASE WHEN nr > 0 THEN (subs + dels + ins)::DOUBLE / nr END AS WER,
    CASE WHEN nr > 0 THEN CASE WHEN nh = 0 THEN 1.0 ELSE 1 - hits::DOUBLE / nr * (hits::DOUBLE / nh) END END AS WIL,
    CAST(NULL AS DOUBLE) AS METEOR, CAST(NULL AS DOUBLE) AS TER, CAST(NULL AS DOUBLE) AS COMET,
    ref_text AS Ref_Text_Normalized, pred_text AS Pred_Text_Normalized, 'data/normalized/' || lang || '_SOURCE.txt' AS Ref_File_Path, pred_path AS Pred_File_Path,
    reject_reason, asr_folder
  FROM rc LEFT JOIN e USING (pair_id)
  LEFT JOIN {q.CONDITIONS} d ON d.Condition_Code = CASE WHEN ok THEN regexp_extract(base, '{tx.RECORDING_RE}', 4) END),
hw AS (SELECT pair_id, word, hp, row_number() OVER (PARTITION BY pair_id, word ORDER BY hp DESC) AS k
       FROM (SELECT pair_id, unnest(h) AS word, unnest(range(len(h))) AS hp FROM segs)),
rw AS (SELECT pair_id, word, rp, row_number() OVER (PARTITION BY pair_id, word ORDER BY rp DESC) AS k
       FROM (SELECT pair_id, unnest(r) AS word, unnest(range(len(r))) AS rp FROM segs)),
wm AS (SELECT pair_id, hp, rp FROM hw JOIN rw USING (pair_id, word, k)),
wc AS (SELECT wm.pair_id, count(*) AS mm, count(*) - count(n.hp) AS ch FROM wm LEFT JOIN wm n ON wm.pair_id = n.pair_id AND n.hp = wm.hp + 1 AND n.rp = wm.rp + 1 GROUP BY wm.pair_id),
scored AS (SELECT segs.*, subs + dels + ins AS edits, nr,
    CASE WHEN coalesce(mm, 0) = 0 THEN 0.0 ELSE ((mm::DOUBLE / len(h)) * (mm::DOUBLE / len(r)) / (0.9 * (mm::DOUBLE / len(h)) + 0.1 * (mm::DOUBLE / len(r))))
      * (1 - 0.5 * power(ch::DOUBLE / mm, 3)) END AS meteor,
    CASE WHEN len(list_distinct(list_concat(h, r))) = 0 THEN NULL
      ELSE round(len(list_intersect(list_distinct(h), list_distinct(r)))::DOUBLE / len(list_distinct(list_concat(h, r))), 6) END AS comet
  FROM segs LEFT JOIN wc USING (pair_id) LEFT JOIN e USING (pair_id)),
files AS (SELECT doc_id, src_lang, tgt_lang, asr_model, mt_model, any_value(source_file) AS source_file,
    CAST(sum(CAST(round(meteor * 1e9) AS BIGINT)) AS DOUBLE) / count(meteor) / 1e9 AS METEOR,
    CAST(sum(CAST(round(comet * 1e9) AS BIGINT)) AS DOUBLE) / count(comet) / 1e9 AS COMET,
    CASE WHEN sum(nr) > 0 THEN 100.0::DOUBLE * sum(edits) / sum(nr) WHEN sum(edits) > 0 THEN 100.0 ELSE 0.0 END AS TER
  FROM scored GROUP BY ALL),
means AS (SELECT Language, Model, avg(WER) AS w, avg(WIL) AS l, count(*) FILTER (WHERE WER > 0.4)::DOUBLE / count(*) AS high FROM asr WHERE reject_reason IS NULL GROUP BY ALL),
mt AS (
  SELECT f.doc_id, f.asr_model, 'MT' AS Task, f.mt_model AS Model, f.tgt_lang AS Language,
    CASE WHEN f.asr_model IS NULL THEN 'Human Source' ELSE a.Audio_File_Name END AS Audio_File_Name, CASE WHEN f.asr_model IS NULL THEN -1 ELSE a.Line_Index END AS Line_Index,
    {', '.join(f"CASE WHEN f.asr_model IS NULL THEN 'N/A' ELSE a.{c} END AS {c}" for c in ("Speaker_Group", "Speaker_Type", "Speaker_Gender", "Condition_Code", "Noise_Level", "Noise_Type", "Voice_Volume"))},
    f.src_lang AS Source_Lang, f.tgt_lang AS Target_Lang,
    CASE WHEN f.asr_model IS NULL THEN 'Human Source' ELSE 'ASR Source (' || f.src_lang || '_' || coalesce(a.asr_folder, f.asr_model) || ')' END AS ASR_WER_Status,
    CASE WHEN f.asr_model IS NULL THEN 0.0 ELSE m.high END AS High_WER_Percentage, CASE WHEN f.asr_model IS NULL THEN 0.0 ELSE m.w END AS WER,
    CASE WHEN f.asr_model IS NULL THEN 0.0 ELSE m.l END AS WIL, METEOR_ AS METEOR, TER_ AS TER, COMET_ AS COMET,
    source AS Source_File, 'data/' || f.tgt_lang || '/' || f.tgt_lang || '_SOURCE.txt' AS Ref_File,
    'data/results/mt/' || g.mt_folder || '/' || replace(regexp_replace(regexp_extract(source, '[^/]*$'), '^(.*[^.].*)\\.[^.]*$', '\\1'), '-', '_')
      || '_' || split_part(f.mt_model, '_', 1) || '_' || f.src_lang || '2' || f.tgt_lang || '_results.txt' AS Pred_File
  FROM (SELECT *, METEOR AS METEOR_, TER AS TER_, COMET AS COMET_, coalesce(source_file, 'data/' || src_lang || '/' || src_lang || '_SOURCE.txt') AS source FROM files) f
  JOIN {q.MT_MODELS} g USING (mt_model)
  LEFT JOIN asr a ON a.doc_id = f.doc_id AND a.Language = f.src_lang AND a.Model = f.asr_model AND a.reject_reason IS NULL
  LEFT JOIN means m ON m.Language = a.Language AND m.Model = a.Model)"""


def _rounded(df):
    return df.withColumns({c: _r6(F.col(c)) for c in ("WER", "WIL", "High_WER_Percentage", "METEOR", "TER", "COMET")})


_ROUND = "round(WER, 6) AS WER, round(WIL, 6) AS WIL, round(High_WER_Percentage, 6) AS High_WER_Percentage, round(METEOR, 6) AS METEOR, round(TER, 6) AS TER, round(COMET, 6) AS COMET"


def bench_asr(spark, d):
    from tulkki.plans.evaluate import evaluate_asr
    return evaluate_asr(spark, corpus.asr_outputs(spark, bench_documents(spark, d)))


def bench_mt(spark, d, on_asr: bool):
    """Records of translations of a human source, or (J9) of transcripts, without the shifts of TER."""
    from tulkki.operators.ter import TerLimits
    from tulkki.plans.evaluate import evaluate_mt, evaluate_mt_on_asr
    docs, limits = bench_documents(spark, d), TerLimits(max_shifts=0, beam=None)
    if on_asr:
        r = evaluate_mt_on_asr(corpus.mt_on_asr_lists(spark, docs), bench_asr(spark, d), overlap_scorer, limits=limits)
    else:
        r = evaluate_mt(corpus.mt_segments(spark, docs), overlap_scorer, limits=limits)
    return r.drop("src_lang", "tgt_lang", "mt_model")


@register("e1_records_benchmark", _RECORDS + f" SELECT * EXCLUDE (asr_folder) REPLACE ({_ROUND}) FROM asr")
def e1_records_benchmark(spark, d):
    """The whole ASR record, rejects included."""
    return _rounded(bench_asr(spark, d).drop("al"))


@register("e2_records_benchmark", _RECORDS + f" SELECT * EXCLUDE (asr_model) REPLACE ({_ROUND}) FROM mt WHERE asr_model IS NULL")
def e2_records_benchmark(spark, d):
    """The whole MT record of a human source."""
    return _rounded(bench_mt(spark, d, False).drop("asr_model"))


@register("e3_j9_records_benchmark", _RECORDS + f" SELECT * REPLACE ({_ROUND}) FROM mt WHERE asr_model IS NOT NULL")
def e3_j9_records_benchmark(spark, d):
    """The whole MT record of a transcript, with the transcript's quality and metadata."""
    return _rounded(bench_mt(spark, d, True))


@register("e4_summary_benchmark", _RECORDS + f""" SELECT * REPLACE ({_ROUND}) FROM (
  SELECT * EXCLUDE (doc_id, reject_reason, asr_folder) FROM asr UNION ALL BY NAME SELECT * EXCLUDE (doc_id, asr_model) FROM mt)""")
def e4_summary_benchmark(spark, d):
    """All records unioned by name, known columns first."""
    asr = bench_asr(spark, d).drop("al", "reject_reason", "doc_id")
    mt = bench_mt(spark, d, False).unionByName(bench_mt(spark, d, True)).drop("doc_id", "asr_model")
    return _rounded(rel.compile_results(asr, mt))


@register("m1_align_tiles_benchmark", _BENCH_COUNTS + " SELECT item_id, asr_model, Condition_Code, hits, subs, dels, ins FROM counts")
def m1_align_tiles_benchmark(spark, d):
    """M1 of every benchmark pair of more than eight words by tiles of sixteen words, so that a pair is spread over tasks."""
    from tulkki.operators.long_align import align_pairs
    pairs = corpus.benchmark_pairs(spark, _t(spark, d, "benchmark"))
    a = align_pairs(pairs, ["item_id", "asr_model", "Condition_Code"], long_words=8, tile=16)
    return a.select("item_id", "asr_model", "Condition_Code", "al.hits", "al.subs", "al.dels", "al.ins")

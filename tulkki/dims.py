"""Small fixed dimensions (languages, models, recording conditions).

They are tiny and of fixed size, so every join against them is a broadcast
join; none of them grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# --- fixed values (must equal the evaluated setup) -------------------------
LANGUAGES = ["fi", "en", "fr"]
LANGUAGE_NAMES = {"fi": "finnish", "en": "english", "fr": "french"}
NLLB_CODES = {"fi": "fin_Latn", "en": "eng_Latn", "fr": "fra_Latn"}
WAV2VEC2_MODELS = {
    "fi": "jonatasgrosman/wav2vec2-large-xlsr-53-finnish",
    "en": "facebook/wav2vec2-large-960h",
    "fr": "facebook/wav2vec2-large-xlsr-53-french",
}
OPUS_MODELS = {
    ("fi", "en"): "Helsinki-NLP/opus-mt-fi-en",
    ("en", "fi"): "Helsinki-NLP/opus-mt-en-fi",
    ("fi", "fr"): "Helsinki-NLP/opus-mt-fi-fr",
    ("fr", "fi"): "Helsinki-NLP/opus-mt-tc-bible-big-deu_eng_fra_por_spa-fiu",
    ("en", "fr"): "Helsinki-NLP/opus-mt-en-fr",
    ("fr", "en"): "Helsinki-NLP/opus-mt-fr-en",
}
ASR_MODELS = {
    "whisper_large_v2": "openai_whisper_large_v2",
    "wav2vec2_xlsr_fi": "jonatasgrosman_wav2vec2_large_xlsr_53_finnish",
    "wav2vec2_xlsr_fr": "facebook_wav2vec2_large_xlsr_53_french",
    "wav2vec2_xlsr_en": "facebook_wav2vec2_large_960h",
    "parakeet": "nvidia_parakeet_tdt_0_6b_v3",
}
MT_MODELS = {
    "nllb": "facebook_nllb-200-distilled-600M",
    "opus_mt_fi_en": "opus-mt-fi-en",
    "opus_mt_en_fi": "opus-mt-en-fi",
    "opus_mt_fi_fr": "opus-mt-fi-fr",
    "opus_mt_fr_fi": "opus-mt-tc-bible-big-deu_eng_fra_por_spa-fiu",
    "opus_mt_en_fr": "opus-mt-en-fr",
    "opus_mt_fr_en": "opus-mt-fr-en",
}
SPEAKER_GROUPS = ["nat_m", "nat_n", "aks_m", "aks_n"]
CONDITIONS = [
    # code, noise level, noise type, voice volume
    ("c1", "low/none", None, "normal"),
    ("c2", "low/none", None, "low"),
    ("c3", "medium", "human", "normal"),
    ("c4", "medium", "traffic", "normal"),
    ("c5", "high", "human", "normal"),
    ("c6", "high", "traffic", "normal"),
]
HIGH_WER_THRESHOLD = 0.4
ERROR_MARKER = "ERROR"
HUMAN_SOURCE = "Human Source"
ASR_TASK_STATUS = "N/A (ASR Task)"
# ---------------------------------------------------------------------------


def conditions(spark: SparkSession) -> DataFrame:
    schema = T.StructType([
        T.StructField("Condition_Code", T.StringType(), False),
        T.StructField("Noise_Level", T.StringType(), True),
        T.StructField("Noise_Type", T.StringType(), True),
        T.StructField("Voice_Volume", T.StringType(), True),
    ])
    return spark.createDataFrame(CONDITIONS, schema)


def asr_models(spark: SparkSession) -> DataFrame:
    rows = [(name, folder, i + 1) for i, (name, folder) in enumerate(ASR_MODELS.items())]
    return spark.createDataFrame(rows, "asr_model string, asr_folder string, model_no int")


def mt_models(spark: SparkSession) -> DataFrame:
    rows = [(name, folder, i + 1) for i, (name, folder) in enumerate(MT_MODELS.items())]
    return spark.createDataFrame(rows, "mt_model string, mt_folder string, model_no int")


def languages(spark: SparkSession) -> DataFrame:
    rows = [(c, LANGUAGE_NAMES[c], NLLB_CODES[c], WAV2VEC2_MODELS[c]) for c in LANGUAGES]
    return spark.createDataFrame(rows, "lang string, lang_full string, nllb_code string, wav2vec2_model string")


def opus_pairs(spark: SparkSession) -> DataFrame:
    rows = [(s, t, m) for (s, t), m in OPUS_MODELS.items()]
    return spark.createDataFrame(rows, "src_lang string, tgt_lang string, opus_model string")


def speaker_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g,) for g in SPEAKER_GROUPS], "Speaker_Group string")


def values_sql(rows, cols) -> str:
    """Render a fixed dimension as a SQL VALUES list (used by oracle SQL)."""
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return str(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(SELECT * FROM (VALUES {body}) AS t({', '.join(cols)}))"

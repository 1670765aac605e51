"""F1-F19 scalar functions against the Python rules they restate."""

import re

import pytest


def py_normalize(t):
    t = t.lower()
    t = re.sub(r'[.,:;!?"\'\\-]', '', t)
    t = re.sub(r'\s+', ' ', t).strip()
    return " ".join(t.split())


CASES = ["Hello, World!", "  well-known  l'eau \t\n x ", "a\x1cb c d", "", "(50%) « ok » – fine…",
         'Say "hi"; then: go\\now?']


def test_normalize_matches_python(spark):
    from tulkki.functions.text import normalize
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", normalize("t").alias("n")).collect()}
    for i, t in enumerate(CASES):
        assert got[i] == py_normalize(t), t


def test_normalize_idempotent(spark):
    from tulkki.functions.text import normalize
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    rows = df.select(normalize("t").alias("a"), normalize(normalize("t")).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_split_sentences_golden_and_idempotent(spark):
    from tulkki.functions.text import split_sentences
    src = "Hei M. Dupont jne. Loppu.Uusi lause... pi 3.14 ETC.  x"
    want = "Hei M. Dupont jne. Loppu.\nUusi lause.\n.\n.\npi 3.\n14 ETC. x"
    df = spark.createDataFrame([(src,), ("",), (None,)], "t string")
    rows = df.select(split_sentences("t").alias("s"), split_sentences(split_sentences("t")).alias("s2")).collect()
    assert rows[0]["s"] == want
    assert rows[0]["s2"] == want
    assert rows[1]["s"] == "" and rows[2]["s"] == ""


@pytest.mark.parametrize("name,meta,index,audio", [
    ("fi_nat_m_c1_whisper-large-v2_transcription.txt", ("fi", "nat", "m", "c1", "nat_m"), 0, "fi-nat-m-c1.wav"),
    ("en-aks-n-c4_parakeet-tdt-0.6b-v3_transcription.txt", ("en", "aks", "n", "c4", "aks_n"), 3, "en-aks-n-c4.wav"),
    ("fi_nat_m_c12_x.txt", ("fi", "nat", "m", "c1", "nat_m"), 11, "fi-nat-m-c1.wav"),
    ("FI_nat_m_C3_transcription.TXT", (None,) * 5, 2, "FI_nat_m_C3.wav"),
    ("notes.txt", (None,) * 5, -1, "notes.wav"),
])
def test_recording_names(spark, name, meta, index, audio):
    from pyspark.sql import functions as F

    from tulkki.functions import text as tx
    df = spark.createDataFrame([(name,)], "n string").withColumn("base", tx.recording_base("n"))
    p = tx.parse_recording("base")
    r = df.select(p.alias("p"), tx.line_index("base").alias("i"), tx.audio_name(F.col("base"), p).alias("a")).first()
    assert tuple(r["p"]) == meta
    assert r["i"] == index
    assert r["a"] == audio


def test_names_and_paths(spark):
    from tulkki.functions import text as tx
    df = spark.createDataFrame([("data/results/asr/openai_whisper/x.txt", "Helsinki-NLP/opus-mt-fi-en")], "p string, m string")
    r = df.select(tx.model_folder("p").alias("f"), tx.safe_name("m").alias("s"), tx.short_name("m").alias("sh"),
                  tx.model_family("m").alias("fam"), tx.lang_from_path("p").alias("l")).first()
    assert r["f"] == "openai_whisper" and r["s"] == "Helsinki_NLP_opus_mt_fi_en"
    assert r["sh"] == "opus-mt-fi-en" and r["fam"] == "Helsinki-NLP/opus-mt-fi-en" and r["l"] is None
    r2 = spark.createDataFrame([("x",), ("data/fi/a.wav",)], "p string").select(
        tx.model_folder("p").alias("f"), tx.lang_from_path("p").alias("l")).collect()
    assert r2[0]["f"] == "unknown_model" and r2[1]["l"] == "fi"


def test_strip_and_collapse_take_every_white_space(spark):
    import re
    from tulkki.functions.text import WS_CHARS, normalize, strip
    spaces = [c for c in map(chr, range(0x10000)) if c.isspace()]
    assert sorted(WS_CHARS) == spaces
    texts = [f"{a}x{b}{a}y {b}z{a}{b}" for a in spaces for b in (" ", "\t", "\u3000")] + ["a b", " a  b ", "\u200b\u180ex", ""]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip("t").alias("s"), normalize("t").alias("n")).collect()
    assert all(r["s"] == r["t"].strip() and r["n"] == re.sub(r"\s+", " ", r["t"]).strip(" ") for r in got)

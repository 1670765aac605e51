"""File sources/sinks (S1-S9), incremental evaluation (T1), model map."""

import json
import os

from pyspark.sql import functions as F


def _write(path, text, mode="w"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode, encoding="utf-8", newline="") as f:
        f.write(text)


def test_read_lines_and_discovery(spark, tmpdir_fresh):
    from tulkki.sources.files import list_files, read_lines
    root = tmpdir_fresh
    _write(f"{root}/fi/fi-nat-m-c1.txt", "  first line \r\n\r\n second\rthird\n\n")
    _write(f"{root}/fi/fi_aks_n_c2.txt", "only\n")
    _write(f"{root}/fi/readme.md", "x\n")
    rows = sorted((r["file_name"], r["pos"], r["text"]) for r in read_lines(spark, f"{root}/fi", "*.txt").collect())
    assert rows == [("fi-nat-m-c1.txt", 0, "first line"), ("fi-nat-m-c1.txt", 1, "second"),
                    ("fi-nat-m-c1.txt", 2, "third"), ("fi_aks_n_c2.txt", 0, "only")]
    names = {r["file_name"] for r in list_files(spark, root, "fi[-_]*.txt", recursive=True).collect()}
    assert names == {"fi-nat-m-c1.txt", "fi_aks_n_c2.txt"}


def test_results_round_trip_append_and_slice(spark, tmpdir_fresh):
    from tulkki.schemas import RESULT
    from tulkki.sources.files import append_results, read_results, replace_slice, write_results
    rec = {f.name: None for f in RESULT.fields}
    rec.update(Task="ASR", Model="m1", Language="fi", WER=0.5, WIL=float("nan"))
    p = f"{tmpdir_fresh}/arr.json"
    _write(p, json.dumps([rec]).replace("NaN", "NaN"))
    df = read_results(spark, p, arrays=True)
    r = df.first()
    assert r["WER"] == 0.5 and r["WIL"] is None
    write_results(df, f"{tmpdir_fresh}/out_json", "json")
    back = spark.read.json(f"{tmpdir_fresh}/out_json")
    assert "COMET" in back.columns  # null fields kept
    write_results(df.select("Task", "Model", "WER"), f"{tmpdir_fresh}/out_csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmpdir_fresh}/out_csv").count() == 1
    base = spark.createDataFrame([("fi", "a", 1.0), ("en", "a", 2.0)], "Language string, Model string, WER double")
    tgt = f"{tmpdir_fresh}/res"
    append_results(base, tgt, ["Language", "Model"])
    append_results(base.filter("Language = 'fi'"), tgt, ["Language", "Model"])
    assert spark.read.parquet(tgt).count() == 3
    replace_slice(spark.createDataFrame([("fi", "a", 9.0)], base.schema), tgt, ["Language", "Model"])
    got = sorted((r["Language"], r["WER"]) for r in spark.read.parquet(tgt).collect())
    assert got == [("en", 2.0), ("fi", 9.0)]


def test_write_lines_keeps_order(spark, tmpdir_fresh):
    from tulkki.sources.files import write_lines
    df = spark.createDataFrame([("a", 2, " c "), ("a", 0, "a"), ("a", 1, "b"), ("b", 0, "z")], "k string, pos int, text string")
    write_lines(df, f"{tmpdir_fresh}/lines", ["k"])
    files = [f for f in os.listdir(f"{tmpdir_fresh}/lines/k=a") if f.startswith("part-")]
    content = "".join(open(f"{tmpdir_fresh}/lines/k=a/{f}").read() for f in sorted(files))
    assert content == "a\nb\nc\n"


def test_incremental_stream_scores_only_new_files(spark, tmpdir_fresh):
    from tulkki.streaming.incremental import evaluate_files, stream_evaluate
    refs = spark.createDataFrame([("fi-nat-m-c1", "a b c d"), ("fi-nat-m-c2", "p q"), ("en-aks-n-c3-9", "x")], "recording string, ref_text string")
    inp = f"{tmpdir_fresh}/in"
    _write(f"{inp}/m1/fi-nat-m-c1_transcription.txt", "A x C d e\n")
    out, ck = f"{tmpdir_fresh}/out", f"{tmpdir_fresh}/ck"
    stream_evaluate(spark, inp, refs, out, ck)
    first = spark.read.parquet(out).collect()
    assert len(first) == 1 and first[0]["WER"] == 0.5
    _write(f"{inp}/m1/fi-nat-m-c2_transcription.txt", "q p\n")
    _write(f"{inp}/m1/fi-nat-m-c4_transcription.txt", "no reference\n")
    _write(f"{inp}/m2/en-aks-n-c3-9_transcription.txt", " \n")
    stream_evaluate(spark, inp, refs, out, ck)
    rows = spark.read.parquet(out).collect()
    reasons = sorted((r["recording"], r["reject_reason"] or "", r["WIL"]) for r in rows)
    assert reasons == [("en-aks-n-c3-9", "empty_prediction", None), ("fi-nat-m-c1", "", 0.55), ("fi-nat-m-c2", "", 0.75), ("fi-nat-m-c4", "missing_reference", None)]
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(inp).select(F.col("_metadata.file_path").alias("path"), "value")
    batch = evaluate_files(spark, files, refs)
    assert sorted(map(str, batch.collect())) == sorted(map(str, spark.read.parquet(out).select(*batch.columns).collect()))


def test_lines_are_those_of_universal_newlines(spark, tmpdir_fresh):
    from tulkki.sources.files import missing_inputs, read_lines
    odd = "one\x0ctwo three\x85four\nfive\r\n\r  six\u2028seven \r\r\neight"
    _write(f"{tmpdir_fresh}/a.txt", odd)
    _write(f"{tmpdir_fresh}/b.txt", "\n\n")
    with open(f"{tmpdir_fresh}/a.txt", encoding="utf-8") as f:
        want = [x.strip() for x in f.readlines() if x.strip()]
    got = sorted((r["pos"], r["text"]) for r in read_lines(spark, f"{tmpdir_fresh}/*.txt").collect())
    assert got == list(enumerate(want))
    paths = [f"{tmpdir_fresh}/a.txt", f"{tmpdir_fresh}/none.txt"]
    assert read_lines(spark, paths).count() == len(want)
    assert read_lines(spark, paths[1]).collect() == []
    assert [tuple(r) for r in missing_inputs(spark, paths).collect()] == [(paths[1], "missing_input")]


def test_positions_run_across_splits(spark, tmpdir_fresh):
    from tulkki.sources.files import read_lines
    _write(f"{tmpdir_fresh}/long.txt", "".join(f"line {i}\n" if i % 5 else "\n" for i in range(5000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = read_lines(spark, f"{tmpdir_fresh}/long.txt")
        assert rows.select(F.spark_partition_id()).distinct().count() >= 1
        got = sorted((r["pos"], r["text"]) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(enumerate(f"line {i}" for i in range(5000) if i % 5))


def test_results_round_trip_many_rows_in_a_file(spark, tmpdir_fresh):
    from tulkki.schemas import RESULT
    from tulkki.sources.files import append_results, read_results, write_results
    rows = [tuple({"StringType": f"v{i}", "LongType": i, "DoubleType": i / 8}[type(f.dataType).__name__] if (i + k) % 7 else None
                  for k, f in enumerate(RESULT.fields)) for i in range(1000)]
    df = spark.createDataFrame(rows, RESULT).coalesce(1)
    write_results(df, f"{tmpdir_fresh}/json")
    assert len([x for x in os.listdir(f"{tmpdir_fresh}/json") if x.startswith("part-")]) == 1
    assert sorted(map(str, read_results(spark, f"{tmpdir_fresh}/json").collect())) == sorted(map(str, df.collect()))
    # appended columns go by name, whatever their order
    append_results(spark.createDataFrame([("a", 1)], "x string, y int"), f"{tmpdir_fresh}/t")
    append_results(spark.createDataFrame([(2, "b", 0.5)], "y int, x string, z double"), f"{tmpdir_fresh}/t")
    append_results(spark.createDataFrame([("c",)], "x string"), f"{tmpdir_fresh}/t")
    got = spark.read.option("mergeSchema", True).parquet(f"{tmpdir_fresh}/t").select("x", "y", "z").collect()
    assert sorted(map(tuple, got)) == [("a", 1, None), ("b", 2, 0.5), ("c", None, None)]


def test_a_hot_key_is_written_by_many_tasks_in_order(spark, tmpdir_fresh):
    from tulkki.sources.files import write_lines
    df = spark.range(1000).select(F.lit("hot").alias("k"), F.col("id").alias("pos"), F.concat(F.lit(" t"), "id").alias("text")).repartition(7)
    write_lines(df, f"{tmpdir_fresh}/hot", ["k"], stretch=100)
    files = sorted(f for f in os.listdir(f"{tmpdir_fresh}/hot/k=hot") if f.startswith("part-"))
    content = "".join(open(f"{tmpdir_fresh}/hot/k=hot/{f}").read() for f in files)
    assert content == "".join(f"t{i}\n" for i in range(1000))


def test_a_worker_loads_each_model_once(spark, tmpdir_fresh):
    from tulkki.operators.infer import batch_map
    folder = tmpdir_fresh

    def counting(name):
        import os
        import tempfile
        fd, _ = tempfile.mkstemp(prefix=f"{os.getpid()}-{name}-", dir=folder)
        os.close(fd)
        return lambda texts: [f"{name}:{t}" for t in texts]
    df = spark.range(4000).select("id", F.concat(F.lit("m"), F.col("id") % 3).alias("m"), F.col("id").cast("string").alias("t")).repartition(16)
    rows = batch_map(df, counting, ["t"], "out", model_col="m").collect()
    assert {r["out"] for r in rows} == {f"m{i % 3}:{i}" for i in range(4000)}
    loads = [x.split("-")[:2] for x in os.listdir(folder)]
    assert len(loads) == len({tuple(x) for x in loads})
    # the next job finds the last model of each worker
    batch_map(df.where("m = 'm2'"), counting, ["t"], "out", model="m2").collect()
    after = [x.split("-")[:2] for x in os.listdir(folder)]
    assert sum(m == "m2" for _, m in after) <= len({p for p, _ in after})


def test_transcribe_and_translate_jobs(spark, tmpdir_fresh):
    from tulkki.plans.jobs import transcribe_job, translate_job
    from tulkki.sources.files import audio_manifest, read_lines

    def reading(name):
        def predict(paths):
            if any("bad" in p for p in paths):
                raise RuntimeError("broken file")
            return [f"{name} heard {p.rsplit('/', 1)[-1]}" for p in paths]
        return predict
    for f in ("fi/fi-nat-m-c1-3.wav", "en/en-aks-n-c5-1.wav", "en/en-aks-n-c6-bad.wav", "zz/noise.wav", "zz/readme.md"):
        _write(f"{tmpdir_fresh}/audio/{f}", "x")
    manifest = audio_manifest(spark, f"{tmpdir_fresh}/audio")
    meta = {r["file_name"]: (r["Language"], r["Condition_Code"], r["Noise_Level"]) for r in manifest.collect()}
    assert meta["fi-nat-m-c1-3.wav"] == ("fi", "c1", "low/none") and meta["noise.wav"] == (None, None, None) and len(meta) == 4
    done = manifest.where("file_name LIKE 'fi%'").selectExpr("path", "'parakeet' AS asr_model")
    good, bad = transcribe_job(spark, manifest, reading, done)
    got = {(r["pred_path"], r["text"]) for r in good.collect()}
    want = {("fi-nat-m-c1-3", m) for m in ("whisper_large_v2", "wav2vec2_xlsr_fi")} | {("en-aks-n-c5-1", m) for m in ("whisper_large_v2", "wav2vec2_xlsr_en", "parakeet")}
    assert {(p.rsplit("/", 1)[-1].removesuffix("_transcription.txt"), t.split()[0]) for p, t in got} == want
    reasons = sorted((r["path"].rsplit("/", 1)[-1], r["reject_reason"]) for r in bad.collect())
    assert reasons == [("en-aks-n-c6-bad.wav", "model_error: RuntimeError")] * 3 + [("noise.wav", "unknown_language")]
    for r in good.collect():
        _write(f"{tmpdir_fresh}/{r['pred_path']}", r["text"] + "\n\nsecond line\n")
    lines = read_lines(spark, f"{tmpdir_fresh}/data/results/asr", recursive=True)

    def upper(name):
        return lambda texts: [f"{name} {t.upper()}" for t in texts]
    out, rejects = translate_job(lines, upper, ["fi", "en", "fr"])
    assert rejects.count() == 0
    rows = out.where("src_lang = 'fi' AND tgt_lang = 'en' AND pos = 1").collect()
    assert {(r["path"], r["text"]) for r in rows} == {
        ("data/results/mt/opus-mt-fi-en/fi_nat_m_c1_3_transcription_opus_fi2en_results.txt", "opus_mt_fi_en SECOND LINE"),
        ("data/results/mt/facebook_nllb-200-distilled-600M/fi_nat_m_c1_3_transcription_nllb_fi2en_results.txt", "nllb SECOND LINE")}


def test_batch_map_isolates_failures(spark):
    from tulkki.operators.infer import batch_map

    def _flaky_model(name):  # defined inline so it pickles by value
        def predict(texts):
            if any("BAD" in t for t in texts):
                raise RuntimeError("boom")
            return [t.upper() if t != "empty" else "" for t in texts]
        return predict
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "BAD", "c", "empty", "e"])], "id int, t string")
    rows = {r["id"]: r for r in batch_map(df, _flaky_model, ["t"], "out", batch_size=2).collect()}
    assert rows[0]["out"] == "A" and rows[0]["out_error"] is None
    assert rows[1]["out"] is None and rows[1]["out_error"].startswith("model_error")
    assert rows[2]["out"] == "C"
    assert rows[3]["out"] is None and rows[3]["out_error"] == "empty_prediction"


def test_overlap_chunks_rule(spark):
    from tulkki.operators.infer import overlap_chunks
    df = spark.createDataFrame([(list(range(70)),), (list(range(30)),), ([],)], "a array<int>")
    got = [[(c["start"], c["stride_left"], c["stride_right"]) for c in r["c"]]
           for r in df.select(overlap_chunks("a").alias("c")).collect()]
    assert got[0] == [(0, 0, 2), (24, 4, 2), (48, 4, 0)]
    assert got[1] == [(0, 0, 0)]
    assert got[2] == []

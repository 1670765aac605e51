"""S4 unreadable records, S8 repeated runs and batches, T1 references that come late."""

import json
import os

import pytest

from pyspark.sql import functions as F


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def test_half_written_results_are_rejected(spark, tmp_path):
    from tulkki.sources.files import read_results, results_and_rejects
    whole = [json.dumps({"Task": "ASR", "Model": f"m{i}", "Language": "fi", "WER": i / 4, "Line_Index": i}) for i in range(3)]
    _write(f"{tmp_path}/lines/a.json", "\n".join(whole) + '\n{"Task": "ASR", "Model": "m3", "WER": 0.')
    _write(f"{tmp_path}/lines/b.json", '{"Task": "MT", "Model": "x", "WER": "high"}\n' + whole[0].replace("0.0", "NaN") + "\n")
    good, bad = results_and_rejects(spark, f"{tmp_path}/lines")
    assert sorted((r["Model"], r["WER"]) for r in good.collect() if r["WER"] is not None) == [("m0", 0.0), ("m1", 0.25), ("m2", 0.5)]
    assert good.count() == 4 == read_results(spark, f"{tmp_path}/lines").count()
    rejects = sorted((r["path"].rsplit("/", 1)[-1], r["Model"], r["record"][:12], r["reject_reason"]) for r in bad.collect())
    # nothing of a broken line is known, of a value that does not fit the rest is
    assert rejects == [("a.json", None, '{"Task": "AS', "unreadable_record"), ("b.json", "x", '{"Task": "MT', "unreadable_record")]
    _write(f"{tmp_path}/arrays/a.json", "[" + ",\n".join(whole) + "]")
    _write(f"{tmp_path}/arrays/b.json", "[" + ",\n".join(whole)[:-9])
    good, bad = results_and_rejects(spark, f"{tmp_path}/arrays", arrays=True)
    names = {r["path"].rsplit("/", 1)[-1] for r in bad.collect()}
    assert names == {"b.json"} and good.where(F.col("_metadata.file_path").endswith("a.json")).count() == 3


def test_a_repeated_run_replaces_itself(spark, tmp_path):
    from tulkki.sources.files import append_results
    path = f"{tmp_path}/table"
    one = spark.createDataFrame([("fi", 1), ("en", 2)], "Language string, n int")
    append_results(one, path, ["Language"], run="a")
    append_results(one.withColumn("more", F.lit("x")), path, ["Language"], run="b")
    append_results(one.where("n = 1"), path, ["Language"], run="a")
    read = lambda: sorted((r["run"], r["Language"], r["n"], r["more"]) for r in spark.read.option("mergeSchema", True).parquet(path).collect())
    assert read() == [("a", "fi", 1, None), ("b", "en", 2, "x"), ("b", "fi", 1, "x")]
    with pytest.raises(ValueError):
        append_results(one, path, ["Language"])
    append_results(one, f"{tmp_path}/plain")
    with pytest.raises(ValueError):
        append_results(one, f"{tmp_path}/plain", run="a")


def test_a_killed_batch_is_repeated_without_doubled_rows(spark, tmp_path, monkeypatch):
    from tulkki.sources import files
    _write(f"{tmp_path}/in/a.txt", "one\ntwo\n")
    stream = lambda: spark.readStream.format("text").load(f"{tmp_path}/in")
    real, fail = files.append_results, [True]

    def killed(*args, **how):
        real(*args, **how)
        if fail.pop():
            raise RuntimeError("killed after the write")
        fail.append(False)
    monkeypatch.setattr(files, "append_results", killed)
    with pytest.raises(Exception, match="killed"):
        files.append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    fail.append(False)
    files.append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    _write(f"{tmp_path}/in/b.txt", "three\n")
    files.append_stream(stream(), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert sorted(r["value"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["one", "three", "two"]


def test_a_transcript_is_scored_once_when_its_reference_comes(spark, tmp_path):
    from tulkki.streaming.incremental import current_records, stream_evaluate
    refs = lambda *names: spark.createDataFrame([(n, "a b c d") for n in names], "recording string, ref_text string")
    inp, out, ck = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck"
    state = lambda: sorted((r["recording"], r["asr_model"] if "asr_model" in r else r["Model"], r["reject_reason"], r["WER"]) for r in current_records(spark, out).collect())
    _write(f"{inp}/m1/fi-nat-m-c1_transcription.txt", "a b c d\n")
    _write(f"{inp}/m1/fi-nat-m-c2_transcription.txt", "a x c d\n")
    _write(f"{inp}/m2/fi-nat-m-c2_transcription.txt", " \n")
    _write(f"{inp}/m1/fi-nat-m-c3_transcription.txt", "never\n")
    stream_evaluate(spark, inp, refs("fi-nat-m-c1"), out, ck)
    missing = "missing_reference"
    assert state() == [("fi-nat-m-c1", "m1", None, 0.0), ("fi-nat-m-c2", "m1", missing, None), ("fi-nat-m-c2", "m2", missing, None), ("fi-nat-m-c3", "m1", missing, None)]
    both = refs("fi-nat-m-c1", "fi-nat-m-c2")
    want = [("fi-nat-m-c1", "m1", None, 0.0), ("fi-nat-m-c2", "m1", None, 0.25), ("fi-nat-m-c2", "m2", "empty_prediction", None), ("fi-nat-m-c3", "m1", missing, None)]
    stream_evaluate(spark, inp, both, out, ck)
    assert state() == want
    rows = spark.read.parquet(out).count()
    stream_evaluate(spark, inp, both, out, ck)
    assert state() == want and spark.read.parquet(out).count() == rows
    # a file that comes with its reference there is scored at once, the waiting one when its own comes
    _write(f"{inp}/m1/fi-nat-m-c4_transcription.txt", "a b\n")
    stream_evaluate(spark, inp, refs("fi-nat-m-c1", "fi-nat-m-c2", "fi-nat-m-c3", "fi-nat-m-c4"), out, ck)
    assert state() == [*want[:3], ("fi-nat-m-c3", "m1", None, 1.0), ("fi-nat-m-c4", "m1", None, 0.5)]

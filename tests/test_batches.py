"""B1 calls of like length, B3 with the bytes of recordings."""

import os
import random

from pyspark.sql import functions as F


def test_calls_of_like_length_pad_less(spark):
    from tulkki.operators.infer import batch_map

    def padding(name):
        """Stand-in for a model that pads: each row's output is its text and the longest length of its call."""
        return lambda texts: [f"{t}|{max(len(x.split()) for x in texts)}" for t in texts]
    rng = random.Random(5)
    rows = [(i, f"m{i % 2}", " ".join("w" * rng.randrange(1, 4) for _ in range(rng.choice([1, 2, 3, 40, 200])))) for i in range(800)]
    df = spark.createDataFrame(rows, "id int, m string, t string").repartition(7)
    length = F.size(F.split("t", " "))
    padded, texts = {}, {}
    for name, how in {"as they come": {}, "by length": {"length": length}, "by model": {"model_col": "m"}, "by model and length": {"model_col": "m", "length": length}}.items():
        got = batch_map(df, padding, ["t"], "out", batch_size=8, **how).collect()
        texts[name] = sorted((r["id"], r["m"], r["out"].rsplit("|", 1)[0]) for r in got)
        padded[name] = sum(int(r["out"].rsplit("|", 1)[1]) - len(r["t"].split()) for r in got)
    assert all(t == sorted((i, m, t) for i, m, t in rows) for t in texts.values())
    assert padded["by length"] < padded["as they come"] / 10
    assert padded["by model and length"] < padded["by model"] / 5


def test_calls_keep_a_byte_budget():
    from tulkki.operators.infer import _calls
    rng = random.Random(1)
    rows = [b"x" * rng.choice([0, 1, 10, 99, 100, 250]) for _ in range(200)]
    calls = list(_calls(rows, 3, 190, 5, 100))
    assert [lo for lo, _ in calls] == [3, *[hi for _, hi in calls[:-1]]] and calls[-1][1] == 190
    for lo, hi in calls:
        assert 1 <= hi - lo <= 5 and (hi - lo == 1 or sum(map(len, rows[lo:hi])) <= 100)
    assert list(_calls(rows, 4, 4, 5, 100)) == [] and list(_calls([("ab", b"c")] * 3, 0, 3, 9, 6)) == [(0, 2), (2, 3)]


def test_recordings_of_unequal_size_stay_within_the_budget(spark, tmp_path):
    from tulkki.plans.jobs import transcribe_recordings
    sizes = {"fi/fi-nat-m-c1-1.wav": 9_000_000, "zz/unknown.wav": 50, "en/en-aks-n-c6-9.wav": 7, "en/notes.txt": 5}
    sizes |= {f"en/en-nat-m-c{1 + i % 6}-{i}.wav": 40_000 * (i % 13) + 1 for i in range(60)}
    for name, size in sizes.items():
        os.makedirs(os.path.dirname(f"{tmp_path}/{name}"), exist_ok=True)
        with open(f"{tmp_path}/{name}", "wb") as f:
            f.write(b"\x01" * size)

    def listening(model):
        def hear(recordings):
            total = sum(map(len, recordings))
            assert len(recordings) == 1 or total <= 1_000_000
            return [f"{model} {len(r)}" if len(r) != 7 else "" for r in recordings]
        return hear
    done = spark.createDataFrame([(f"file:{tmp_path}/fi/fi-nat-m-c1-1.wav", "parakeet")], "path string, asr_model string")
    good, bad = transcribe_recordings(spark, str(tmp_path), listening, done, batch_size=16, max_bytes=1_000_000)
    got = sorted((r["path"].split(str(tmp_path))[1][1:], r["asr_model"], r["text"]) for r in good.collect())
    models = {"fi": ["whisper_large_v2", "wav2vec2_xlsr_fi"], "en": ["whisper_large_v2", "wav2vec2_xlsr_en", "parakeet"]}
    assert got == sorted((n, m, f"{m} {s}") for n, s in sizes.items() if s != 7 and n.endswith(".wav") and n[:2] in models for m in models[n[:2]])
    reasons = sorted((r["path"].rsplit("/", 1)[-1], r["reject_reason"]) for r in bad.collect())
    assert reasons == [("en-aks-n-c6-9.wav", "empty_prediction")] * 3 + [("unknown.wav", "unknown_language")]
    assert "content" not in good.columns and "content" not in bad.columns
    assert "Exchange" not in spark.sparkContext._jvm.PythonSQLUtils.explainString(transcribe_recordings(spark, str(tmp_path), listening)[0]._jdf.queryExecution(), "simple")


def test_recordings_in_chunks_come_back_whole(spark):
    from tulkki.plans.jobs import transcribe_in_chunks

    def hearing(model):
        """Hears sample n as the words of n; mishears both ends of a chunk; fails on chunks with sample 5000."""
        def hear(chunks):
            if any(5000 in list(c) for c in chunks):
                raise RuntimeError("noise")
            return [" ".join("??" if i in (0, len(c) - 1) and len(c) > 1 else f"w{n}" for i, n in enumerate(c)) for c in chunks]
        return hear
    recs = {"long": list(range(500)), "short": [7], "empty": [], "bad": list(range(4990, 5003))}
    df = spark.createDataFrame(list(recs.items()), "rec string, samples array<int>")
    good, bad = transcribe_in_chunks(df, hearing, ["rec"])
    texts = {r["rec"]: r["text"] for r in good.collect()}
    assert texts == {"long": " ".join(["??", *[f"w{i}" for i in range(1, 499)], "??"]), "short": "w7"}
    assert [tuple(r) for r in bad.collect()] == [("bad", 0, 0, "model_error: RuntimeError")]


def test_outputs_of_long_inputs_go_on_in_pieces():
    """Calls stay as they are, but no more than about 4 MB of inputs waits for the rest of its batch."""
    import tracemalloc
    from tulkki.operators.infer import _calls, _pieces
    rows = [f"{i} " + "x" * 50_000 for i in range(400)]
    seen = []

    def predict(texts):
        seen.append(len(texts))
        return [t[::-1] for t in texts]

    tracemalloc.start()
    at = 0
    for start, end, outs, errs in _pieces(rows, (("m", *c) for c in _calls(rows, 0, 400, 8, None)), lambda name: predict):
        assert start == at and outs == [t[::-1] for t in rows[start:end]] and errs == [None] * len(outs)
        assert sum(map(len, outs)) <= (4 << 20) + 8 * 50_010
        at = end
        del outs
    assert at == 400 and seen == [8] * 50
    assert tracemalloc.get_traced_memory()[1] < 15e6
    tracemalloc.stop()

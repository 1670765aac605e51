"""Top-k search, mixing and archives against brute force and round trips."""

import base64
import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tulkki.llm.mixing import mix_sources, source_targets
from tulkki.llm.topk import top_k
from tulkki.llm.warc import read_archives, split_frames, write_archives


def brute_top(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable[i, tuple(math.floor(256 * x) for x in v)] = True
    out = []
    for q, y in usable:
        if q % every == 0:
            scored = {(-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, x in usable if i != q and len(x) == len(y)}
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("bits", "block", "queries", "at_once"), [(8, 2048, 256, 64), (2, 7, 3, 2), (5, 16, 5, 1)])
def test_top_k_is_brute_force(spark, bits, block, queries, at_once):
    rng = random.Random(bits)
    vectors = [[rng.choice([-0.5, 0.25, 0.0, rng.gauss(0, 0.4)]) for _ in range(6)] for _ in range(60)]
    rows = [(i * 3 % 211, vectors[rng.randrange(len(vectors))]) for i in range(200)]
    rows = list({i: (i, v) for i, v in rows}.values())
    rows += [(600 + i, vectors[0]) for i in range(40)]  # one common vector
    rows += [(700, None), (705, [0.1, None, 0.0, 0.0, 0.0, 0.0]), (710, [float("nan")] * 6), (715, [float("inf")] + [0.0] * 5), (None, vectors[1]),
             (800, [1.0, 0.5]), (805, [0.5, -0.5]), (810, [0.25, 0.25]), rows[0], (900, [])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("key", "x", "q", "dims", "rank")})
    got = top_k(table, F.col("vec_id") % 5 == 0, 4, bits=bits, block=block, query_block=queries, blocks_at_once=at_once).collect()
    as_float = [(i, v and [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute_top(as_float, 4, 5)


def test_top_k_of_empty_tables(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert top_k(empty, F.col("vec_id") % 5 == 0).collect() == []
    one = spark.createDataFrame([(5, [1.0])], "vec_id long, embedding array<float>")
    assert top_k(one, F.col("vec_id") % 5 == 0).collect() == []
    assert top_k(one, F.lit(False)).collect() == []


def brute_targets(sizes, weights, share, most):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_targets_are_reshared_until_none_is_above(spark):
    rng = random.Random(4)
    for case in range(4):
        sizes = {rng.choice([None, "", "Z", "a", "é", "b", "src1", "src10", "src2"]): rng.randrange(0, 10 ** rng.randrange(1, 6)) for _ in range(3 + case * 2)}
        sizes["big"] = 50
        got = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (3, 1, 2), 1.5, 2.0).collect()
        want = brute_targets(sizes, (3, 1, 2), 1.5, 2.0)
        assert {r.source: pytest.approx(r.target) for r in got} == want


def test_mix_keeps_words_and_reruns_agree(spark, make_docs):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 90)), "en", rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(600)]
    rows += [(700, None, "en", "a"), (701, "", "en", "lone"), (None, "x y z", "en", "b"), rows[5], rows[5]]
    docs = make_docs(rows)
    got = mix_sources(docs, block=8).collect()  # three levels of the tree
    again = mix_sources(docs.repartition(5), block=8).collect()
    assert sorted(got, key=repr) == sorted(again, key=repr)
    assert len(got) == len(rows)
    taken, target, largest = defaultdict(int), {}, defaultdict(int)
    sizes = defaultdict(int)
    for r in got:
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
        sizes[r.source] += r.size
        assert r.copies >= math.floor(r.target / r.source_size + 1e-9) if r.size else r.copies == 0
    for s, words in taken.items():
        assert abs(words - target[s]) <= largest[s] / 2 + 1e-6
        assert next(r.source_size for r in got if r.source == s) == sizes[s]
    assert target == {s: pytest.approx(t) for s, t in brute_targets(dict(sizes), (3, 1, 2), 1.5, 2.0).items()}


def test_mix_is_fair(spark, make_docs):
    """Over many seeds, copies average to the asked fraction."""
    rows = [(i, " ".join(["w"] * (1 + i % 7)), "en", "ab"[i % 3 == 0]) for i in range(60)]
    total = defaultdict(float)
    for seed in range(30):
        for r in mix_sources(make_docs(rows), seed=seed, block=16).collect():
            total[r.source] += (r.copies - r.target / r.source_size) / 30
    for s, n in (("a", 40), ("b", 20)):
        assert abs(total[s]) / n < 0.12


def test_mix_of_empty_table(spark, make_docs):
    assert mix_sources(make_docs([(1, "x")]).where("doc_id < 0")).collect() == []


def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", rng.choice([f"<p>page {i} " + "text " * 50, "<p>shared</p>", "", None])) for i in range(120)]
    rows += [(7000, None, "é" * 4000), (None, "http://null", "<p>shared</p>"), (None, "http://n2", "alone"), (8000, "http://a\nb c", "x\r\n\r\ny"), rows[0], rows[0],
             (9000, "http://long", "z" * 300_000)]
    return rows, spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, digest string, revisit string")


def test_archives_round_trip(spark, tmp_path):
    rows, table = pages(spark)
    path = f"file://{tmp_path}/warc"
    write_archives(table, path, archive_bytes=60_000, dictionary_bytes=2048, sample_bytes=5_000)
    got = read_archives(spark, path).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(last.get(h or "", -1), -1 if i is None else i)
    seen = defaultdict(int)
    for r in got:
        if r.record_type == "response":
            payload = r.payload.decode()
            seen[payload] += 1
            assert (-1 if r.page_id is None else r.page_id) == last[payload]
            assert r.refers_to is None and r.payload_bytes == len(r.payload)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode()
    assert seen == dict.fromkeys(last, 1)
    by_digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): (h, i) for h, i in last.items()}
    for r in got:
        if r.record_type == "revisit":
            payload, i = by_digest[r.payload_digest]
            assert r.refers_to == i and r.payload_bytes == len(payload.encode()) and r.payload is None
    assert len({r.record_id for r in got}) == len(got)


def test_archives_are_plain_zstandard_frames(spark, tmp_path):
    _, table = pages(spark)
    write_archives(table, f"file://{tmp_path}/warc", archive_bytes=60_000, dictionary_bytes=2048, sample_bytes=50_000)
    files = [p.read_bytes() for p in (tmp_path / "warc").glob("part-*")]
    assert len(files) > 3
    for data in filter(None, files):
        assert data[:4] == b"\x5d\x2a\x4d\x18"
        size = int.from_bytes(data[4:8], "little")
        dictionary = zstandard.ZstdCompressionDict(data[8:8 + size])
        whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True).read()
        assert whole == b"".join(split_frames(data)) and whole.startswith(b"WARC/1.1\r\n")


def test_no_pages(spark, tmp_path):
    _, table = pages(spark)
    write_archives(table.where("page_id < 0"), f"file://{tmp_path}/none")
    assert read_archives(spark, f"file://{tmp_path}/none").collect() == []

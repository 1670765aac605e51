"""Substring, line and n-gram dedup against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from tulkki.llm.components import components
from tulkki.llm.line_dedup import PerfectHash, line_dedup
from tulkki.llm.ngram_jaccard import jaccard_components
from tulkki.llm.substring_dedup import substring_dedup
from tulkki.llm.words import Words, pieces

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def brute_substring(rows, k):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - k + 1):
                key = tuple(w[i:i + k])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        if d is not None:
            for i in range(len(w) - k + 1):
                if first[tuple(w[i:i + k])] < d:
                    gone[i:i + k] = b"\1" * k
        out.append((d, len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def corpus(words, seed, n=40):
    rng = random.Random(seed)
    shared = [words(rng, rng.randrange(6, 60)) for _ in range(5)]
    rows = []
    for d in range(n):
        parts = [words(rng, rng.randrange(0, 50), 30) if rng.random() < 0.5 else rng.choice(shared) for _ in range(rng.randrange(1, 4))]
        rows.append((d * 7 % n, " ".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, shared[0]), (None, None), rows[0], rows[0], (rows[1][0], shared[1]),
             (1003, "a " * 300), (1004, "a " * 200), (1005, "b\x0bc\x0cd\r" * 50), (1006, "é ü " * 80), (-5, shared[2] * 30)]
    return rows


def test_substring_dedup_is_brute_force(spark, make_docs, words):
    for seed, k, m in ((1, 6, 3), (2, 12, 5), (3, 5, 5), (4, 4, 1)):
        rows = corpus(words, seed)
        got = substring_dedup(make_docs(rows), k, m).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == brute_substring(rows, k)


def test_line_dedup_is_brute_force(spark, make_docs):
    rng = random.Random(5)
    pool = ["", " ", "Title", "title ", "\tTITLE\r", "x", "Ünder", "ünder", "foot\x0b", "line"]
    rows = [(i, "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own {i} {j}" for j in range(rng.randrange(0, 6)))) for i in range(30)]
    rows += [(100, None), (101, ""), (None, "Title\nx"), rows[3], rows[3], (102, "x\n" * 3000 + "end")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").encode().translate(LOWER)
    docs = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    bad = {k for k, n in docs.items() if n >= 10}
    assert bad
    want = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in bad]
        want.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    got = line_dedup(make_docs(rows), shard_keys=7, salts=3, carry=["lang", "size"])
    assert got.columns[-2:] == ["lang", "size"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    hashes[2500:] = hashes[:2500]  # equal hashes with other marks
    marks = np.arange(5000, dtype=np.uint32)
    table = PerfectHash.of(hashes, marks)
    assert sorted(table.index(hashes, marks)) == list(range(5000))
    assert len(PerfectHash.of(hashes[:0], marks[:0]).index(hashes[:3], marks[:3])) == 3


def shingles(text, k=5):
    w = (text or "").encode().translate(LOWER).split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    holders = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].add(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 80 * len(s | sets[j]):
                parent[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[find(i)].append(d)
    return sorted(((d, len(s), min(ids[find(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(9)}"
    return " ".join(w)


def test_jaccard_components_is_brute_force(spark, make_docs, words):
    for seed in (1, 2):
        rng = random.Random(seed)
        rows, line = [], words(rng, 9)
        for _ in range(12):
            base = words(rng, rng.choice([3, 6, 9, 40, 120, 300]))
            for _ in range(rng.randrange(1, 8)):
                rows.append((len(rows) * 31 % 997, line + edited(rng, base, rng.randrange(0, 1 + len(base.split()) // 16))))
        chain = words(rng, 100).split()
        rows += [(500 + i, " ".join(chain[i * 4:i * 4 + 70])) for i in range(8)]  # neighbours link, the ends don't
        rows += [(2000, None), (2001, ""), (2002, " "), (2003, "one two"), (2004, "ONE two"), (None, rows[0][1]), (None, "only here " * 9),
                 rows[4], rows[4], (2005, "z " * 500), (2006, "z " * 400)]
        # blocks of three: groups are compared in many cells
        got = jaccard_components(make_docs(rows), block=3 if seed == 2 else 512).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute_components(rows)


def test_bitmaps_bound_the_difference():
    import pyarrow as pa

    from tulkki.llm.ngram_jaccard import Bitmaps, parity
    rng = np.random.default_rng(1)
    sets = [rng.integers(0, 1 << 63, rng.integers(1, 400), dtype=np.uint64) for _ in range(30)]
    sets += [np.concatenate([s[:len(s) * 9 // 10], rng.integers(0, 1 << 63, 5, dtype=np.uint64)]) for s in sets]
    bits = Bitmaps(pa.array([parity(np.unique(s)) for s in sets], pa.binary()))
    x, y = np.triu_indices(len(sets), 1)
    apart = bits.apart(x, y)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    assert (apart <= real).all() and ((real - apart) % 2 == 0).all()
    assert (apart[(bits.words[x] == bits.words[y]) & (real > 300)] > 100).all()


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, x) for x in range(4000, 4090)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {(r.node, r.root) for r in got.collect()} == {(x, find(x)) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty_tables(spark, make_docs):
    empty = make_docs([(1, "x")]).where("doc_id < 0")
    for op in (substring_dedup, line_dedup, jaccard_components):
        assert op(empty).collect() == []


def test_words_are_ascii_space_runs():
    import pyarrow as pa
    texts = ["a  bb\x0bccc\x1fd", "", None, "é x y ", "A"]
    (lo, hi, data, offsets), = pieces(pa.array(texts), 1 << 20)
    w = Words(data, offsets)
    assert [bytes(data[s:e]) for s, e in zip(w.start, w.end, strict=True)] == [x for t in texts for x in (t or "").encode().split()]
    assert list(np.diff(w.first)) == [len((t or "").encode().split()) for t in texts]
    assert [p[:2] for p in pieces(pa.array(texts), 3)] == [(0, 1), (1, 3), (3, 4), (4, 5)] or len(list(pieces(pa.array(texts), 3))) >= 3

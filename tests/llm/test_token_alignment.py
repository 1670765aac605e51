"""Token alignment against a plain walk over byte offsets, with both libraries called directly."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
import tokenizers

from tulkki.llm.token_alignment import FOLDER, ByteTokenizer, _byte_alphabet, aligned_tokens, token_alignment

ODD = ["<|endoftext|> <s></s> <unk> <0x0A>", "a▁b", "▁", " two  spaces   and\ttabs\r\n\n\nlines ", "日本語のテキスト と English", "é ́combining  　 x", "\x00\x01 ctrl",
       "😀😀 don't we'll I'm 12345 6,789.0 ?!...", " ", "\n", "   ", "x", "ünïcödé " * 5, "a" * 300, "?" * 100 + " " * 50 + "z"]


@pytest.fixture(scope="module")
def both():
    a = tokenizers.Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")


def tokens(both, text):
    """(ids, byte ends) of both sides, or None."""
    a, b = both
    alphabet = _byte_alphabet()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    parts_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    names = [b.id_to_piece(i) for i in ids_b]
    parts_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names, strict=True)]
    if not b"".join(parts_a) == (" " + text).encode() == b"".join(parts_b):
        return None
    ends = []
    for parts in (parts_a, parts_b):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        ends.append(out)
    return ids_a, ids_b, *ends


def brute(both, rows):
    found, links = [], Counter()
    for _, text in rows:
        t = tokens(both, text) if text else None
        mine, groups = [], []
        if t:
            ids_a, ids_b, ends_a, ends_b = t
            common = sorted(set(ends_a) & set(ends_b))
            last = 0
            for c in common:
                groups.append(",".join(str(i) for i, e in zip(ids_a, ends_a, strict=True) if last < e <= c) + "|"
                              + ",".join(str(i) for i, e in zip(ids_b, ends_b, strict=True) if last < e <= c))
                mine.append((ids_a[ends_a.index(c)], ids_b[ends_b.index(c)]))
                last = c
        links.update(mine)
        found.append((t, groups, mine))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (t, groups, mine) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if t else ""
        out.append((doc_id, len(t[0]) if t else 0, len(t[1]) if t else 0, len(groups), len(mine), digest,
                    sum(links[p] == most[p[1]] for p in mine), sum(links[p] for p in mine)))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]


def result(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(7)
    vocabulary = ["the", "quick", "Straße", "naïve", "don't", "3.14", "emoji😀", "日本", "x▁y", "ALLCAPS", "(brackets)", "hyphen-ated", "internationalisation"]
    mixed = [rng.choice(["", " "]).join(rng.choice(vocabulary[:8]) + rng.choice([" ", " ", "\n", "  ", ", "]) for _ in range(rng.randrange(1, 60))) for _ in range(25)]
    return ODD + mixed + [mixed[0]] * 5 + [" ".join(rng.choices(vocabulary, k=20))]


@pytest.mark.parametrize("stretch,block_pairs", [(1 << 18, 1 << 20), (10, 40)])
def test_matches_plain_walk(spark, make_docs, both, stretch, block_pairs):
    rows = [*enumerate(texts()), (None, "no id"), (None, None), (900, None), (901, ""), (902, "twice"), (902, "twice")]
    got = token_alignment(make_docs(rows).repartition(3), stretch=stretch, block_pairs=block_pairs)
    assert result(got) == brute(both, rows)


def test_overlaps_are_all_pairs_that_meet(spark, make_docs, both):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in aligned_tokens(make_docs(rows), stretch=64).collect()}
    for doc_id, text in rows:
        t, r = tokens(both, text), got[doc_id]
        if t is None:
            assert not r["a_ids"] and not r["b_ids"] and not r["overlaps"] and not r["groups"]
            continue
        ids_a, ids_b, ends_a, ends_b = t
        spans_a, spans_b = (list(zip([0, *e], e, strict=False)) for e in (ends_a, ends_b))
        assert (r["a_ids"], r["b_ids"]) == (ids_a, ids_b)
        assert [tuple(p) for p in r["overlaps"]] == [(i, j) for i, (s, e) in enumerate(spans_a) for j, (u, v) in enumerate(spans_b) if s < v and u < e]
        assert [tuple(p) for p in r["groups"]] == [(ends_a.index(c), ends_b.index(c)) for c in sorted(set(ends_a) & set(ends_b))]


def test_a_long_text(spark, make_docs, both):
    rows = [(1, "some words that go on, 日本 and on. " * 30_000), (2, "x" * 200_000)]
    got = {r["doc_id"]: r for r in token_alignment(make_docs(rows)).collect()}
    t = tokens(both, rows[0][1])
    assert (got[1]["n_a"], got[1]["n_b"], got[1]["n_groups"]) == (len(t[0]), len(t[1]), len(set(t[2]) & set(t[3])))
    assert got[2]["n_a"] == len(tokens(both, rows[1][1])[0])


def test_no_rows(spark, make_docs):
    df = token_alignment(make_docs([]))
    assert df.columns == COLUMNS and df.count() == 0


def test_both_libraries_agree_where_merges_are_ranked(both):
    own = ByteTokenizer(open(f"{FOLDER}/byte_bpe_50k.json", "rb").read())
    assert own._ranked is not None
    strings = [" " + t for t in texts()]
    assert own.encode(strings) == [both[0].encode(t, add_special_tokens=False).ids for t in strings]

"""Exact dedup by radix partitioning against a dictionary of normalised texts."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tulkki.llm.exact_dedup import exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        for at, i in enumerate(sorted(ids, key=lambda x: (x is None, x))):
            out.append((i, keep, len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def texts(rng):
    base = "".join(rng.choice("abc \n\t") for _ in range(700))
    long = base * 300
    rows = ["", None, " ", "\n \t", "x", "x ", " x", "x y", "x y", "é" * 40, "é" * 41, base, base + "!", base.replace(" ", "\t\r\n"),
            base[:64], base[:63], base[:65], long, long + "a", long + "b", long.replace("\n", " ")]
    return [(i, t) for i, t in enumerate(rows + rng.choices(rows, k=60))]


@pytest.mark.parametrize("first,growth,most_bytes", [(64, 8, 32 << 20), (1, 2, 32 << 20), (7, 3, 0), (16, 4, 400)])
def test_matches_brute_force(spark, make_docs, first, growth, most_bytes):
    rows = texts(random.Random(first))
    random.Random(1).shuffle(rows)
    assert result(exact_dedup(make_docs(rows).repartition(5), first, growth, most_bytes)) == brute(rows)


def test_null_and_repeated_ids(spark, make_docs):
    rows = [(None, "a b"), (None, "a  b"), (3, "a\nb"), (None, "z"), (None, "z"), (5, "q"), (5, "q"), (5, "other"), (None, None), (2, "")]
    assert result(exact_dedup(make_docs(rows))) == brute(rows)


def test_one_copied_text_on_a_third_of_the_rows(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, "the same passage of some length " * 20 if i % 3 == 0 else f"text {rng.random()}") for i in range(3000)]
    got = result(exact_dedup(make_docs(rows).repartition(8), most_bytes=5000))
    assert got == brute(rows)
    assert sum(kept for _, _, n, kept, _ in got if n > 1) == 1


def test_no_rows(spark, make_docs):
    df = exact_dedup(make_docs([]))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and df.count() == 0

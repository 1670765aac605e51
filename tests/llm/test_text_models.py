"""Language identification, decontamination, licences and quality."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tulkki.llm.decontaminate import contaminated, marked, template
from tulkki.llm.language_id import cut, fit, held_out_fold, identify, train
from tulkki.llm.licenses import scan
from tulkki.llm.quality import grams, quality

SMALL = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("held_out", held_out_fold())
    got = identify(docs, fit(docs.where("NOT held_out"), per_lang=200, epochs=4), ["doc_id", "lang", "held_out"]).where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark, make_docs):
    rows = [(1, "der die das und nicht " * 30, "de", "s"), (2, "the and of to " * 30, "en", "s"), (6, "the of", None, "s")]
    net = fit(make_docs(rows), window=32, epochs=30)
    odd = [(3, None), (4, ""), (5, "123 $$ \n"), (None, "the and of"), (7, "die und das"), (7, "die und das"), (8, "the of and to " * 20000)]
    got = {(r.doc_id, r.lang_pred) for r in identify(make_docs(odd), net, ["doc_id", "tag"]).collect()}
    assert got == {(3, "und"), (4, "und"), (5, "und"), (None, "en"), (7, "de"), (8, "en")}
    assert fit(make_docs(odd).where("doc_id < 0")) is None
    assert {r.lang_pred for r in identify(make_docs(odd), None, ["doc_id"]).collect()} == {"und"}
    assert identify(make_docs(odd).where("doc_id < 0"), net, ["doc_id"]).collect() == []


def test_lookup_is_the_network():
    net = train(["abcd efgh " * 20, "ijkl mnop " * 20], ["a", "b"], 40, 5, 4, 3, 1)
    windows = np.random.default_rng(1).integers(0, 256, (50, 40)).astype(np.uint8)
    response, _ = net.responses(windows)
    plain = np.maximum(response.max(axis=1) + net.bias, 0) @ net.out + net.out_bias
    assert np.allclose(plain, net.lookup().logits(windows), atol=1e-4)


def test_windows_cover_whole_texts():
    texts = [b"", b"abc", b"abcdefgh", b"abcdefghi"]
    offsets = np.cumsum([0, *map(len, texts)])
    windows, row = cut(np.frombuffer(b"".join(texts), np.uint8), offsets, 4)
    assert [b"".join(w.tobytes() for w in windows[row == i]).rstrip(b"\0") for i in range(4)] == texts


def test_template_marks_slots(spark):
    texts = ["Alice has 3 apples and Bob walks 5 km.", "Yesterday Carol paid $1,200.50 for 7.5 kg of rice", "END. Next mp3 X2 10%", None]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    got = [r[0] for r in df.select(template(F.col("t"))).collect()]
    assert got == ["alice has \1 apples and \2 walks \1 \3", "yesterday \2 paid \1 for \1 \3 of rice", "end next mp3 x2 \1", None]
    assert df.select(marked(F.col("t"))).first()[0] == "alice has \x013 apples and \x02bob walks \x015 \x03km"


ITEM = "A train leaves the station with Alice and Alice sees 40 cars in front of a long red bridge while 25 birds fly over 40 cars"


def benchmark(spark):
    rows = [(1, ITEM), (2, "short one here"), (3, None), (4, "what is the usual name of that green fruit"), (None, "people often ask what makes the ocean look blue at noon"),
            (1, ITEM)]
    return spark.createDataFrame([(*r, "x") for r in rows], "item_id long, text string, hash string")


def test_contaminated_documents_are_found(spark, make_docs, words):
    rng = random.Random(1)
    other = ITEM.replace("Alice", "Bob").replace("40", "77").replace("25", "3")
    wrong = ITEM.replace("Alice sees", "Carol sees").replace("40", "77", 1)
    rows = [(1, words(rng, 50) + " " + ITEM), (2, other.upper().replace("BOB", "Bob")), (3, other + " " + words(rng, 900)), (4, wrong), (5, words(rng, 300)),
            (6, "so What is the usual name of that green fruit?"), (7, "what is the usual thing"), (8, None), (9, ""), (10, "short one here"),
            (None, "people often ask, what makes the ocean look blue at noon"), (1, words(rng, 50)), (3, other), (3, other)]
    found = contaminated(make_docs(rows), benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 1), (2, 1), (3, 1), (6, 4), (None, None)}
    assert max(r.slots for r in found if r.doc_id == 3) == 3
    assert contaminated(make_docs(rows), benchmark(spark).where("item_id < 0")).collect() == []
    assert contaminated(make_docs(rows).where("doc_id < 0"), benchmark(spark)).collect() == []


def test_items_of_slots_and_short_items_are_found(spark, make_docs, words):
    items = ["What is 12 + 30 + 45?", "Compute 12 + 7 - 3 + 45 - 6 + 8 - 9.", "小明有三个苹果，他又买了两个，现在一共有几个苹果？",
             "Sort the scores Ann 3, Bob 7, Eve 9, Tom 4, Kim 8, Joe 6 from low to high.", "Janet eats 16 eggs every day"]
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 40)} {item} {words(rng, 40)}") for i, item in enumerate(items)]
    rows += [(5, "What is 13 + 30 + 45?"), (6, "Compute 12 + 7 - 3 + 45 - 6 + 8 - 8."), (7, "Sort the scores Jim 1, Bob 2, Sue 3, Tom 5, Max 8, Joe 9 from low to high."),
             (8, "Every morning Paul eats 4 eggs every day"), (9, "so it is. Paul eats 4 eggs every day"), (10, "Janet drinks 16 eggs every day"), (11, "小明有三个苹果")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contaminated(make_docs(rows), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 4), (7, 3), (8, 4), (9, 4)}


def test_copies_in_other_case_or_spacing_are_found(spark, make_docs, words):
    item = "Yesterday morning Carol bought 40 red apples and then Alice ate 12 of them, 5 kg, before lunch with Bob"
    copies = [item, item.lower(), item.upper(), item.title(), item.replace(" Alice", "\nAlice").replace(" kg", "\n kg"), item.replace(" ", "  "),
              "\n".join(item.split()), item.replace(" ", "\u00a0"), item.lower().replace("40", "41")]
    wrong = item.lower().replace("carol", "dora").replace("apples", "pears").replace("ate", "sold")
    rng = random.Random(4)
    rows = [(i, f"{words(rng, 40)} {text} {words(rng, 40)}") for i, text in enumerate([*copies, wrong])]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {r.doc_id for r in contaminated(make_docs(rows), bench).collect()} == set(range(len(copies)))


def test_contamination_is_that_of_verbatim_items(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    flat = lambda t: " " + " ".join((t or "").split()) + " "
    items = [(r.item_id, flat(r.text)) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items if t.strip() in flat(r.text)}
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert want and got == want


def test_licences(spark, make_docs, words):
    rng = random.Random(3)
    plain = [(i, "the house of this work is under the hill.\n" + words(rng, 80)) for i in range(100, 160)]
    rows = [(1, words(rng, 30) + "\nReleased under the MIT License.\n" + words(rng, 30)), (2, "Licensed under the Apache License, Version 2.0. " + words(rng, 40)),
            (3, None), (4, ""), (5, "..."), (None, "All rights reserved."), (6, "This work is licensed under the GNU General Public License, version 3."),
            (6, "This work is licensed under the GNU General Public License, version 3."), (7, "Licensed under CC BY-NC 4.0." + "\nword" * 4000)]
    got = {(r.doc_id, r.family) for r in scan(make_docs(rows + plain)).collect()}
    assert got == {(1, "mit"), (2, "apache"), (None, "proprietary"), (6, "gpl"), (7, "cc-by-nc")}
    assert scan(make_docs(rows).where("doc_id < 0")).collect() == []


WRAPPED = {
    "mit": """# Permission is hereby granted, free of charge, to any person obtaining a copy
# of this software and associated documentation files (the "Software"), to deal
# in the Software without restriction.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "gpl": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "apache": """Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""}


def test_wrapped_notices_get_their_family(spark, make_docs, words):
    rng = random.Random(8)
    plain = [(i, "Some prose goes before.\n" + words(rng, 80)) for i in range(100, 160)]
    rows = [(i, f"Title of the file\n\n{notice}\n\n{words(rng, 40)}") for i, notice in enumerate(WRAPPED.values())]
    got = {(r.doc_id, r.family) for r in scan(make_docs(rows + plain)).collect()}
    assert {(i, family) for i, family in enumerate(WRAPPED)} <= got
    assert {d for d, _ in got} <= set(range(len(WRAPPED)))


def brute_perplexity(trusted, text, order):
    """Interpolated modified Kneser-Ney straight from its definition."""
    counts = {order: Counter()}
    for t in trusted:
        b = bytes(order - 1) + t.encode()
        counts[order].update(b[i:i + order] for i in range(len(b) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts = {}
    for k, table in counts.items():
        n = Counter(min(c, 5) for c in table.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else None
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else None
            discounts[k, i] = d if d is not None and 0 < d < i else i / 2

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        followers = {x: c for x, c in counts[k].items() if x[:-1] == g[:-1]}
        if not followers:
            return p(g[1:])
        cut_off = {x: discounts[k, min(c, 3)] for x, c in followers.items()}
        total = sum(followers.values())
        return (followers[g] - cut_off[g] if g in followers else 0) / total + sum(cut_off.values()) / total * p(g[1:])
    b = bytes(order - 1) + text.encode()
    logs = [math.log(p(b[i:i + order])) for i in range(len(b) - order + 1)]
    return math.exp(-sum(logs) / len(logs))


def test_perplexity_is_kneser_ney(spark, make_docs):
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(["aba", "cab", "bé", "d"]) for _ in range(rng.randrange(1, 9))) for i in range(40)}
    rows = [(i, t, "en" if i % 4 else "fr", "s") for i, t in texts.items()]
    rows += [(100, None), (101, ""), (102, "zzz", None, "s"), (None, "aba cab", "fr", "s"), (103, "abc" * 3000), (5, rows[5][1], "en", "s")]
    labels = [(i, 1, 0) for i in range(30)] + [(3, 0, 0), (7, 1, 1), (8, None, 0), (9, 1, None), (None, 1, 0), (100, 1, 0)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    fold = {r.doc_id for r in docs.where(held_out_fold()).collect()}
    trusted = {i for i in range(30)} - {3, 7, 8}
    learn = defaultdict(list)
    for i, t, lang, *_ in [(*r, "en") if len(r) == 2 else r for r in rows]:
        if i in trusted and i not in fold:
            learn[lang].append(t or "")
    got = quality(docs, table, order=3, block_bytes=200).collect()
    assert len(got) == len(rows)
    for (i, t, *rest), r in zip(sorted(rows, key=repr), sorted(got, key=lambda r: next(repr(x) for x in rows if x[0] == r.doc_id)), strict=True):
        lang = rest[0] if rest else "en"
        if not t:
            assert r.perplexity is None and not r.keep
        elif lang is None:
            assert r.threshold is None and r.keep
        else:
            assert r.perplexity == pytest.approx(brute_perplexity(learn[lang], t, 3)), i
            assert r.keep == (r.perplexity <= r.threshold)


def test_quality_of_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "abc"), (2, None)])
    assert {(r.doc_id, r.keep, r.threshold) for r in quality(docs, none).collect()} == {(1, True, None), (2, False, None)}
    assert quality(docs.where("doc_id < 0"), none).collect() == []


def test_quality_separates_labelled_documents(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in got}
    assert kept[1] > 0.97 and kept[0] < 0.2


def test_threshold_is_the_quantile_of_held_out_trusted_documents(spark, make_docs, words):
    rng = random.Random(8)
    rows = [(i, words(rng, 40)) for i in range(300)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    docs = make_docs(rows)
    fold = {r.doc_id for r in docs.where(held_out_fold()).collect()}
    got = quality(docs, labels, order=2, quantile=0.5).collect()
    unseen = sorted(r.perplexity for r in got if r.doc_id in fold)
    assert len(unseen) > 10 and {r.threshold for r in got} <= set(unseen)
    assert sum(x <= got[0].threshold for x in unseen) == pytest.approx(len(unseen) / 2, abs=1)


def test_grams_begin_after_zeros():
    texts = [b"abc", b"", b"xy"]
    key, row = grams(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), 3)
    want = [(i, (bytes(2) + t)[j:j + 3]) for i, t in enumerate(texts) for j in range(len(t))]
    assert [(r, int(k).to_bytes(3, "big")) for r, k in zip(row, key, strict=True)] == want

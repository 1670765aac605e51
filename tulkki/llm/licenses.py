"""Licence scan: a trained passage classifier confirmed by templates, in DataFrame functions only.

Texts are cut into passages at line breaks and sentence ends; where a line
goes on in the next, as in a notice wrapped to a width, the paragraph is
joined again and its sentences are passages too.  A multinomial
logistic regression over sparse word n-grams gives each passage a family or
"none".  It is trained on the notices below, shortened and joined with
ordinary words in many ways, against passages of a bounded sample of
documents that resemble no notice.  The least probability that counts is
calibrated on passages kept out of training, of all documents.  A family is
then confirmed by
the share of a notice's words found in the passage; what looks like a
licence without being confirmed is "unknown".
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StringIndexer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tulkki.llm.columns import let
from tulkki.llm.store import materialise

NONE, UNKNOWN = "none", "unknown"

# Usual short notices of licence families.
NOTICES = {
    "apache": ["Licensed under the Apache License, Version 2.0.",
               "This software is released under the Apache License version 2.0",
               "you may not use this file except in compliance with the License",
               "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
               "SPDX-License-Identifier: Apache-2.0"],
    "mit": ["Released under the MIT License.", "This project is licensed under the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "Licensed under the terms of the MIT License", "SPDX-License-Identifier: MIT"],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Released under the 2-clause BSD license",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "SPDX-License-Identifier: BSD-3-Clause"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "Licensed under the GNU GPL v3", "Released under the GPL version 2 or later", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL version 3",
             "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0",
            "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License",
              "Available under the Creative Commons Attribution License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
                 "Text is available under the Creative Commons Attribution-ShareAlike License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
                 "Licensed under CC BY-NC-ND 4.0"],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain",
                      "No rights reserved", "Released under the Unlicense"],
    "proprietary": ["All rights reserved.", "Copyright 2020 the authors. All rights reserved",
                    "No part of this publication may be reproduced without the prior written permission of the publisher",
                    "Unauthorized copying of this file is strictly prohibited"],
}


# A line break within a sentence: nothing ends before it, and a small letter, a digit or a bracket follows, perhaps behind the sign of a comment.
JOINT = "\x01"
WRAPPED = r"(?<=[^.!?:\s])[ \t\r]*\n[ \t]*(?:[#*;%]+|//+|--)?[ \t]*(?=[\p{Ll}\p{N}(\[\"'])"
ENDS = r"\n|(?<=[.!?])[ \t\r\x0b\x0c]+(?=[^\p{Ll}]|$)"
#: Words of licences: a passage with one tells nothing about passages that are none.
LEGAL = r"(?i)licen[cs]|copyright|rights reserved|public domain|permission"


def passages(text: Column) -> Column:
    """Lines and their sentences, and the sentences of wrapped lines joined again."""
    lines = F.split(text, r"\n|(?<=[.!?])[ \t\r\x0b\x0c]+")

    def whole(joined: Column) -> Column:
        some = F.transform(F.filter(F.split(joined, ENDS), lambda p: F.contains(p, F.lit(JOINT))), lambda p: F.translate(p, JOINT, " "))
        return F.when(F.contains(joined, F.lit(JOINT)), some).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, let(F.regexp_replace(F.translate(text, JOINT, " "), WRAPPED, JOINT), whole))


def terms(text: Column, n: int = 3) -> Column:
    """The distinct word 1- to ``n``-grams of a passage."""
    return let(_words(text), lambda w: _grams(w, n))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _grams(w: Column, n: int) -> Column:
    def of(k: int) -> Column:
        each = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) >= k, each).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(w, *[of(k) for k in range(2, n + 1)]))


def known_terms(text: Column, vocabulary: list[str], n: int = 3) -> Column:
    """Those of the ``terms`` of a passage whose words all are in the vocabulary.

    Terms of the vocabulary have no other words, so a model sees the same
    features; of ordinary text, hardly any n-gram has to be put together."""
    single = sorted({w for term in vocabulary for w in term.split(" ")})

    def grams(m: Column) -> Column:
        def of(k: int) -> Column:
            starts = F.filter(F.sequence(F.lit(0), F.size(m) - k), lambda i: F.forall(F.slice(m, i + 1, k), lambda x: x.isNotNull()))
            each = F.transform(starts, lambda i: F.array_join(F.slice(m, i + 1, k), " "))
            return F.when(F.size(m) >= k, each).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.filter(m, lambda x: x.isNotNull()), *[of(k) for k in range(2, n + 1)]))

    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    some = F.array().cast("array<string>")
    # most passages have no such word at all
    return let(F.transform(words, lambda w: F.when(w.isin(single), w)),
               lambda m: F.when(F.exists(m, lambda x: x.isNotNull()), grams(m)).otherwise(some))


def notices(spark: SparkSession) -> DataFrame:
    """(family, notice) from the table above."""
    rows = [F.struct(F.lit(family).alias("family"), F.lit(text).alias("notice")) for family, texts in NOTICES.items() for text in texts]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def likeness(passage_terms: Column) -> Column:
    """Map from family to the largest share of one of its notices' one- and two-word terms found in a passage."""
    def best(texts: list[str]) -> Column:
        shares = []
        for text in texts:
            w = re.findall(r"[a-z0-9]+", text.lower())
            own = sorted({*w, *map(" ".join, zip(w, w[1:], strict=False))})
            shares.append(F.size(F.array_intersect(passage_terms, F.array(*map(F.lit, own)))) / len(own))
        return F.greatest(*shares)
    return F.create_map(*[x for family, texts in NOTICES.items() for x in (F.lit(family), best(texts))])


def train(docs: DataFrame, sample_docs: int = 400, seed: int = 11) -> tuple[PipelineModel, StringIndexerModel]:
    """The model and the names of its classes.

    Learns from the notices and from passages of ``sample_docs`` documents, the
    smallest by a hash of text, but for those that ``kept_out`` tells."""
    spark = docs.sparkSession
    usable, order, parts = docs.where("text IS NOT NULL").select("text"), F.xxhash64(F.lit(seed), "text"), 1 << 30
    total = usable.count()
    # about twice as many pass the hash threshold, so that the sort sees no more than that of any corpus
    passing = usable.where(F.lit(total <= 4 * sample_docs) | (F.pmod(order, F.lit(parts)) < 2 * sample_docs * parts // max(1, total)))
    sample = passing.orderBy(order, "text").limit(sample_docs)
    plain = sample.select(F.explode(passages(F.col("text"))).alias("passage")).distinct().withColumn("terms", terms(F.col("passage"), 3)).where(F.size("terms") > 0)
    plain = plain.where(F.array_max(F.map_values(likeness(F.col("terms")))) < 0.5)
    plain = plain.select("terms", F.lit(NONE).alias("family"), kept_out(F.col("passage")).alias("kept_out"))
    # notices in full, and with either end cut off or ordinary words around them
    cut = notices(spark).select("family", F.explode(F.array(_words(F.col("notice")))).alias("w"))
    around = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.concat(F.lit("filler"), i.cast("string")))
    shapes = [F.col("w"), F.concat("w", around), F.concat(around, "w")]
    shapes += [F.slice("w", 1, F.ceil(F.size("w") * 0.8).cast("int")), F.slice("w", F.floor(F.size("w") * 0.2).cast("int") + 1, F.size("w"))]
    known = reduce(DataFrame.unionByName, [cut.select(let(s, lambda w: _grams(w, 3)).alias("terms"), "family") for s in shapes])
    known = known.withColumn("kept_out", F.lit(False))
    known = materialise(known, "notices")
    # a bounded table: few tasks for each step of the fit
    every = known.unionByName(materialise(plain, "plain")).coalesce(2).cache()
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", binary=True, vocabSize=1 << 14, minDF=1).fit(known)
    names = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc").fit(every)
    learn = names.transform(every.where("NOT kept_out"))
    # as many effective passages without a licence as with one
    n_known, n_all = learn.where(F.col("family") != NONE).count(), learn.count()
    weight = F.when(F.col("family") == NONE, F.lit(n_known / max(1, n_all - n_known))).otherwise(1.0)
    fitted = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=40, regParam=1e-3, tol=1e-4,
                                family="multinomial").fit(vocabulary.transform(learn.withColumn("weight", weight)))
    model = PipelineModel([vocabulary, fitted])
    every.unpersist()
    return model, names


def kept_out(passage: Column) -> Column:
    """A quarter of all passages, by their words' hash: training sees the others."""
    return F.pmod(F.xxhash64(passage), F.lit(4)) == 0


def scan(docs: DataFrame, share: float = 0.7, quantile: float = 0.9995) -> DataFrame:
    """Licence passages: (doc_id, family, probability, likeness, passage).

    One row for each distinct passage of a document that is probably a licence.
    The least probability that counts, a half at least, is the ``quantile`` of
    the passages of all documents that are kept out of training, resemble no
    notice and have no word of licences; it is observed while the passages are
    scored.  ``family`` is "unknown" where the passage has less than ``share`` of the one-
    and two-word terms of each notice of the predicted family.  Null, empty
    and wordless texts give none; null doc_ids are kept as ids; rows repeated
    with doc_id and text give their passages once.  Other columns are left
    out; an empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    model, names = train(docs)
    rows = (docs.where("text IS NOT NULL").select("doc_id", F.explode(F.array_distinct(passages(F.col("text")))).alias("passage"))
            .withColumn("terms", known_terms(F.col("passage"), model.stages[0].vocabulary)))
    scored = model.transform(rows).select("doc_id", "passage", "terms", vector_to_array("probability").alias("p"))
    listed = F.array(*[F.lit(x) for x in names.labels])
    families = F.filter(F.arrays_zip(listed.alias("family"), F.col("p").alias("p")), lambda x: x["family"] != NONE)
    some = 1 - F.get("p", F.lit(names.labels.index(NONE))) if NONE in names.labels else F.lit(1.0)
    scored = scored.withColumn("some", some)
    plain = kept_out(F.col("passage")) & ~F.col("passage").rlike(LEGAL) & F.when(F.col("some") < 0.5, True).otherwise(F.array_max(F.map_values(likeness(F.col("terms")))) < 0.5)
    seen = Observation()
    scored = scored.observe(seen, F.percentile_approx(F.when(plain, F.col("some")), quantile, 10000).alias("least"))
    best = F.array_max(F.transform(families, lambda x: F.struct(x["p"].alias("p"), x["family"].alias("family"))))
    likely = materialise(scored.where("some >= 0.5").select("doc_id", "passage", "terms", "some", best["family"].alias("family")), "likely")
    least = seen.get["least"] or 0.5
    shared = F.coalesce(F.element_at(likeness(F.col("terms")), F.col("family")), F.lit(0.0))
    return (likely.where(F.col("some") >= least).withColumn("shared", shared)
            .select("doc_id", F.when(F.col("shared") >= share, F.col("family")).otherwise(UNKNOWN).alias("family"),
                    F.col("some").alias("probability"), F.col("shared").alias("likeness"), "passage").distinct())


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.groupBy("doc_id", "family").agg(F.count("*").alias("n_passages"), F.max("probability").alias("probability"),
                                                 F.max("likeness").alias("likeness"))

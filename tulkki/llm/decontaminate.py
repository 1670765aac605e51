"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, units after numbers, and names (capitalised words inside a sentence)
are replaced by typed placeholders, the rest is lower-cased without
punctuation.  Windows of the resulting template are hash-joined with those of
the benchmark, so that a question comes out even with other numbers or names.
Windows that are mostly slots are hashed with their values.  A second template
leaves names as lower-cased literals, so that a copy in other case comes out.
A match counts where its windows line up along one offset and the slots are
consistent: within the match, one benchmark value stands for one document
value and the other way round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tulkki.llm.columns import let
from tulkki.llm.store import broadcast_if_few, materialise

# Unit words that may follow a number.
UNITS = ("mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
         "g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons "
         "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
         "mph kph percent degrees dollar dollars cent cents euro euros pence usd eur gbp").split()

# OPENING: a capitalised word that may be a name, as one that opens a sentence; it is a literal but where an item begins.
NUMBER, NAME, UNIT, OPENING = "\x01", "\x02", "\x03", "\x04"
MARKS = f"{NUMBER}-{UNIT}"
#: A benchmark of more distinct words is searched without a look at its vocabulary first, with the same result.
MOST_WORDS = 50_000
# The patterns below begin with a test that most characters fail at once.
# Scripts written without spaces, all of them from U+0E00 on: each character is a word.
UNSPACED = r"[\x{E00}-\x{10FFFF}&&[" + "".join(rf"\p{{Is{s}}}" for s in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar")) + "]]"
# White space, but for a single space.
GAPS = r"(?![a-zA-Z])(?:[\s\x85\p{Z}]{2,}|[\s\x85\p{Z}&&[^ ]])"
UNIT_AFTER = rf"(?i)(?<=\d )(?:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"
NUMBERS = r"(?=[$€£\d])(?<![\p{L}\p{N}])[$€£]?\d[\d.,]*%?"
NAMES = r"(?![a-z ])(?=\p{Lu})(?<=[\p{L}\p{N},;)] )\p{Lu}[\p{Ll}']+(?![\p{L}\p{N}])"
OPENINGS = rf"(?![a-z ])(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}{MARKS}])\p{{Lu}}[\p{{Ll}}']+(?![\p{{L}}\p{{N}}])"


def typed(text: Column) -> Column:
    """The words of a text, those in slots and openings led by the mark of their type."""
    text = F.regexp_replace(text, f"[{NUMBER}-{OPENING}]", " ")
    text = F.regexp_replace(F.regexp_replace(text, UNSPACED, " $0 "), GAPS, " ")
    for pattern, mark in ((UNIT_AFTER, UNIT), (NAMES, NAME), (NUMBERS, NUMBER), (OPENINGS, OPENING)):
        text = F.regexp_replace(text, pattern, f"{mark}$0")
    text = F.regexp_replace(F.lower(text), rf"[^a-z \p{{L}}\p{{N}}\s{NUMBER}-{OPENING}]+", "")
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def marked(text: Column) -> Column:
    """The words of a text, those in slots led by the mark of their type."""
    return F.translate(typed(text), OPENING, "")


def template(text: Column) -> Column:
    """Words with every slot's value dropped."""
    return F.regexp_replace(marked(text), rf"([{MARKS}])\S+", "$1")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_slot(w: Column) -> Column:
    return w < OPENING


def plain(w: Column) -> Column:
    """A typed word without its mark as a name or an opening."""
    return F.ltrim(w, F.lit(NAME + OPENING))


def symbol(w: Column) -> Column:
    """A typed word without its slot's value."""
    return F.when(is_slot(w), F.substring(w, 1, 1)).otherwise(plain(w))


def is_name(w: Column) -> Column:
    return w.startswith(NAME)


def caseless(w: Column) -> Column:
    """A typed word without its slot's value, but names are literals."""
    return F.when(is_slot(w) & ~is_name(w), F.substring(w, 1, 1)).otherwise(plain(w))


def windows(w: Column, n: Column | int, vocabulary: list[str] | None = None) -> Column:
    """(at, hash) of every ``n`` consecutive typed words, in an array: that of
    their symbols; where one is a name, that with names as literals as well; where
    more than half are slots, that of their values; where the first is an
    opening, also that with it as a name.

    With a ``vocabulary`` only windows whose literals all are in it are
    hashed: the others can't equal one of a text that has no other words."""
    hashes = lambda of: F.transform(w, lambda x: F.xxhash64(of(x)))
    row = lambda i, h: F.struct((i - 1).alias("at"), h.alias("hash"))
    none = F.array().cast("array<struct<at: int, hash: bigint>>")
    slots = F.transform(w, is_slot)
    named = F.xxhash64(F.lit(NAME))
    every = F.sequence(F.lit(1), F.size(w) - n + 1)

    def candidates(use) -> Column:
        if vocabulary is None:
            return let(every, use)
        known = F.transform(w, lambda x: (x < chr(ord(OPENING) + 1)) | x.isin(vocabulary))
        # most windows end at their first words: only the others are looked at as a whole
        whole = lambda k: F.filter(every, lambda i: F.get(k, i - 1) & F.get(k, i) & F.get(k, i + 1) & ~F.array_contains(F.slice(k, i, n), False))
        return let(known, lambda k: let(whole(k) if isinstance(n, int) and n > 2 else every, use))

    def each(at: Column) -> Column:
        heavy = lambda f: F.filter(at, lambda i: F.size(F.array_remove(F.slice(f, i, n), False)) * 2 > n)
        opening = F.filter(at, lambda i: F.get(w, i - 1).startswith(OPENING))
        by_value = let(slots, lambda f: F.when(
            F.size(F.array_remove(f, False)) * 2 > n,
            let(hashes(plain), lambda v: F.transform(heavy(f), lambda i: row(i, F.xxhash64(F.slice(v, i, n)))))).otherwise(none))
        in_lower = let(F.transform(w, is_name), lambda f: F.when(
            F.array_contains(f, True),
            let(hashes(caseless), lambda v: F.transform(F.filter(at, lambda i: F.array_contains(F.slice(f, i, n), True)),
                                                        lambda i: row(i, F.xxhash64(F.slice(v, i, n)))))).otherwise(none))

        def by_symbol(h: Column) -> Column:
            return F.concat(F.transform(at, lambda i: row(i, F.xxhash64(F.slice(h, i, n)))),
                            F.transform(opening, lambda i: row(i, F.xxhash64(F.concat(F.array(named), F.slice(h, i + 1, n - 1))))))
        return F.when(F.size(at) > 0, F.concat(let(hashes(symbol), by_symbol), in_lower, by_value)).otherwise(none)
    return F.when(F.size(w) >= n, candidates(each)).otherwise(none)


def benchmark_windows(benchmark: DataFrame, window: int, least_words: int) -> DataFrame:
    """(item_id, item, hash, place, length, total, telling): all windows of
    each item; an item shorter than a window is one window of its own length.
    Windows of which less than half the words are literal say too little and
    are hashed with the values of their slots; ``telling`` is the number of the
    others, ``item`` a hash of item_id and text."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    items = items.select("item_id", F.xxhash64("item_id", "text").alias("item"), words(typed(F.col("text"))).alias("w"))
    items = items.withColumn("n", F.size("w")).where(F.col("n") >= least_words)
    items = items.withColumn("length", F.least("n", F.lit(window)))
    places = items.select("item_id", "item", "length", (F.col("n") - F.col("length") + 1).alias("total"), "w",
                          F.explode(F.sequence(F.lit(0), F.col("n") - F.col("length"))).alias("place"))
    part = F.slice("w", F.col("place") + 1, F.col("length"))
    # an item's first word is an opening, too, where it is capitalised: a literal or a name
    first = (F.col("place") == 0) & F.get("w", 0).startswith(OPENING)
    places = (places.withColumn("telling", (F.size(F.filter(part, is_slot)) * 2 <= F.col("length")).cast("int"))
              .withColumn("telling_as_name", first & (F.size(F.filter(part, is_slot)) * 2 + 2 <= F.col("length")))
              .withColumn("by_symbol", F.transform(part, lambda x: F.xxhash64(symbol(x))))
              .withColumn("in_lower", F.transform(part, lambda x: F.xxhash64(caseless(x))))
              .withColumn("literals", F.size(F.filter(part, lambda x: ~is_slot(x) | is_name(x))))
              .withColumn("by_value", F.transform(part, lambda x: F.xxhash64(plain(x)))))
    telling = F.col("telling") == 1
    as_name = F.concat(F.array(F.xxhash64(F.lit(NAME))), F.slice("by_symbol", 2, F.col("length") - 1))
    hashes = F.filter(F.array(F.when(telling, F.xxhash64("by_symbol")),
                              F.when(F.col("literals") * 2 >= F.col("length"), F.xxhash64("in_lower")),
                              F.when(~telling | (first & ~F.col("telling_as_name")), F.xxhash64("by_value")),
                              F.when(F.col("telling_as_name"), F.xxhash64(as_name))), lambda h: h.isNotNull())
    counts = places.groupBy("item").agg(F.sum("telling").alias("telling"))
    return (places.select("item_id", "item", F.explode(F.array_distinct(hashes)).alias("hash"), "place", "length", "total")
            .join(counts, "item"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 8, enough: int = 6, least_words: int = 5) -> DataFrame:
    """Matches of benchmark items in documents: (doc_id, tag, item_id,
    matched_windows, item_windows, slots).

    A document matches an item where, at one offset, ``enough`` windows of the
    item's template (if it has no more, all but one) are found in the
    document's and the slots in that stretch are consistent, by the template
    with slots for names or by that with names as lower-cased literals.  Candidates have
    that share of the windows that aren't mostly slots, or one with the same
    values.  An item's first word may be a name in the document.  A character
    of a script without spaces is a word.  One row for each document and item,
    the best offset; ``tag`` is a hash of doc_id and text.  Null and empty
    texts match nothing, items under ``least_words`` words are too short to
    tell and match nothing, null ids are kept as ids.  Repeated rows of
    documents or items give one match.  Other columns are left out; empty
    tables give no rows.
    """
    index = materialise(benchmark_windows(benchmark, window, least_words), "benchmark")
    lengths = sorted(r["length"] for r in index.select("length").distinct().collect())  # at most ``window`` values
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tag")).where("text IS NOT NULL")
    if not lengths:
        lengths = [window]
    needed = lambda n: F.least(F.greatest(F.lit(1), F.col(n) - 1), F.lit(enough))
    found = docs.select("doc_id", "tag", words(typed(F.col("text"))).alias("w"))
    # the words of the benchmark, as long as they are few enough for the plan
    own = F.explode(F.transform(words(typed(F.coalesce("text", F.lit("")))), plain))
    vocabulary = [r[0] for r in benchmark.select(own.alias("word")).distinct().limit(MOST_WORDS + 1).collect()]
    vocabulary = sorted(vocabulary) if len(vocabulary) <= MOST_WORDS else None
    of_length = lambda w: F.array(*[F.struct(F.lit(n).alias("length"), windows(w, n, vocabulary).alias("at")) for n in lengths])
    found = found.select("doc_id", "tag", F.explode(let(F.col("w"), of_length)).alias("of"))
    found = found.select("doc_id", "tag", "of.length", F.inline("of.at")).join(broadcast_if_few(index), ["hash", "length"])
    aligned = (found.groupBy("doc_id", "tag", "item_id", "item", "total", "telling", "length", (F.col("at") - F.col("place")).alias("offset"))
               .agg(F.countDistinct("place").alias("anchors")).where(F.col("anchors") >= needed("telling")))
    aligned = materialise(aligned, "aligned")

    # the words of either side, with the values of their slots, only where something matched
    theirs = (benchmark.select(F.xxhash64("item_id", F.coalesce("text", F.lit(""))).alias("i"), words(typed(F.col("text"))).alias("b"))
              .dropDuplicates(["i"]))
    ours = (docs.join(broadcast_if_few(aligned.select(F.col("tag").alias("t")).distinct()), F.col("tag") == F.col("t"))
            .select(F.col("tag").alias("t"), words(typed(F.col("text"))).alias("d")).dropDuplicates(["t"]))
    both = aligned.join(ours, F.col("tag") == F.col("t")).join(theirs, F.col("item") == F.col("i"))
    marks = F.transform("b", lambda b, j: F.struct(b.alias("b"), F.get("d", j + F.col("offset")).alias("d"), (j == 0).alias("first")))
    both = both.withColumn("pairs", marks).drop("b", "d")
    named = lambda p: p["first"] & p["b"].startswith(OPENING) & p["d"].rlike(f"^[{NAME}{OPENING}]") & (plain(p["b"]) != plain(p["d"]))
    same = lambda p: F.substring(p["b"], 1, 1) == F.substring(p["d"], 1, 1)
    # either template: which pairs of words are equal, and which of them are slots
    ways = ((lambda p: (symbol(p["b"]) == symbol(p["d"])) | named(p), lambda p: (is_slot(p["b"]) & same(p)) | named(p)),
            (lambda p: caseless(p["b"]) == caseless(p["d"]), lambda p: is_slot(p["b"]) & ~is_name(p["b"]) & same(p)))
    place = F.sequence(F.lit(0), F.col("total") - 1)
    whole = lambda e: F.filter(place, lambda j: ~F.array_contains(F.slice(e, j + 1, F.col("length")), False))

    def matching(equal, slot) -> DataFrame:
        places = let(F.transform("pairs", lambda p: F.coalesce(equal(p), F.lit(False))), whole)
        way = both.withColumn("places", places).withColumn("matched", F.size("places")).where(F.col("matched") >= needed("total"))
        span = F.slice("pairs", F.array_min("places") + 1, F.array_max("places") - F.array_min("places") + F.col("length"))
        slots = F.array_distinct(F.transform(F.filter(span, slot), lambda p: F.struct(plain(p["b"]).alias("b"), plain(p["d"]).alias("d"))))
        consistent = ((F.size(F.array_distinct(F.transform("slots", lambda p: p["b"]))) == F.size("slots"))
                      & (F.size(F.array_distinct(F.transform("slots", lambda p: p["d"]))) == F.size("slots")))
        return way.withColumn("slots", slots).where(consistent)
    held = matching(*ways[0]).unionByName(matching(*ways[1]))
    best = F.max(F.struct(F.col("matched").alias("matched_windows"), F.col("total").alias("item_windows"), F.size("slots").alias("slots"))).alias("best")
    return held.groupBy("doc_id", "tag", "item_id").agg(best).select("doc_id", "tag", "item_id", "best.*")


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contaminated(docs, benchmark).drop("tag")

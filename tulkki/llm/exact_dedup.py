"""Exact dedup by distributed radix partitioning, most significant bytes first.

Texts are compared byte by byte, never by a digest.  A round splits every
group of documents by their next stretch of bytes: the documents of a group
that agree in it form a group of the next round.  A group of one is settled,
and so is a group whose texts end within the stretch: its documents are equal.
Only the rest goes on, with what is left of its texts.  A stretch is several
times as long as the one before, so that the rounds grow with the logarithm
of the longest text; most documents leave after the first few bytes.

Groups are counted by partial aggregates, whatever their size, so copies meet
in the map tasks already.  Their numbers come back to the documents by a
broadcast of the groups where these are small by measure; beyond that, the
few hottest are broadcast and the others joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tulkki.llm.store import discard, materialise, new_path

SPACES = r"[\x20\x09-\x0D]+"
KEYS = ["grp", "digit", "ended"]
#: Groups with more than this share of the rows are hot; fewer than its inverse can be.
HOT_SHARE = 1 / 512


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; a null text is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _numbered(cut: DataFrame, groups: DataFrame, most_bytes: int) -> DataFrame:
    """Join the groups of two rows and more back to their rows."""
    size, rows = groups.agg(F.sum(F.octet_length("digit") + 64), F.sum("n")).first()
    if not size or size <= most_bytes:
        return cut.join(F.broadcast(groups), KEYS, "left")
    is_hot = F.col("n") > rows * HOT_SHARE
    if (groups.where(is_hot).agg(F.sum(F.octet_length("digit") + 64)).first()[0] or 0) > most_bytes:
        return cut.join(groups, KEYS, "left")
    hot = cut.join(F.broadcast(groups.where(is_hot)), KEYS, "left")
    cold = hot.where("n IS NULL").select(*cut.columns).join(groups.where(~is_hot), KEYS, "left")
    return hot.where("n IS NOT NULL").unionByName(cold)


def _delete(spark, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def exact_dedup(docs: DataFrame, first: int = 64, growth: int = 8, most_bytes: int = 32 << 20) -> DataFrame:
    """One row per input row: doc_id, keep_id (doc_id of the row that stays of
    its equals), group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when their bytes are, with runs of ASCII white space as
    one space; a null text is an empty one.  Of equal texts the row with the
    smallest doc_id stays; null doc_ids come last, and of rows that share the
    smallest doc_id (or have none at all) exactly one stays.  Other columns
    are left out, so clashing names don't matter; an empty table gives an
    empty result.  ``first`` bytes make the first stretch, each next one is
    ``growth`` times as long; groups of ``most_bytes`` in all are broadcast.
    """
    spark = docs.sparkSession
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    texts = norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
                        F.lit(0).cast("long").alias("grp"), F.col("norm").cast("binary").alias("rest"))
    current = materialise(texts, "texts")
    spent, settled, width = current.tulkki_path, [], first
    while True:
        cut = current.select("rid", "doc_id", "text_sha256", "grp", F.substring("rest", 1, width).alias("digit"),
                             (F.octet_length("rest") <= width).alias("ended"), F.expr(f"substring(rest, {width + 1})").alias("rest"))
        # the row that stays also gives its number to the group
        stays = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "rid"))
        groups = (cut.groupBy(*KEYS).agg(F.count("*").alias("n"), stays.alias("stays")).where("n > 1")
                  .select(*KEYS, "n", F.col("stays.doc_id").alias("keep_id"), F.col("stays.rid").alias("keep_rid")))
        groups = materialise(groups, "groups")
        goes_on = F.coalesce(F.col("n").isNotNull() & ~F.col("ended"), F.lit(False))
        found = _numbered(cut, groups, most_bytes).select(
            "rid", "doc_id", "text_sha256", F.coalesce("keep_rid", "rid").alias("grp"), F.when(goes_on, F.col("rest")).alias("rest"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (F.coalesce("keep_rid", "rid") == F.col("rid")).alias("kept"), goes_on.alias("goes_on"))
        path = new_path(spark, "split")
        found.write.partitionBy("goes_on").parquet(path)
        more = not groups.where("NOT ended").isEmpty()
        discard(groups)
        _delete(spark, spent)
        split = spark.read.schema(found.schema).parquet(path)
        settled.append(split.where("NOT goes_on"))
        if not more:
            break
        current, spent = split.where("goes_on"), f"{path}/goes_on=true"
        width *= growth
    result = settled[0]
    for part in settled[1:]:
        result = result.unionByName(part)
    return result.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

"""File sources and sinks.

All readers are Spark readers (text, binaryFile without content, JSON with a
declared schema); all writers are DataFrame writers, partitioned so a rerun
replaces only its slice.  Nothing passes through the driver.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tulkki.functions import text as tx
from tulkki.schemas import RESULT


LINES = "path string, file_name string, pos bigint, text string"


def missing_inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Reject rows (path, reject_reason) for the paths and patterns that nothing matches."""
    gone = [(p, "missing_input") for p in paths if not files_exist(spark, p)]
    return spark.createDataFrame(gone, "path string, reject_reason string")


def files_exist(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, or a pattern matches anything."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop))


def read_lines(spark: SparkSession, path: str | list[str], pattern: str | None = None,
               recursive: bool = False) -> DataFrame:
    """One row per non-blank stripped line: (path, file_name, pos, text).

    Lines end at CRLF, CR or LF.  Files are read in splits, so a file of any
    size is spread over tasks: positions are counted within each split and
    moved up by what the splits before it hold.  Paths that don't exist give
    no row; ``missing_inputs`` lists them.
    """
    found = [p for p in ([path] if isinstance(path, str) else path) if files_exist(spark, p)]
    if not found:
        return spark.createDataFrame([], LINES)
    r = spark.read
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    lines = r.text(found).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("n"), tx.strip(F.col("value")).alias("text"))
    kept = lines.where(F.col("text") != "")
    within = kept.withColumn("at", F.row_number().over(Window.partitionBy("path", "block").orderBy("n")) - 1)
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = kept.groupBy("path", "block").agg(F.count("*").alias("lines")).select("path", "block", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start"))
    return (within.join(starts, ["path", "block"])
            .select("path", tx.file_name("path").alias("file_name"), (F.col("start") + F.col("at")).alias("pos"), "text"))


def list_files(spark: SparkSession, root: str, pattern: str | None = None,
               recursive: bool = False) -> DataFrame:
    """File discovery (path, file_name, length, modificationTime); content is never read."""
    r = spark.read.format("binaryFile")
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if recursive:
        r = r.option("recursiveFileLookup", True)
    df = r.load(root)
    return df.select("path", tx.file_name("path").alias("file_name"), "length", "modificationTime")


def audio_manifest(spark: SparkSession, root: str, pattern: str = "*.wav") -> DataFrame:
    """S3: recordings with parsed name metadata (F3) and condition columns."""
    from tulkki import dims
    from tulkki.operators.relational import with_condition
    f = list_files(spark, root, pattern, recursive=True)
    meta = tx.parse_recording(tx.file_stem("file_name"))
    df = f.select("*", meta.alias("m")).select(
        "path", "file_name", "length", F.col("m.lang").alias("Language"),
        F.col("m.speaker_group").alias("Speaker_Group"), F.col("m.speaker_type").alias("Speaker_Type"),
        F.col("m.speaker_gender").alias("Speaker_Gender"), F.col("m.condition").alias("Condition_Code"))
    return with_condition(df, dims.conditions(spark))


def read_results(spark: SparkSession, path: str, arrays: bool = False) -> DataFrame:
    """JSON lines with the declared result schema (``arrays``: files that are one JSON array each); NaN -> NULL.

    Records that can't be read are left out; ``results_and_rejects`` has them."""
    return results_and_rejects(spark, path, arrays)[0]


def results_and_rejects(spark: SparkSession, path: str, arrays: bool = False) -> tuple[DataFrame, DataFrame]:
    """The records that can be read, and those that can't.

    A record is unreadable where it isn't whole JSON (a file whose writer was
    stopped) or where a value doesn't fit its column.  Rejects have path,
    Task, Model and Language as far as they could be read, the raw record and
    a ``reject_reason``.  Of files that are arrays, an unreadable one is one
    reject.
    """
    corrupt = "_unreadable"
    schema = T.StructType([*RESULT.fields, T.StructField(corrupt, T.StringType())])
    rows = (spark.read.schema(schema).option("multiLine", arrays).option("allowNonNumericNumbers", True)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt).json(path))
    # all columns are parsed whatever is asked for (this always holds): a value is only found unreadable where its column is read
    beside = F.pmod(F.xxhash64(*RESULT.names), F.lit(2)) >= 0
    good = rows.where(F.col(corrupt).isNull() & beside)
    for f in RESULT.fields:
        if f.dataType.typeName() == "double":
            good = good.withColumn(f.name, F.nanvl(F.col(f.name), F.lit(None).cast("double")))
    bad = rows.where(F.col(corrupt).isNotNull() & beside).select(
        F.col("_metadata.file_path").alias("path"), "Task", "Model", "Language", F.col(corrupt).alias("record"), F.lit("unreadable_record").alias("reject_reason"))
    return good.drop(corrupt), bad


def write_lines(df: DataFrame, path: str, keys: list[str], pos: str = "pos", text: str = "text",
                stretch: int = 1_000_000) -> None:
    """One stripped text per line, in position order, one folder per key.

    A key's lines are cut into stretches of ``stretch`` positions, each in one
    task, and files are named in the order of the stretches, so that a hot key
    is written by many tasks and its files, by name, hold its lines in order.
    """
    out = df.select(*keys, F.floor(F.col(pos) / stretch).alias("stretch"), pos, tx.strip(F.col(text)).alias("value"))
    out = out.repartitionByRange("stretch", *keys).sortWithinPartitions(*keys, "stretch", pos)
    out.select(*keys, "value").write.mode("overwrite").partitionBy(*keys).text(path)


def write_results(df: DataFrame, path: str, fmt: str = "json", partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    """JSON records (null fields kept) or CSV with a header."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "json":
        w.option("ignoreNullFields", False).json(path)
    elif fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def append_results(df: DataFrame, path: str, partition_by: list[str] | None = None, run: str | None = None) -> None:
    """Append new records by column name (no read-and-rewrite of the old ones).

    Columns that the table has and ``df`` lacks are NULL; new columns are
    kept, readers merge the schemas.  Where the folder holds nothing that can
    be read as Parquet, a new table starts beside it.

    With ``run`` the records go to the table's folder ``run=...``, which a
    repeated run of that name replaces: a job that is retried, or a batch that
    a stream repeats, leaves its records once.  A table has runs from its
    first append on or not at all.
    """
    spark = df.sparkSession
    try:
        old = spark.read.option("mergeSchema", True).parquet(path).schema if files_exist(spark, path) else None
    except AnalysisException:
        old = None
    if old is not None and (run is not None) != ("run" in old.names):
        raise ValueError(f"{path} was written {'with' if 'run' in old.names else 'without'} runs")
    for f in old or []:
        if f.name == "run" and run is not None:
            continue
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
        elif df.schema[f.name].dataType != f.dataType:
            df = df.withColumn(f.name, F.col(f.name).cast(f.dataType))
    w = df.write.mode("append" if run is None else "overwrite").option("partitionOverwriteMode", "static")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path if run is None else f"{path}/run={run}")


def append_stream(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> None:
    """S8 for a stream: every micro-batch appended once, also where it is repeated after a failure.

    Takes all that is new and stops.  The run of a batch is named by the
    stream's checkpoint and the number of the batch."""
    name = stream_name(checkpoint)
    q = (df.writeStream.foreachBatch(lambda batch, n: append_results(batch, path, partition_by, run=f"{name}-{n}"))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stream_name(checkpoint: str) -> str:
    """A short name of a stream that no other checkpoint has (by chance)."""
    return hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()[:12]


def replace_slice(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Rerun of a (language, model) slice replaces only that slice."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)

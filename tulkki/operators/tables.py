"""Tables written to the folder that the whole cluster shares, to cut lineage between the steps of a loop."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A path not used before under ``spark.checkpoint.dir``.

    Where that is unset, a local session gets a scratch folder of this
    machine; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tulkki-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/tulkki/{uuid.uuid4().hex}/{name}"


#: shuffle files go with the job that made them
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet and read it back: what follows starts from files, also after a lost executor.

    The shuffle files of the write are removed at its end, as nothing reads them again."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.tulkki_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables from ``written`` that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.tulkki_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a dimension of ``most`` narrow rows at most; a larger table is joined by shuffle, with the same result."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

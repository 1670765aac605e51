"""Tables written to the folder that the whole cluster shares, to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where it is unset (tests, a local session) a scratch folder of this
    machine is made and set; on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tulkki-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tulkki/{uuid.uuid4().hex}/{name}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    A lost executor then costs a re-read, not a recomputation, and the plan
    that goes on starts from files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.tulkki_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables written by ``materialise`` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.tulkki_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def broadcast_if_few(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Broadcast a table of a few narrow columns if it has ``most`` rows at
    most (tens of megabytes); a larger one is joined by shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df

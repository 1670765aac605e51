"""Session helpers: one place for the settings the jobs rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tulkki", driver_memory: str = "16g") -> SparkSession:
    """Build (or reuse) a session with AQE on and the UI off.

    On a cluster the master, memory and checkpoint folder come from the
    submit configuration; the defaults here only fill gaps for local runs.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            # local mode runs every task in the driver JVM
            b = b.config("spark.driver.memory", driver_memory)
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          # no broadcast on size *estimates* (an explode can inflate a side far
          # beyond them); fixed dimensions are broadcast explicitly, and AQE may
          # broadcast a side only when its measured shuffle output is small
          .config("spark.sql.autoBroadcastJoinThreshold", "-1")
          .config("spark.sql.adaptive.autoBroadcastJoinThreshold", "32m")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # long texts travel through Arrow: keep batches small enough
          .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark

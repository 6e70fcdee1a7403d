"""A session with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "linkquarry", **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew handling, and Arrow batches bounded by bytes; the caller's settings win.

    On a cluster set spark.checkpoint.dir to a folder that all executors share, and spark.sql.shuffle.partitions to about
    two or three times the cores (adaptive execution joins partitions that turn out small)."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "16m",
        "spark.sql.files.maxPartitionBytes": "128m",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def spread(df: DataFrame, small_bytes: int = 64 << 20) -> DataFrame:
    """df dealt to all cores, if it is small (``small_bytes`` a core) and lies in fewer files than there are cores; else as it is.

    A small file is often one row group, which one task would read and work on alone. Larger inputs have enough row
    groups, and are never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < small_bytes * cores and len(df.inputFiles()) < cores else df

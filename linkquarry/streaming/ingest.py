"""Incremental ingestion of landed candidate files into a growing table of distinct accepted URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.functions.canonical import canonicalize_batch


def read_landing(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(F.trim("value").alias("url"), F.col("_metadata.file_modification_time").alias("landed")).filter("url <> ''")


def accepted_stream(lines: DataFrame, preset: str = "clean", late: str = "7 days") -> DataFrame:
    """Distinct accepted (url, hostname, landed) of a stream; state older than the watermark is dropped."""
    rows = canonicalize_batch(lines, "url", preset).filter("canonical.error_code is null")
    return rows.select("canonical.url", "canonical.hostname", "landed").withWatermark("landed", late).dropDuplicatesWithinWatermark(["url"])


def hourly_hosts(accepted: DataFrame) -> DataFrame:
    """Accepted URLs of each host by the hour of landing."""
    return accepted.groupBy(F.window("landed", "1 hour").alias("hour"), "hostname").agg(F.count("*").alias("urls")).select("hour.start", "hostname", "urls")


def ingest(spark: SparkSession, landing: str, table_path: str, checkpoint: str, preset: str = "clean") -> None:
    """Process all landed files that are new, exactly once, and stop."""
    query = accepted_stream(read_landing(spark, landing), preset).writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()

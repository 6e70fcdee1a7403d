"""Canonicalising candidates, telling accepted from rejected, and dealing them to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkquarry.functions.canonical import canonicalize_batch
from linkquarry.functions.hashing import staging_shard


def canonicalized(candidates: DataFrame, preset: str = "clean") -> DataFrame:
    """(ordinal, url) with ``canonical``; read by both halves below, so write or cache it when both are wanted."""
    return canonicalize_batch(candidates.select("ordinal", "url"), "url", preset)


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter("canonical.error_code is null").select("ordinal", "canonical.url", "canonical.hostname")


def rejected(rows: DataFrame) -> DataFrame:
    code = F.coalesce("canonical.error_code", F.lit("canonicalization-failed"))
    return rows.filter("canonical.error_code is not null").select("ordinal", code.alias("code"), F.col("canonical.error_detail").alias("detail"), "url")


def rejection_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("code").agg(F.count("*").alias("rows"))


def rejection_sample(rows: DataFrame, n: int = 100) -> DataFrame:
    """The first n rejected rows in order of arrival."""
    return rows.orderBy("ordinal").limit(n)


def shards(rows: DataFrame, n: int = 64) -> DataFrame:
    """Rows with their staging shard, a hash of the host."""
    return rows.withColumn("shard", staging_shard(F.col("hostname"), n))


def write_shards(rows: DataFrame, path: str, n: int = 64) -> DataFrame:
    """Gzipped JSON lines in one folder for each shard; returns records of every shard that has any.

    The two-column repartition keeps a shard with one huge host from being one task."""
    dealt = shards(rows, n).select("url", "hostname", "shard").repartition("shard", F.pmod(F.xxhash64("url"), F.lit(8)))
    dealt.write.partitionBy("shard").option("compression", "gzip").json(path)
    written = rows.sparkSession.read.schema("url string, hostname string, shard int").json(path)
    return written.groupBy("shard").agg(F.count("*").alias("records"))

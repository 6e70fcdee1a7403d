"""Stage-0 corpora: sources merged, split three ways and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkquarry.functions import strings
from linkquarry.functions.canonical import canonicalize
from linkquarry.functions.hashing import sha256_hex
from linkquarry.operators import splits

NORMALIZATIONS = ("aggressive", "clean", "exact", "browser", "raw")


def host_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("hostname").agg(F.count("*").alias("urls"))


def popular_hosts(counts: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """The ``most`` hosts with the most rows, from ``least`` rows up; ties in the order of Unicode collation."""
    return counts.filter(F.col("urls") >= least).orderBy(F.desc("urls"), F.collate("hostname", "UNICODE"), "hostname").limit(most)


def normalized(raw: DataFrame, normalization: str = "clean") -> DataFrame:
    """Source rows (ordinal, source, source_index, url, timestamp, tags) with ``canonical``."""
    if normalization not in NORMALIZATIONS:
        raise ValueError("normalization must be aggressive, clean, exact, browser, or raw")
    preset = normalization if normalization in ("clean", "aggressive") else "exact"
    out = raw.withColumn("canonical", canonicalize("url", preset))
    key = F.col("url") if normalization == "raw" else F.col("canonical.url")
    return out.withColumn("key", F.when(F.col("canonical.error_code").isNull(), key))


def merge_duplicates(rows: DataFrame) -> DataFrame:
    """One row for each key: the first by ordinal, with all sources and tags of its group, and whether any was adversarial.

    Groups are reduced by aggregates that combine on the map side, so a key with very many rows is no hot spot."""
    first = F.min_by(F.struct(F.col("url").alias("raw_url"), F.col("canonical.hostname").alias("hostname"), "source_index", "timestamp"), "ordinal")
    merged = rows.filter("key is not null").groupBy(F.col("key").alias("url")).agg(
        first.alias("first"),
        F.min("ordinal").alias("ordinal"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"),
        F.bool_or(F.col("source") == "built-in-adversarial").alias("adversarial"),
    )
    return merged.select(sha256_hex(F.col("url")).alias("id"), "url", F.when(F.col("first.raw_url") != F.col("url"), F.col("first.raw_url")).alias("raw_url"), "first.hostname", "sources", "first.source_index", "first.timestamp", "tags", "adversarial", "ordinal")


def classified(rows: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """Rows with ``classes``. The table of popular hosts has ``most`` rows at most and is broadcast; counts come from a window."""
    counted = rows.withColumn("host_count", F.count("*").over(Window.partitionBy("hostname")))
    popular = popular_hosts(host_counts(rows), least, most).select("hostname", F.lit(True).alias("popular"))
    both = counted.join(F.broadcast(popular), "hostname", "left").withColumn("popular", F.coalesce("popular", F.lit(False)))
    return both.withColumn("classes", strings.classify(F.col("url"), F.col("tags"), F.col("host_count"), F.col("popular"), F.col("adversarial")))


def prepare(raw: DataFrame, seed: str, test_fraction: float = 0.1, normalization: str = "clean") -> tuple[DataFrame, DataFrame]:
    """Records and rejected rows of a stage-0 corpus. Cache ``raw`` or write it first: both read it."""
    rows = normalized(raw, normalization)
    merged = merge_duplicates(rows)
    held = splits.temporal_holdout(splits.unseen_host_holdout(splits.seen_host_holdout(merged, seed, test_fraction), seed, test_fraction), test_fraction)
    records = classified(held)
    rejected = rows.filter("key is null").select("source", "source_index", F.lit(None).cast("string").alias("line"), "url", F.col("canonical.error_detail").alias("reason"))
    return records, rejected


def summary(rows: DataFrame, records: DataFrame, unparsed: DataFrame | None = None) -> DataFrame:
    """One row of counts: input (parsed lines), accepted, unique, duplicates, rejected (unparsed lines too) and hosts."""
    totals = rows.agg(F.count("*").alias("input"), F.count_if(F.col("key").isNotNull()).alias("accepted"), F.count_if(F.col("key").isNull()).alias("failed"))
    unique = records.agg(F.count("*").alias("unique"), F.count_distinct("hostname").alias("hosts"))
    lost = unparsed.agg(F.count("*").alias("unparsed")) if unparsed is not None else rows.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("unparsed"))
    # Each side is one row.
    one = totals.withColumn("k", F.lit(1)).join(unique.withColumn("k", F.lit(1)), "k").join(lost.withColumn("k", F.lit(1)), "k")
    return one.select("input", F.col("accepted").alias("accepted_before_dedupe"), "unique", (F.col("accepted") - F.col("unique")).alias("duplicates"), (F.col("failed") + F.col("unparsed")).alias("rejected"), "hosts")

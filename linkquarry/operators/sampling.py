"""Exact-size, host-balanced and reproducible samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkquarry.functions.hashing import bucket_width, check_bucket_range, hash_bucket, hash_order, xorshift32


class InsufficientCandidates(ValueError):
    def __init__(self, requested: int, available: int):
        super().__init__(f"{requested} URLs requested, {available} available")
        self.requested, self.available = requested, available


def distinct_candidates(accepted: DataFrame) -> DataFrame:
    return accepted.select("url", "hostname").distinct()


def candidate_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count("*").alias("urls"), F.count_distinct("hostname").alias("hosts"))


def host_coverage(candidates: DataFrame, n: int, seed: str, cap: int) -> DataFrame:
    """Up to n URLs that cover hosts evenly: every host's first by hash, then every host's second, up to ``cap`` each.

    The filter on the rank lets Spark cut each host's rows before they are shuffled."""
    order = hash_order(seed, "sample-url", F.col("url"))
    rank = F.row_number().over(Window.partitionBy("hostname").orderBy(order, "url"))
    ranked = candidates.withColumn("within_host_rank", rank).filter(F.col("within_host_rank") <= cap)
    return ranked.orderBy("within_host_rank", hash_order(seed, "sample-host", F.col("hostname")), order, "url").limit(n)


def prevalence_fill(candidates: DataFrame, taken: DataFrame, n: int, seed: str) -> DataFrame:
    """n more URLs, uniform by hash, that aren't taken yet."""
    rest = candidates.join(taken.select("url"), "url", "left_anti")
    return rest.orderBy(hash_order(seed, "sample-prevalence", F.col("url")), "url").limit(n)


def balanced_sample(candidates: DataFrame, n: int, seed: str, host_fraction: float = 0.8, cap: int = 16, check: bool = True) -> DataFrame:
    """Exactly n distinct candidates: a share covers hosts evenly, the rest follows prevalence.

    ``check`` counts first and raises InsufficientCandidates when there are too few."""
    if not (isinstance(n, int) and n > 0) or not 0 <= host_fraction <= 1 or cap < 1:
        raise ValueError("bad sample size, host fraction or cap")
    if check and (available := candidates.count()) < n:
        raise InsufficientCandidates(n, available)
    covered = host_coverage(candidates, int(n * host_fraction), seed, cap).select("url", "hostname")
    # The fill is ordered behind the whole coverage, so one limit gives exactly n whatever the coverage found.
    fill = prevalence_fill(candidates, covered, n, seed).select("url", "hostname")
    ranked = covered.withColumn("phase", F.lit(0)).unionByName(fill.withColumn("phase", F.lit(1)))
    return ranked.orderBy("phase", hash_order(seed, "sample-prevalence", F.col("url")), "url").limit(n).select("url", "hostname")


def hash_bucket_range(rows: DataFrame, seed: str, start: int, end: int, buckets: int = 1_000_000, url_col: str = "url") -> DataFrame:
    """Rows whose bucket lies in the half-open range."""
    check_bucket_range(start, end, buckets)
    bucket = hash_bucket(seed, F.col(url_col), buckets)
    return rows.withColumn("bucket", bucket).filter((F.col("bucket") >= start) & (F.col("bucket") < end))


def top_up(eligible: DataFrame, n: int, seed: str, take: Callable[[DataFrame], DataFrame], multiplier: float = 2, buckets: int = 1_000_000, **sample) -> DataFrame:
    """A balanced sample from as few buckets of the eligible rows as suffice; ``take`` turns rows into candidates (url, hostname).

    Each round adds the next disjoint range; when the buckets are used up, InsufficientCandidates is raised."""
    width = bucket_width(n, eligible.count(), multiplier, buckets)
    end = min(width, buckets)
    while True:
        candidates = distinct_candidates(take(hash_bucket_range(eligible, seed, 0, end, buckets)))
        try:
            return balanced_sample(candidates, n, seed, **sample)
        except InsufficientCandidates:
            if end >= buckets:
                raise
            end = min(buckets, end + width)


def hash_sample(rows: DataFrame, n: int, seed: str, key: str = "url") -> DataFrame:
    """n rows, uniform by hash: a distributed stand-in for a reservoir. Fewer rows raise InsufficientCandidates."""
    if (available := rows.count()) < n:
        raise InsufficientCandidates(n, available)
    return rows.orderBy(hash_order(seed, "reservoir", F.col(key)), key).limit(n)


def reservoir(rows: Iterator, n: int, seed: int) -> list:
    """Algorithm R over rows in order with a 32-bit xorshift generator, for exact replays."""
    random, kept, seen = xorshift32(seed), [], 0
    for row in rows:
        seen += 1
        if len(kept) < n:
            kept.append(row)
        elif (k := int(next(random) * seen)) < n:
            kept[k] = row
    if len(kept) < n:
        raise InsufficientCandidates(n, len(kept))
    return kept

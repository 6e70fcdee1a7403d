"""Train, validation and test splits that don't leak between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkquarry.functions.hashing import partition_score, stage0_score
from linkquarry.rules import SPLITS


def _three_way(score: Column, validation: float, test: float) -> Column:
    """0, 1 or 2; boundaries are summed from left to right in doubles."""
    train = 1 - validation - test
    return F.when(score < F.lit(float(train)), 0).when(score < F.lit(float(train + validation)), 1).otherwise(2)


def five_way_splits(urls: DataFrame, seed: str, validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """(url, hostname) with ``split``: 0 train, 1 and 2 validation and test of seen hosts, 3 and 4 of unseen hosts.

    A seen host without a training URL gives its first by repair score to training. Two windows over the same key
    share one shuffle."""
    if validation <= 0 or test <= 0 or validation + test >= 1:
        raise ValueError("validation and test fractions must be positive and sum to less than one")
    host = _three_way(partition_score(seed, "host", F.col("hostname")), validation, test)
    own = _three_way(partition_score(seed, "url", F.col("url")), validation, test)
    # COLLATE would follow people's order of URLs; scores tie so rarely that the binary order serves.
    first = Window.partitionBy("hostname").orderBy(partition_score(seed, "repair", F.col("url")), "url")
    scored = urls.withColumn("host_class", host).withColumn("url_class", own)
    scored = scored.withColumn("least_class", F.min("url_class").over(Window.partitionBy("hostname"))).withColumn("repair_rank", F.row_number().over(first))
    repaired = (F.col("least_class") > 0) & (F.col("repair_rank") == 1)
    split = F.when(F.col("host_class") > 0, F.col("host_class") + 2).when(repaired, 0).otherwise(F.col("url_class"))
    return scored.select("url", "hostname", split.cast("tinyint").alias("split"), (repaired & (F.col("host_class") == 0)).alias("repaired"))


def split_counts(rows: DataFrame) -> DataFrame:
    """One row for each of the five splits, zero included."""
    one = rows.agg(*[F.count_if(F.col("split") == k).alias(str(k)) for k in range(len(SPLITS))])
    pairs = F.array(*[F.struct(F.lit(k).alias("split"), F.lit(name).alias("name"), F.col(str(k)).alias("rows")) for k, name in enumerate(SPLITS)])
    return one.select(F.inline(pairs))


def seen_host_holdout(rows: DataFrame, seed: str, fraction: float) -> DataFrame:
    """``seen_host``: of every host with two rows or more, a share (one row at least, never all) with the lowest scores is test."""
    host = Window.partitionBy("hostname")
    n = F.count("*").over(host)
    rank = F.row_number().over(host.orderBy(stage0_score(f"{seed}:seen-host", F.col("id")), "ordinal"))
    held = F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)))))
    return rows.withColumn("seen_host", F.when((n >= 2) & (rank <= held), "test").otherwise("train"))


def unseen_host_holdout(rows: DataFrame, seed: str, fraction: float) -> DataFrame:
    """``unseen_host``: whole hosts by their score; no shuffle."""
    return rows.withColumn("unseen_host", F.when(stage0_score(f"{seed}:unseen-host", F.col("hostname")) < F.lit(float(fraction)), "test").otherwise("train"))


def temporal_holdout(rows: DataFrame, fraction: float) -> DataFrame:
    """``temporal_seen_host``: of every host with two finite timestamps or more the latest share is test; rows without one are excluded."""
    dated = F.col("timestamp").isNotNull() & ~F.isnan("timestamp") & (F.abs("timestamp") != float("inf"))
    host = Window.partitionBy("hostname", dated)
    n = F.count("*").over(host)
    rank = F.row_number().over(host.orderBy("timestamp", "id"))
    held = F.least(n - 1, F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction)))))
    return rows.withColumn("temporal_seen_host", F.when(~dated | (n < 2), "excluded").when(rank > n - held, "test").otherwise("train"))


def unpivot_splits(rows: DataFrame) -> DataFrame:
    """Long form (hostname, split_name, assignment) of the three holdouts."""
    return rows.select("hostname", F.expr("stack(3, 'seenHost', seen_host, 'unseenHost', unseen_host, 'temporalSeenHost', temporal_seen_host) AS (split_name, assignment)"))


def assignment_counts(rows: DataFrame) -> DataFrame:
    """Rows and distinct hosts of each split and assignment."""
    return unpivot_splits(rows).groupBy("split_name", "assignment").agg(F.count("*").alias("records"), F.count_distinct("hostname").alias("hosts"))


def leakage_violations(rows: DataFrame) -> DataFrame:
    """Hosts that break isolation: an unseen host in another split, or a seen host without training rows."""
    mask = rows.groupBy("hostname").agg(F.bit_or(F.expr("shiftleft(1, cast(split as int))")).alias("mask"))
    unseen, m = F.col("mask").bitwiseAND(24), F.col("mask")
    rule = F.when((unseen != 0) & ~m.isin(8, 16), "unseen-host-shared").when((unseen == 0) & (m.bitwiseAND(1) == 0), "seen-host-without-train")
    return mask.withColumn("rule", rule).filter("rule is not null")

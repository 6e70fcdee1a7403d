"""Descriptive statistics and grouped summaries of benchmark results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkquarry.functions.codec import FragmentCodec, decode_fragment, encode_fragment
from linkquarry.functions.strings import classify_difference


def describe(value: Column | str) -> Column:
    """Struct of count, min, max, mean, median, p50, p95 and p99 (linear interpolation) of finite values; null for none."""
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    v = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    p = F.percentile(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    parts = F.struct(F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), p[0].alias("median"), p[0].alias("p50"), p[1].alias("p95"), p[2].alias("p99"))
    return F.when(F.count(v) > 0, parts)


def describe_frame(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return (df.groupBy(*by) if by else df.groupBy()).agg(describe(value).alias("s")).select(*(by or []), "s.*")


def summarize(results: DataFrame, by: list[str]) -> DataFrame:
    """Totals, exact rate, counts of statuses and (of those not exact) reasons, and two descriptions, for each group."""
    base = results.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "exact").alias("exact"), describe("payload_symbols").alias("payload_symbols"), describe("rendered_characters").alias("rendered_characters")
    )

    def counts(rows: DataFrame, key: str, name: str) -> DataFrame:
        n = rows.groupBy(*by, F.col(key).alias("key")).agg(F.count("*").alias("n"))
        return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias(name))

    statuses = counts(results.withColumn("status", F.coalesce("status", F.lit("unknown"))), "status", "statuses")
    reasons = counts(results.filter((F.col("status") != "exact") & F.col("reason").isNotNull()), "reason", "reasons")
    out = base.join(statuses, by, "left").join(reasons, by, "left") if by else base.crossJoin(statuses).crossJoin(reasons)
    return out.withColumn("exact_rate", F.col("exact") / F.col("total"))


def by_class(results: DataFrame) -> DataFrame:
    """Summaries by class; a row counts in each of its classes."""
    return summarize(results.withColumn("class", F.explode("classes")), ["class"])


def by_split(results: DataFrame) -> DataFrame:
    """Summaries by split and assignment (``name:assignment``) of a map column; excluded rows don't count."""
    rows = results.withColumn("entry", F.explode(F.map_entries("splits"))).filter("entry.value <> 'excluded'")
    return summarize(rows.withColumn("split", F.concat_ws(":", "entry.key", "entry.value")), ["split"])


def select_records(rows: DataFrame, selection: str = "all") -> DataFrame:
    """All rows, or those of ``<seen-host|unseen-host|temporal-seen-host>:<train|test>``, parted at the last colon."""
    if selection == "all":
        return rows
    name, _, assignment = selection.rpartition(":")
    column = {"seen-host": "seenHost", "unseen-host": "unseenHost", "temporal-seen-host": "temporalSeenHost"}.get(name)
    if column is None or assignment not in ("train", "test"):
        raise ValueError(f"unknown selection {selection!r}")
    return rows.filter(F.col("splits")[column] == assignment)


def benchmark(records: DataFrame, codec: FragmentCodec) -> DataFrame:
    """Records with rendered fragment, decoded URL, status (exact, mismatch, encode-error or decode-error) and reason."""
    rows = records.withColumn("e", encode_fragment(F.col("url"), codec))
    rows = rows.withColumn("d", decode_fragment(F.col("e.value"), codec))
    status = F.when(F.col("e.error").isNotNull(), "encode-error").when(F.col("d.error").isNotNull(), "decode-error").when(F.col("d.value") == F.col("url"), "exact").otherwise("mismatch")
    rows = rows.withColumn("status", status).withColumn("actual", F.col("d.value"))
    reason = F.when(F.col("status") == "mismatch", classify_difference(F.col("url"), F.col("actual"))).otherwise(F.coalesce("e.error", "d.error"))
    size = F.length("e.value")
    return rows.withColumn("reason", reason).withColumn("payload_symbols", size).withColumn("rendered_characters", size).drop("e", "d")


def failures(results: DataFrame, n: int = 10) -> DataFrame:
    """The first n results that aren't exact, in order of arrival."""
    return results.filter("status <> 'exact'").orderBy("ordinal").limit(n)


def payload_ratios(results: DataFrame, payload_bytes: str = "payload_bytes", url_bytes: str = "url_bytes") -> DataFrame:
    """Bits a URL, payload over input, and mean characters in two alphabets."""
    n = F.count("*")
    return results.agg(n.alias("urls"), (F.sum(payload_bytes) * 8 / n).alias("bits_per_url"), (F.sum(payload_bytes) / F.sum(url_bytes)).alias("payload_ratio"))

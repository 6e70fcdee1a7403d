"""A crawl's columnar URL index as an external table: its DDL, eligibility and candidate extraction."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.functions.hashing import bucket_width
from linkquarry.operators.sampling import hash_bucket_range

# The public index's columns.
COLUMNS = """url_surtkey string, url string, url_host_name string, url_host_tld string, url_host_2nd_last_part string,
url_host_3rd_last_part string, url_host_4th_last_part string, url_host_5th_last_part string, url_host_registry_suffix string,
url_host_registered_domain string, url_host_private_suffix string, url_host_private_domain string, url_host_name_reversed string,
url_protocol string, url_port int, url_path string, url_query string, fetch_time timestamp, fetch_status smallint,
fetch_redirect string, content_digest string, content_mime_type string, content_mime_detected string, content_charset string,
content_languages string, content_truncated string, warc_filename string, warc_record_offset int, warc_record_length int,
warc_segment string"""


@dataclass(frozen=True)
class IndexSource:
    crawl: str
    location: str = ""
    seed: str = "sample-seed"
    protocols: tuple[str, ...] = ("http", "https")
    statuses: tuple[int, ...] = (200,)
    mime_types: tuple[str, ...] = ("text/html", "application/pdf")
    multiplier: float = 2
    buckets: int = 1_000_000
    table: str = field(default="url_index")


def create_table(spark: SparkSession, source: IndexSource) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {_name(source.table)} ({COLUMNS}, crawl string, subset string) USING parquet PARTITIONED BY (crawl, subset) LOCATION '{_text(source.location)}'")


def add_partition(spark: SparkSession, source: IndexSource, location: str) -> None:
    spark.sql(f"ALTER TABLE {_name(source.table)} ADD IF NOT EXISTS PARTITION (crawl='{_text(source.crawl)}', subset='warc') LOCATION '{_text(location)}'")


def _name(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def _text(value: str) -> str:
    return value.replace("\\", "\\\\").replace("'", "\\'")


def eligible(source: IndexSource) -> Column:
    """Predicate on index rows; crawl, subset, protocol and status reach the scan."""
    return (
        (F.col("crawl") == source.crawl)
        & (F.col("subset") == "warc")
        & F.col("url_protocol").isin(*source.protocols)
        & F.col("fetch_status").isin(*source.statuses)
        & F.coalesce("content_mime_detected", "content_mime_type").isin(*source.mime_types)
        & F.col("url").isNotNull()
        & F.col("url_host_name").isNotNull()
    )


def eligible_rows(index: DataFrame, source: IndexSource) -> DataFrame:
    return index.filter(eligible(source)).select("url", F.col("url_host_name").alias("hostname"))


def acquire(index: DataFrame, source: IndexSource, requested: int, path: str, after: int = 0) -> tuple[int, int]:
    """Write the candidates of the next bucket range as Parquet (zstd); returns the half-open range."""
    rows = eligible_rows(index, source)
    end = min(source.buckets, after + bucket_width(requested, rows.count(), source.multiplier, source.buckets))
    hash_bucket_range(rows, source.seed, after, end, source.buckets).select("url").write.option("compression", "zstd").parquet(path)
    return after, end

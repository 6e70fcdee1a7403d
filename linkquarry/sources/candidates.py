"""Candidate URLs from Parquet, JSON lines and text, in order of arrival."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What scripts call white space: ASCII and Unicode spaces, line ends and the byte order mark.
_SPACE = r"[\t-\r    -     　﻿]"


def candidate_format(path: str) -> str:
    """parquet, jsonl, jsonl-gzip, text or text-gzip by a file's extension, in either case."""
    low = path.lower()
    if low.endswith(".parquet"):
        return "parquet"
    if m := re.search(r"[.](jsonl|ndjson|txt)([.]gz)?\Z", low):
        return ("text" if m[1] == "txt" else "jsonl") + ("-gzip" if m[2] else "")
    raise ValueError(f"no candidate format for {path}")


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{_SPACE}+|{_SPACE}+\z", "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_number from 1, value) of a text file of any size, by two levels of counting over its splits."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("k"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = lines.groupBy("file", "block").agg(F.count("*").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("k")).cast("bigint")
    return lines.withColumn("own", own).join(begins, ["file", "block"]).select((F.col("begin") + F.col("own")).alias("line_number"), "value")


def _json_url(line: Column) -> Column:
    """The URL of a JSON line, which is a string or an object with one; the job fails on anything else."""
    text = F.when(trim(line).startswith('"'), F.from_json(F.concat(F.lit('{"url":'), line, F.lit("}")), "url string", {"mode": "PERMISSIVE"})["url"])
    # A variant tells strings from numbers, which a schema of strings would not.
    parsed = F.try_parse_json(line)
    own = F.when(F.schema_of_variant(F.try_variant_get(parsed, "$.url", "variant")) == "STRING", F.try_variant_get(parsed, "$.url", "string"))
    return F.coalesce(text, own, F.raise_error(F.concat(F.lit("a JSON line is neither a string nor an object with a url: "), F.substring(line, 1, 200))).cast("string"))


def read_file(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """(row_index, url) of one file or folder of one format."""
    kind = kind or candidate_format(path)
    if kind == "parquet":
        df = spark.read.parquet(path)
        if "url" not in df.columns or not isinstance(df.schema["url"].dataType, T.StringType):
            raise ValueError(f"{path} has no string column url")
        checked = F.coalesce(F.col("url"), F.raise_error(F.lit("a candidate row holds no URL")).cast("string"))
        return df.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"), checked.alias("url")).select("row_index", "url")
    lines = numbered_lines(spark, path).select((F.col("line_number") - 1).alias("row_index"), F.col("value"))
    kept = lines.filter(trim(F.col("value")) != "")
    return kept.select("row_index", (trim(F.col("value")) if kind.startswith("text") else _json_url(F.col("value"))).alias("url"))


def read_candidates(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(ordinal, url) of files in list order: ordinals rise with file and row, and leave gaps."""
    out = None
    for k, path in enumerate(paths):
        rows = read_file(spark, path).select((F.lit(k).cast("bigint") * (1 << 42) + F.col("row_index") + 1).alias("ordinal"), "url")
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "ordinal long, url string")


_RECORD = "url string, timestamp string, tags array<string>"


def read_stage0(spark: SparkSession, spec: str, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Records and rejected lines of ``id=path`` or a path (its stem is the id). Only exactly empty lines are skipped;
    ``limit`` counts the other lines. Times other than ISO 8601 and epoch milliseconds become null."""
    name, mark, path = spec.partition("=")
    if not mark:
        path, name = spec, re.sub(r"[.][^.]*\Z", "", spec.rsplit("/", 1)[-1])
    lines = numbered_lines(spark, path).filter("value <> ''")
    if limit is not None:
        lines = lines.orderBy("line_number").limit(limit)
    if path.lower().endswith(".jsonl"):
        parsed = F.try_parse_json("value")
        is_text = F.schema_of_variant(F.try_variant_get(parsed, "$.url", "variant")) == "STRING"
        url = F.when(is_text, F.try_variant_get(parsed, "$.url", "string"))
        stamp = F.try_variant_get(parsed, "$.timestamp", "string")
        time = F.coalesce(F.try_variant_get(parsed, "$.timestamp", "double"), F.unix_millis(F.try_to_timestamp(stamp)).cast("double"))
        tags = F.coalesce(F.try_variant_get(parsed, "$.tags", "array<string>"), F.array().cast("array<string>"))
    else:
        url, time, tags = F.col("value"), F.lit(None).cast("double"), F.array().cast("array<string>")
    rows = lines.select(F.lit(name).alias("source"), F.col("line_number").alias("source_index"), "value", url.alias("url"), time.alias("timestamp"), tags.alias("tags"))
    rejected = rows.filter("url is null").select("source", "source_index", F.col("value").alias("line"), F.lit(None).cast("string").alias("url"), F.lit("record has no string url field").alias("reason"))
    return rows.filter("url is not null").drop("value"), rejected


BENCHMARK = "id string, url string, hostname string, sources array<string>, classes array<string>, splits map<string,string>"


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark records; a malformed line fails the job."""
    return spark.read.schema(BENCHMARK).json(path, mode="FAILFAST")

"""Checks of corpora and packs; a check that finds rows has failed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.operators.splits import leakage_violations, split_counts


class VerificationError(ValueError):
    pass


def schema_matches(df: DataFrame) -> bool:
    """Exactly url (string) and split (an integer that holds 0 to 4)."""
    return [f.name for f in df.schema] == ["url", "split"] and df.schema["url"].dataType.simpleString() == "string" and df.schema["split"].dataType.simpleString() in ("tinyint", "smallint", "int")


def corpus_facts(df: DataFrame) -> DataFrame:
    """Rows, distinct URLs over the whole corpus, and rows that can't be."""
    bad = F.col("url").isNull() | (F.col("url") == "") | F.coalesce(~F.col("split").between(0, 4), F.lit(True))
    return df.agg(F.count("*").alias("rows"), F.count_distinct("url").alias("urls"), F.count_if(bad).alias("invalid"))


def verify_corpus(df: DataFrame, expected: dict | None = None) -> dict:
    """Facts of a corpus with ``hostname``, or VerificationError; ``expected`` has rows, hosts or splits of a manifest."""
    if not schema_matches(df.select("url", "split")):
        raise VerificationError("the schema isn't url and split")
    facts = corpus_facts(df).first()
    if facts["invalid"] or facts["rows"] != facts["urls"]:
        raise VerificationError(f"{facts['invalid']} invalid rows, {facts['rows'] - facts['urls']} duplicates")
    if (broken := leakage_violations(df).limit(5).collect()) :
        raise VerificationError(f"hosts leak between splits: {broken}")
    found = {"rows": facts["rows"], "hosts": df.agg(F.count_distinct("hostname")).first()[0], "splits": [r["rows"] for r in split_counts(df).orderBy("split").collect()]}
    for key, value in (expected or {}).items():
        if key in found and found[key] != value:
            raise VerificationError(f"{key}: {found[key]}, the manifest says {value}")
    return found


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """Path, size and SHA-256 of files."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def canonical_violations(rows: DataFrame) -> DataFrame:
    """Canonical structs whose ledger doesn't lead from the browser's URL to the result."""
    c = F.col("canonical")
    links = F.zip_with(F.concat(F.array(c["browser_url"]), c["changes"]["after"]), F.concat(c["changes"]["before"], F.array(c["url"])), lambda a, b: a == b)
    return rows.filter(c["error_code"].isNull() & ~F.forall(links, lambda x: x))

"""The corpus pipeline: language, near copies, benchmark leaks, secrets, BPE; each stage one operator, written and reread.

Each stage works on the whole of what its predecessor kept. Rows whose columns are null, and ids that repeat, are
handled as the operators say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.llm import bpe, decontaminate, language, nearcopies, secrets, simhash
from linkquarry.llm.common import ensure_checkpoint_dir, spread, table


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (`und`) and those whose letters are strange to every learned language.

    Where no document teaches a language nothing can be strange, and only those without a letter go.
    """
    model = language.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs, model)
    return found.filter((F.col("lang_pred") != "und") & F.col("lang_reliable")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies (five words, Jaccard 0.8 or more, verified); one without an id only where its group has no other."""
    return simhash.one_of_each_group(docs, groups=nearcopies.near_copies)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    found = decontaminate.with_leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by a mark of its kind; no document goes. n_chars follows the new text."""
    found = secrets.scan(docs, with_text=True)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(F.col("n_assign") + F.col("n_access") + F.col("n_hex") + F.col("n_linked") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests that prove the round trip."""
    found = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), with_ids=True)
    return found.select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256", (F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("decoded_sha256")).alias("round_trip"))


STAGES = [("language_id", keep_languages), ("near_dedup", drop_near_copies), ("decontaminate", drop_leaks), ("redact_secrets", redact_secrets), ("encode_bpe", encode)]

#: No stage but the third can be told in SQL.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each one keeps is a table in the shared checkpoint folder, until the next has read it."""
    folder, docs, before = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", spread(table(spark, sf_dir, "documents")), None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return docs

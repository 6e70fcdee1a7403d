"""Command line: ``python -m linkquarry.cli COMMAND``: sample, pack, verify, all and prepare."""

from __future__ import annotations

import argparse
import json
import os

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.operators import prepare, sampling, splits, staging, verify
from linkquarry.session import session
from linkquarry.sources import candidates, corpus
from linkquarry.sources.adversarial import adversarial_cases


def sample(spark: SparkSession, paths: list[str], out: str, count: int, seed: str, host_fraction: float, cap: int, validation: float, test: float, force: bool = False) -> corpus.CorpusManifest:
    """Candidates to a verified corpus; a finished corpus of the same size is kept unless ``force``."""
    manifest = os.path.join(out, "manifest.json")
    if os.path.exists(manifest) and not force:
        found = corpus.CorpusManifest.read(manifest)
        if found.rows == count and found.seed == seed:
            return found
    rows = staging.canonicalized(candidates.read_candidates(spark, paths)).persist(StorageLevel.DISK_ONLY)
    unique = sampling.distinct_candidates(staging.accepted(rows))
    final = splits.five_way_splits(sampling.balanced_sample(unique, count, seed, host_fraction, cap), seed, validation, test).persist(StorageLevel.DISK_ONLY)
    found = corpus.corpus_manifest(final, seed, validation_fraction=validation, test_fraction=test)
    final.select("url", "hostname", F.col("split").cast("tinyint").alias("split")).repartitionByRange(max(1, count // 5_000_000), "url").sortWithinPartitions("url").write.mode("overwrite").option("compression", "zstd").parquet(os.path.join(out, "corpus"))
    counts = {r["code"]: r["rows"] for r in staging.rejection_counts(staging.rejected(rows)).collect()}
    corpus.write_json(os.path.join(out, "staging.json"), {"candidates": rows.count(), "rejected": counts})
    found.write(manifest)
    final.unpersist()
    rows.unpersist()
    return found


def read_sample(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(os.path.join(out, "corpus")).withColumn("split", F.col("split").cast("tinyint"))


def pack(spark: SparkSession, out: str, target: int, ranges: int = 1) -> dict:
    """Write the training pack of a corpus as Parquet of binary columns, bound to the corpus manifest's digest."""
    path = os.path.join(out, "pack")
    corpus.pack_shards(read_sample(spark, out), target, ranges).write.mode("overwrite").parquet(path)
    total = spark.read.parquet(path).agg(F.sum("records").alias("records"), F.sum("url_bytes").alias("url_bytes"), F.count("*").alias("shards")).first().asDict()
    with open(os.path.join(out, "manifest.json"), "rb") as f:
        import hashlib

        total["corpus_manifest_sha256"] = hashlib.sha256(f.read()).hexdigest()
    corpus.write_json(os.path.join(out, "pack.json"), total)
    return total


def check(spark: SparkSession, out: str) -> dict:
    """Verify a corpus against its manifest, and its pack if there is one."""
    manifest = corpus.CorpusManifest.read(os.path.join(out, "manifest.json"))
    found = verify.verify_corpus(read_sample(spark, out), {"rows": manifest.rows, "hosts": manifest.hosts, "splits": manifest.splits})
    bound = os.path.join(out, "pack.json")
    if os.path.exists(bound):
        import hashlib

        with open(bound, encoding="utf-8") as f, open(os.path.join(out, "manifest.json"), "rb") as m:
            wanted, digest = json.load(f), hashlib.sha256(m.read()).hexdigest()
        packed = spark.read.parquet(os.path.join(out, "pack"))
        if (bad := corpus.pack_violations(packed).collect()) or wanted["corpus_manifest_sha256"] != digest:
            raise verify.VerificationError(f"the pack is unsound: {bad or 'it belongs to another corpus'}")
        if packed.agg(F.sum("records")).first()[0] != manifest.rows:
            raise verify.VerificationError("the pack has another number of records")
    return found


def prepare_files(spark: SparkSession, specs: list[str], out: str, normalization: str, seed: str, fraction: float, include_adversarial: bool, limit: int | None) -> dict:
    """Stage-0 corpus of sources: records, rejected rows and a summary as JSON."""
    raw, unparsed = None, None
    for k, spec in enumerate(specs):
        rows, lost = candidates.read_stage0(spark, spec, limit)
        rows = rows.withColumn("ordinal", F.lit(k << 42) + F.col("source_index"))
        raw, unparsed = (rows, lost) if raw is None else (raw.unionByName(rows), unparsed.unionByName(lost))
    if include_adversarial:
        # 273 fixed rows, numbered in one partition.
        extra = adversarial_cases(spark).coalesce(1).withColumn("source_index", F.monotonically_increasing_id() + 1).select(F.lit("built-in-adversarial").alias("source"), "source_index", "url", F.lit(None).cast("double").alias("timestamp"), "tags").withColumn("ordinal", F.lit(len(specs) << 42) + F.col("source_index"))
        raw = extra if raw is None else raw.unionByName(extra)
    raw = raw.persist(StorageLevel.DISK_ONLY)
    records, rejected = prepare.prepare(raw, seed, fraction, normalization)
    records = records.persist(StorageLevel.DISK_ONLY)
    records.write.mode("overwrite").json(os.path.join(out, "records"))
    (rejected.unionByName(unparsed) if unparsed is not None else rejected).write.mode("overwrite").json(os.path.join(out, "rejected"))
    summary = prepare.summary(prepare.normalized(raw, normalization), records, unparsed).first().asDict()
    summary["splits"] = [r.asDict() for r in splits.assignment_counts(records).collect()]
    corpus.write_json(os.path.join(out, "summary.json"), summary)
    return summary


def _yes(text: str) -> bool:
    if text.lower() not in ("true", "false"):
        raise argparse.ArgumentTypeError("true or false")
    return text.lower() == "true"


def _size(text: str) -> int:
    import re

    m = re.fullmatch(r"([0-9]+(?:\.[0-9]+)?)\s*(B|KB|MB|GB|KIB|MIB|GIB)?", text, re.I)
    unit = {"B": 1, "KB": 1000, "MB": 10**6, "GB": 10**9, "KIB": 1 << 10, "MIB": 1 << 20, "GIB": 1 << 30}
    n = int(float(m[1]) * unit[(m[2] or "B").upper()]) if m else 0
    if not 0 < n < 2**53:
        raise argparse.ArgumentTypeError(f"invalid byte size {text!r}")
    return n


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="linkquarry")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("sample", "pack", "verify", "all"):
        p = commands.add_parser(name)
        p.add_argument("--out", default="data")
        p.add_argument("--target-shard-bytes", type=_size, default=256 << 20)
        if name in ("sample", "all"):
            p.add_argument("--candidate-file", action="append", required=True)
            p.add_argument("--count", type=int, required=True)
            p.add_argument("--seed", default="sample-seed")
            p.add_argument("--host-fraction", type=float, default=0.8)
            p.add_argument("--maximum-urls-per-host", type=int, default=16)
            p.add_argument("--validation-fraction", type=float, default=0.1)
            p.add_argument("--test-fraction", type=float, default=0.1)
            p.add_argument("--force", type=_yes, nargs="?", const=True, default=False)
    p = commands.add_parser("prepare")
    p.add_argument("--input", action="append", default=[])
    p.add_argument("--out", default="data/prepared")
    p.add_argument("--normalization", choices=prepare.NORMALIZATIONS, default="clean")
    p.add_argument("--seed", default="sample-seed")
    p.add_argument("--test-fraction", type=float, default=0.1)
    p.add_argument("--include-adversarial", type=_yes, nargs="?", const=True, default=False)
    p.add_argument("--limit", type=int)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = arguments().parse_args(argv)
    spark = spark or session()
    if a.command == "prepare":
        return prepare_files(spark, a.input, a.out, a.normalization, a.seed, a.test_fraction, a.include_adversarial, a.limit)
    done: dict = {}
    if a.command in ("sample", "all"):
        done = vars(sample(spark, a.candidate_file, a.out, a.count, a.seed, a.host_fraction, a.maximum_urls_per_host, a.validation_fraction, a.test_fraction, a.force))
    if a.command in ("pack", "all"):
        done = pack(spark, a.out, a.target_shard_bytes)
    if a.command in ("verify", "all"):
        done = check(spark, a.out)
    return done


if __name__ == "__main__":
    print(json.dumps(main(), indent=2))


__all__ = ["arguments", "check", "main", "pack", "prepare_files", "sample"]

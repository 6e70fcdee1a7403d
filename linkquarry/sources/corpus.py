"""Durable corpora and training packs: writers, readers, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkquarry.operators import verify

#: Shard sizes that 32-bit offsets can address.
LARGEST_SHARD = 2**32 - 2


def write_corpus(rows: DataFrame, path: str, files: int = 1) -> None:
    """(url, split) sorted by URL, zstd; more than one file is cut by ranges of the URL, so it scales and stays sorted."""
    rows.select("url", F.col("split").cast("tinyint").alias("split")).repartitionByRange(files, "url").sortWithinPartitions("url").write.option("compression", "zstd").parquet(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(url, split); unsigned bytes of other writers are read as small integers and narrowed."""
    return spark.read.parquet(path).select("url", F.col("split").cast("tinyint").alias("split"))


PACK = "shard int, records bigint, url_bytes bigint, bytes binary, offsets binary, splits binary"


def pack_shards(corpus: DataFrame, target_bytes: int = 256 << 20, ranges: int = 1) -> DataFrame:
    """Shards of packed URLs in order of the URL: concatenated bytes, N + 1 little-endian offsets, N splits.

    A shard closes before the URL that would take it past the target; a longer URL is a shard alone. That cut is
    sequential, so it runs within each of ``ranges`` ranges of the URL side by side; one range gives one sequence over
    the whole corpus, more give one short shard more each. Shard numbers rise with the URL, and leave gaps between ranges."""
    if not 0 < target_bytes <= LARGEST_SHARD:
        raise ValueError("the target must be positive and below 2^32 - 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, index = [], 0, TaskContext.get().partitionId() << 16
        for batch in batches:
            for url, split in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(url.encode("utf-8"))
                if held and size + n > target_bytes:
                    yield from _pack_table(index, held).to_batches()
                    held, size, index = [], 0, index + 1
                held.append((url, split))
                size += n
        if held:
            yield from _pack_table(index, held).to_batches()

    return corpus.select("url", "split").repartitionByRange(ranges, "url").sortWithinPartitions("url").mapInArrow(run, PACK)


def _pack_table(index: int, rows: list) -> pa.Table:
    data = [u.encode("utf-8") for u, _ in rows]
    offsets = np.cumsum([0, *map(len, data)]).astype("<u4")
    out = {"shard": [index], "records": [len(data)], "url_bytes": [int(offsets[-1])], "bytes": [b"".join(data)], "offsets": [offsets.tobytes()], "splits": [bytes(s for _, s in rows)]}
    return pa.table(out, schema=pa.schema([("shard", pa.int32()), ("records", pa.int64()), ("url_bytes", pa.int64()), ("bytes", pa.binary()), ("offsets", pa.binary()), ("splits", pa.binary())]))


def unpack(shards: DataFrame, split: int | None = None) -> DataFrame:
    """(shard, position, url, split) of packed records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data, offsets, splits in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                at, kept = np.frombuffer(offsets, "<u4"), np.frombuffer(splits, np.uint8)
                which = np.flatnonzero(kept == split) if split is not None else np.arange(len(kept))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(which), shard, np.int32)), pa.array(which.astype(np.int64)), pa.array([data[at[i] : at[i + 1]].decode("utf-8") for i in which], pa.string()), pa.array(kept[which].astype(np.int8))], names=["shard", "position", "url", "split"])

    return shards.select("shard", "bytes", "offsets", "splits").mapInArrow(run, "shard int, position bigint, url string, split tinyint")


def pack_violations(shards: DataFrame) -> DataFrame:
    """(shard, problem) of packs whose offsets or splits are unsound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, str]] = []
        for batch in batches:
            for shard, n, size, data, offsets, splits in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                at = np.frombuffer(offsets[: len(offsets) // 4 * 4], "<u4").astype(np.int64)
                if len(offsets) != 4 * (n + 1):
                    found.append((shard, "offset-count"))
                elif at[0] != 0 or (np.diff(at) < 0).any() or at[-1] != size or len(data) != size:
                    found.append((shard, "offsets"))
                if len(splits) != n or (np.frombuffer(splits, np.uint8) > 4).any():
                    found.append((shard, "splits"))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in found], pa.int32()), pa.array([p for _, p in found], pa.string())], names=["shard", "problem"])

    return shards.select("shard", "records", "url_bytes", "bytes", "offsets", "splits").mapInArrow(run, "shard int, problem string")


def write_json(path: str, value: object) -> str:
    """Pretty JSON with a newline at the end, put in place by a rename; returns its SHA-256."""
    text = json.dumps(value, indent=2, ensure_ascii=False) + "\n"
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", encoding="utf-8", dir=folder, delete=False) as f:
        f.write(text)
    os.replace(f.name, path)
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


@dataclass(frozen=True)
class CorpusManifest:
    seed: str
    rows: int
    hosts: int
    splits: list[int]
    validation_fraction: float = 0.1
    test_fraction: float = 0.1
    schema_version: int = 1

    def __post_init__(self):
        if self.rows < 0 or self.hosts < 0 or len(self.splits) != 5 or sum(self.splits) != self.rows:
            raise ValueError("the manifest's counts don't fit together")

    def write(self, path: str) -> str:
        return write_json(path, asdict(self))

    @staticmethod
    def read(path: str) -> CorpusManifest:
        with open(path, encoding="utf-8") as f:
            return CorpusManifest(**json.load(f))


def corpus_manifest(rows: DataFrame, seed: str, **fractions) -> CorpusManifest:
    """The manifest of a verified corpus with hostname."""
    return CorpusManifest(seed, **verify.verify_corpus(rows), **fractions)


def length_buckets(rows: DataFrame, seed: int, url_col: str = "url") -> DataFrame:
    """Rows with ``len_bucket`` (0 to 15 by powers of two of the length) in an order that is random by hash."""
    n = F.greatest(F.lit(1), F.octet_length(url_col))
    bucket = F.least(F.lit(15), F.greatest(F.lit(0), F.ceil(F.log2(n)).cast("int")))
    return rows.withColumn("len_bucket", bucket).withColumn("shuffle_key", F.xxhash64(F.lit(seed), url_col))


def batches(rows: DataFrame, batch_size: int, seed: int, url_col: str = "url") -> DataFrame:
    """(len_bucket, batch, size, tokens): rows of like length together, bytes of each padded with zeros to the longest.

    A batch's number counts within its bucket and slice of the hash, so no bucket is ordered in one task."""
    keyed = length_buckets(rows.select(url_col), seed, url_col).withColumn("slice", F.pmod("shuffle_key", F.lit(64)))
    k = F.row_number().over(Window.partitionBy("len_bucket", "slice").orderBy("shuffle_key", url_col)) - 1
    numbered = keyed.withColumn("batch", F.floor(k / F.lit(batch_size)).cast("bigint"))

    def pad(key: tuple, table: pa.Table) -> pa.Table:
        urls = sorted((u.encode("utf-8") for u in table.column(url_col).to_pylist()), key=len)
        width = max(map(len, urls))
        return pa.table({"len_bucket": [key[0].as_py()], "slice": [key[1].as_py()], "batch": [key[2].as_py()], "size": [len(urls)], "tokens": [[list(u.ljust(width, b"\0")) for u in urls]]}, schema=pa.schema([("len_bucket", pa.int32()), ("slice", pa.int64()), ("batch", pa.int64()), ("size", pa.int32()), ("tokens", pa.list_(pa.list_(pa.int16())))]))

    return numbered.groupBy("len_bucket", "slice", "batch").applyInArrow(pad, "len_bucket int, slice bigint, batch bigint, size int, tokens array<array<smallint>>")

"""Deterministic scores, orders, shards and buckets as native columns; each spelling of the hashed text is stated once."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOP = 0xFFFFFFFFFFFFF


def sha256_hex(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def _share(text: Column) -> Column:
    return F.conv(F.substring(sha256_hex(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(_TOP))


def partition_score(seed: str, kind: str, value: Column) -> Column:
    """A number in [0, 1] from 52 bits of SHA-256 over seed, kind and value, NUL between them."""
    return _share(F.concat(F.lit(f"{seed}\0{kind}\0"), value))


def stage0_score(seed: str, value: Column) -> Column:
    return _share(F.concat(F.lit(f"{seed}\0"), value))


def hash_order(seed: str, kind: str, value: Column) -> Column:
    """A hexadecimal sort key: SHA-256 over length-prefixed seed and kind, and the value."""
    return sha256_hex(F.concat(F.lit(f"{len(seed)}:{seed}{len(kind)}:{kind}"), value))


def staging_shard(hostname: Column, shards: int) -> Column:
    return (F.conv(F.substring(sha256_hex(hostname), 1, 8), 16, 10).cast("bigint") % shards).cast("int")


def hash_bucket(seed: str, url: Column, buckets: int) -> Column:
    """A uniform bucket from the engine's own XXH64 (seed 42), never negative."""
    return (F.xxhash64(F.concat(F.lit(f"{len(seed)}:{seed}"), url)).bitwiseAND(F.lit(2147483647)) % buckets).cast("int")


def xxhash64_seed0(url: Column) -> Column:
    """XXH64 with seed 0 over UTF-8, signed, as Trino computes it; null stays null."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import xxhash

        for part in parts:
            yield part.map(lambda u: None if u is None else int.from_bytes(xxhash.xxh64_digest(u.encode(), 0), "big", signed=True)).astype("Int64")

    return run(url)


def bucket_width(requested: int, eligible: int, multiplier: float = 2, buckets: int = 1_000_000) -> int:
    """Buckets to take so that about ``multiplier`` times the requested rows are candidates."""
    if requested <= 0:
        raise ValueError("the number of requested URLs must be positive")
    if eligible < requested:
        raise ValueError(f"only {eligible} eligible rows for {requested} URLs")
    return max(1, -int(-(requested * multiplier / eligible * buckets) // 1))


def check_bucket_range(start: int, end: int, buckets: int) -> None:
    if not (isinstance(start, int) and isinstance(end, int) and 0 <= start < end <= buckets):
        raise ValueError("a bucket range is half open, not empty and inside the buckets")


def loader_seed(base: int, epoch: int, worker: int) -> int:
    """The first eight bytes, little-endian, of SHA-256 over base, epoch and worker, NUL between them."""
    import hashlib

    return int.from_bytes(hashlib.sha256(f"{base}\0{epoch}\0{worker}".encode()).digest()[:8], "little")


def payload_characters(n_bytes: Column, alphabet: int = 84) -> Column:
    """Characters that a payload takes in an alphabet, estimated."""
    return F.ceil(n_bytes * 8 / F.log2(F.lit(float(alphabet)))).cast("bigint")


def xorshift32(seed: int) -> Iterator[float]:
    """Numbers in [0, 1) for exact replays of a reservoir; the seed must not be zero."""
    state = seed & 0xFFFFFFFF
    if state == 0:
        raise ValueError("the seed must not be zero")
    while True:
        state ^= state << 13 & 0xFFFFFFFF
        state ^= state >> 17
        state ^= state << 5 & 0xFFFFFFFF
        yield state / 2**32

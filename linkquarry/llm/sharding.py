"""Jump consistent hashing of stable keys into shards.

The shard of a key follows from the key's 60-bit hash and the number of shards alone, without a ring table; one
more shard takes about one row in (shards + 1) from all others and moves nothing else (Lamping and Veach, 2014).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.llm.common import durable, few

#: Rows of a shard that are put in order in one task.
RUN_ROWS = 50_000


def jump(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key, all keys stepping together."""
    key, bucket, j = key.astype(np.uint64), np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = j[live]
            k = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
            key[live] = k
            j[live] = ((bucket[live] + 1) * (float(1 << 31) / ((k >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
            live = live[j[live] < shards]
    return bucket


@F.pandas_udf(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType())]))
def _jump_both(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for key, shards in parts:
        n, k = int(shards.iloc[0]) if len(shards) else 1, key.to_numpy(dtype=np.uint64)
        yield pd.DataFrame({"shard": jump(k, n).astype(np.int32), "grown_shard": jump(k, n + 1).astype(np.int32)})


def stable_key(col) -> F.Column:
    """60 bits of the MD5 of the key's decimal form; a null key counts as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def assign_shards(docs: DataFrame, shards: int = 16, text_col: str = "text", id_col: str = "doc_id", run_rows: int | None = None) -> DataFrame:
    """One row for each document: id, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard``.

    ``slot`` counts from 0 without gaps in each shard, in order of the key's hash, then of id, checksum and size
    (rows that are equal in all of these are interchangeable). A null text has size 1 and the checksum of the empty
    text; a null id is a key of its own. Slots are made by two levels of counting, so no task orders a whole shard:
    rows are numbered within runs of the hash's range, and each run begins where the runs before it end. A key that
    alone has more than ``run_rows`` rows (``RUN_ROWS`` unless given) follows the others of its run, dealt over as many parts as it needs and
    numbered part by part.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    run_rows = run_rows or RUN_ROWS
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), stable_key(id_col).alias("key__"))
    rows = rows.withColumn("both__", _jump_both("key__", F.lit(shards)))
    runs = max(1, -(-docs.select(F.lit(1)).count() // (run_rows * shards)))
    run = F.floor(F.col("key__") / F.lit(float(1 << 60)) * runs).cast("bigint")
    # Both levels read one table, so a row is counted in the part that it is numbered in.
    rows = durable(rows.select("doc_id", "size", "text_crc32", "key__", F.col("both__.shard").alias("shard"), F.col("both__.grown_shard").alias("grown_shard"), run.alias("run__"), F.monotonically_increasing_id().alias("row__")))
    crowded = durable(rows.groupBy("shard", "run__").count().filter(F.col("count") > 4 * run_rows).select("shard", "run__"))
    hot = rows.join(few(crowded), ["shard", "run__"], "left_semi").groupBy("key__").count().filter(F.col("count") > run_rows)
    hot = durable(hot.select("key__", F.ceil(F.col("count") / run_rows).alias("parts__")))
    part = F.coalesce(F.pmod(F.xxhash64("row__"), "parts__"), F.lit(0))
    rows = rows.join(few(hot), "key__", "left").withColumn("hot__", F.when(F.col("parts__").isNull(), -1).otherwise(F.col("key__"))).withColumn("part__", part).drop("parts__")
    place = ["run__", "hot__", "part__"]
    counted = rows.groupBy("shard", *place).agg(F.count("*").alias("n__"))
    before = Window.partitionBy("shard").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    begins = durable(counted.select("shard", *place, F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("begin__")))
    own = Window.partitionBy("shard", *place).orderBy("key__", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    ranked = rows.withColumn("rank__", F.row_number().over(own).cast("bigint") - 1)
    return ranked.join(few(begins), ["shard", *place]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("begin__") + F.col("rank__")).alias("slot"), "grown_shard")

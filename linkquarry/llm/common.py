"""Shared plumbing of the training-data operators.

Conventions that hold for every operator of this subpackage unless its own docstring says otherwise:

* a null text counts as the empty text, and no row is dropped because of a null in any column;
* repeated rows are separate rows, each with its own result;
* an empty input gives an empty result with the full schema;
* computed columns replace input columns of the same name (compared without case), other extra columns pass through.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.session import spread  # noqa: F401  (the operators' queries take it from here)

#: Bytes of text that a Python worker holds decoded at a time; small slices also stay in the processor's caches.
SLICE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local session without one gets a folder of this machine, a cluster must name its own."""
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="linkquarry-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by files in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles: Spark deletes their files when the driver's JVM has collected what refers to them, which a large heap would put off."""
    spark._jvm.System.gc()


#: Rows of a few numbers up to which a join sends them to every task.
FEW = 1 << 18


def few(df: DataFrame) -> DataFrame:
    """df, marked to be broadcast if its count is no more than ``FEW``; for narrow rows alone. It is evaluated twice."""
    return F.broadcast(df) if df.count() <= FEW else df


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than so many narrow rows need, so that a small table isn't dealt over the partitions of a large one."""
    return df.coalesce(max(8, -(-rows // (1 << 16))))


def slices(batch: pa.RecordBatch, text_index: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive pieces of a batch whose texts have about ``most`` bytes at most (a longer text is a piece alone)."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_index)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column, and the n + 1 offsets of the texts in them; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], at - at[0]


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB instead of the 64 MB of Spark's default, which JVM and worker would each hold; a session's own choice stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64m", "67108864"):
        spark.conf.set(key, str(8 << 20))


_KEPT: dict[Hashable, object] = {}


def kept(key: Hashable, build: Callable[[], object]):
    """The one large thing that a worker process keeps from task to task, such as a tokenizer; it gives way to the next."""
    if key not in _KEPT:
        made = build()
        _KEPT.clear()
        _KEPT[key] = made
    return _KEPT[key]


def give_back(all_kept: bool = False) -> None:
    """Let the system have what this process has freed: workers live long, and each operator would leave its own peak behind."""
    if all_kept:
        _KEPT.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def append_columns(df: DataFrame, text_col: str, schema: T.StructType, make: Callable[[], Callable[[pa.Array], list[pa.Array]]], keeps: bool = False) -> DataFrame:
    """df with the columns of ``schema``, which ``make()(texts)`` computes in an Arrow-batched pass without a shuffle.

    ``make`` runs once in each task (models and tokenizers are loaded there); ``keeps`` leaves what it has ``kept`` to later tasks. Columns of df with a name of
    ``schema`` give way. The text column must be a string column; it is read whole, in slices of bounded bytes.
    """
    bound_batches(df.sparkSession)
    new = {f.name.lower() for f in schema}
    own = [i for i, f in enumerate(df.schema) if f.name.lower() not in new]
    text_index = [f.name.lower() for f in df.schema].index(text_col.lower())
    names = [df.schema[i].name for i in own] + schema.names
    types = [_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            give_back(all_kept=True)
        compute = make()
        for whole in batches:
            for batch in slices(whole, text_index):
                out = [pa.array(x, t) if not isinstance(x, pa.Array) else x.cast(t) for x, t in zip(compute(batch.column(text_index)), types, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in own] + out, names=names)
        give_back()

    return df.mapInArrow(run, T.StructType([df.schema[i] for i in own] + list(schema)))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def held_out(doc_id) -> F.Column:
    """True for the third of the documents that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def hash_share(*cols) -> F.Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))

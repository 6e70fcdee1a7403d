"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by their number of distinct shingles, in powers of two. An item's sketch is the bottom
of one MinHash order, and its length follows from the partition's upper size: a document that holds a share c of
an item's n shingles misses at most n - ceil(c n) of them, so one of the item's first n - ceil(c n) + 1 shingles in that
order is in the document. Sketches of that length find every document over the threshold, however long it is.
Candidates are verified by exact containment of the shingles themselves.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns, text_bytes

WORDS = 5
CONTAINMENT = 0.8
#: Bytes of item texts that one pass over the documents looks for; more items take more passes.
BLOCK_BYTES = 8 << 20

_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_INSIDE = np.zeros(256, bool)
_INSIDE[[*b"0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_INSIDE[128:] = True
_MIX = np.random.default_rng(20_170).integers(1, 1 << 63, 256, dtype=np.uint64)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_C = [np.uint64(c) for c in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles_of(text: str | None, words: int = WORDS) -> set[str]:
    """Distinct runs of ``words`` words; of fewer words the whole sequence; of none nothing."""
    own = words_of(text or "")
    if not own:
        return set()
    return {" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash and text index of every shingle, repeats included, of lower-cased texts."""
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = _INSIDE[data]
    inside_before = np.concatenate([[False], inside[:-1]])
    inside_before[at[:-1][at[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~inside_before)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_here = np.empty(len(data), bool)
    ends_here[:-1], ends_here[-1] = ~inside[1:], True
    ends_here[at[1:][at[1:] > 0] - 1] = True
    ends = np.flatnonzero(inside & ends_here) + 1
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_MIX[data] * _powers(_P, len(data)), dtype=np.uint64)])
        word = (sums[ends] - sums[starts]) * _powers(_P_INV, len(data))[starts]
        word ^= word >> np.uint64(29)
        word *= np.uint64(0xBF58476D1CE4E5B9)
        word ^= word >> np.uint64(32)
        doc = np.searchsorted(at, starts, side="right") - 1
        count = np.bincount(doc, minlength=len(texts))
        total = np.zeros(max(0, len(word) - words + 1), np.uint64)
        for k in range(words):
            total += word[k : k + len(total)] * _C[k % len(_C)]
        whole = doc[: len(total)] == doc[words - 1 :] if len(total) else np.zeros(0, bool)
        hashes, owner = total[whole], doc[: len(total)][whole]
        if ((count > 0) & (count < words)).any():
            few = np.flatnonzero((count > 0) & (count < words))
            first = np.searchsorted(doc, few)
            short = np.array([np.add.reduce(word[f : f + count[d]] * np.array(_C[: count[d]])) + np.uint64(count[d]) for f, d in zip(first, few, strict=True)], np.uint64)
            hashes, owner = np.concatenate([hashes, short]), np.concatenate([owner, few])
        hashes = hashes ^ (hashes >> np.uint64(31))
    return hashes, owner


class Items:
    """A block of test items: shingles, sketches by size partition, and the table of all sketch hashes."""

    def __init__(self, ids: list, texts: list, words: int = WORDS, containment: float = CONTAINMENT):
        self.ids, self.words, self.shingles = ids, words, [shingles_of(t, words) for t in texts]
        hashes, owner = shingle_hashes(pa.array(texts, pa.string()), words)
        owned: list[list] = [[] for _ in ids]
        if len(owner):
            order = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[order])) + 1
            for part in np.split(order, cuts):
                owned[owner[part[0]]] = np.unique(hashes[part])
        self.need = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in self.shingles]
        sketch, item = [], []
        for i, own in enumerate(owned):
            if len(own):
                upper = 1 << (len(own) - 1).bit_length()
                length = min(len(own), upper - math.ceil(containment * upper - 1e-9) + 1)
                sketch.append(np.sort(own)[:length])
                item.append(np.full(length, i))
        self.sketch = np.concatenate(sketch) if sketch else np.zeros(0, np.uint64)
        self.item = np.concatenate(item) if item else np.zeros(0, np.int64)
        order = np.argsort(self.sketch, kind="stable")
        self.sketch, self.item = self.sketch[order], self.item[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.sketch & np.uint64((1 << 20) - 1)] = True

    def found_in(self, texts: pa.Array) -> list[list[tuple]]:
        """For each text the (item id, shingles of the item, shared shingles) over the threshold, by position of the item."""
        out: list[list[tuple]] = [[] for _ in range(len(texts))]
        hashes, owner = shingle_hashes(texts, self.words)
        keep = self.bits[hashes & np.uint64((1 << 20) - 1)]
        hashes, owner = hashes[keep], owner[keep]
        low, high = np.searchsorted(self.sketch, hashes, "left"), np.searchsorted(self.sketch, hashes, "right")
        hit = high > low
        pairs = np.unique(np.concatenate([np.stack([np.full(b - a, d), self.item[a:b]], 1) for d, a, b in zip(owner[hit], low[hit], high[hit], strict=True)]), axis=0) if hit.any() else np.zeros((0, 2), int)
        own, of = set(), -1
        for d, i in pairs.tolist():
            if d != of:
                own, of = shingles_of(texts[d].as_py(), self.words), d
            shared = len(own & self.shingles[i])
            if shared >= self.need[i]:
                out[d].append((self.ids[i], len(self.shingles[i]), shared))
        return out


def item_blocks(benchmark: DataFrame, text_col: str = "text", id_col: str = "item_id", words: int = WORDS, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES):
    """Blocks of items, each brought to the driver alone: their number grows with the items, their size doesn't."""
    rows = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    blocks = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    for b in range(blocks):
        own = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        yield Items([r["item_id"] for r in own], [r["text"] for r in own], words, containment)


_FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("n_shared", T.LongType())]))


def with_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "leaks", **how) -> DataFrame:
    """docs with ``leaks``: the items contained in the document, as (item_id, n_shingles, n_shared).

    Items with a null text, or without a word, are in no document; an item of fewer than ``words`` words is one
    shingle and is only in a document of the same few words. A null or empty document has no leaks. Items that
    repeat in all columns count once.
    """
    out = None
    for items in item_blocks(benchmark, **how):
        if out is None:
            out = _leaks(docs, items, text_col, name)
        else:
            more = f"{name}__more"
            out = _leaks(out, items, text_col, more)
            out = out.withColumn(name, F.concat(name, more)).drop(more)
    return out


def _leaks(docs: DataFrame, items: Items, text_col: str, name: str) -> DataFrame:
    fields, kind = ("item_id", "n_shingles", "n_shared"), pa.list_(pa.struct([("item_id", pa.int64()), ("n_shingles", pa.int64()), ("n_shared", pa.int64())]))

    def compute(texts: pa.Array) -> list:
        return [pa.array([[dict(zip(fields, x, strict=True)) for x in found] for found in items.found_in(texts)], kind)]

    return append_columns(docs, text_col, T.StructType([T.StructField(name, _FOUND)]), lambda: compute)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """One row for each document and item it contains: doc_id, item_id, n_shingles, n_shared and containment."""
    rows, own = None, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    for items in item_blocks(benchmark, **how):
        found = _leaks(own, items, "text", "leaks").select("doc_id", F.explode("leaks").alias("leak"))
        rows = found if rows is None else rows.unionByName(found)
    return rows.select("doc_id", "leak.item_id", "leak.n_shingles", "leak.n_shared", (F.col("leak.n_shared") / F.col("leak.n_shingles")).alias("containment"))

"""Language identification by multilingual mixture inference.

Each language has a multinomial over hashed byte trigrams of lower-cased letters. A document is cut into
observations of four words; expectation-maximisation estimates the share of each language from the
observations' likelihoods, and languages leave the set one by one while the penalised likelihood
(log-likelihood less half the number of languages times the log of the number of observations, times
``penalty``) improves. The documents of a slice go through it together as flat numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns, hash_share, held_out, slices, text_bytes

BUCKETS = 1 << 14
WORDS = 4
#: Share of trigrams that some language must know; by chance, through shared buckets, about a tenth are.
FAMILIAR = 0.3
_LETTER = np.full(256, 32, np.uint8)
_LETTER[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _LETTER[_c], _LETTER[_c - 32] = _c, _c


@dataclass
class LanguageModel:
    languages: list[str]
    log_p: np.ndarray  # BUCKETS x languages, float32


def observations(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket for every byte, start byte of every observation, and the document of every observation."""
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    none = np.zeros(0, np.int64)
    if len(data) == 0:
        return none, none, none
    mapped = _LETTER[data]
    first = np.zeros(len(data), bool)
    first[at[:-1][at[:-1] < len(data)]] = True
    before = np.empty_like(mapped)
    before[0], before[1:] = 32, mapped[:-1]
    before[first] = 32
    after = np.empty_like(mapped)
    after[-1], after[:-1] = 32, mapped[1:]
    after[:-1][first[1:]] = 32
    code = before.astype(np.uint32) << 16 | mapped.astype(np.uint32) << 8 | after
    bucket = ((code * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)
    bucket[mapped == 32] = BUCKETS  # no letter here: no evidence
    starts = np.flatnonzero((mapped != 32) & (before == 32))
    if len(starts) == 0:
        return bucket, none, none
    doc = np.searchsorted(at, starts, side="right") - 1
    run = np.arange(len(starts)) - np.searchsorted(doc, doc, side="left")
    every = run % WORDS == 0
    return bucket, starts[every], doc[every]


def fit(docs: DataFrame, max_docs: int = 3000, smoothing: float = 0.2, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Trigram likelihoods from about ``max_docs`` documents of each language, drawn by a hash of the id from those not held out.

    Rows with a null language teach nothing. The table of languages must fit on the driver: a few thousand names at most.
    """
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & ~held_out("id"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, max_docs / counts[k])))])
    drawn = known.filter(hash_share("id", F.lit("language")) < share[F.col("lang")]).select("lang", "text")
    index = {k: i for i, k in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(index), BUCKETS + 1), np.int64)
        for whole in batches:
            for batch in slices(whole, 1):
                for lang in set(batch.column(0).to_pylist()):
                    bucket, _, _ = observations(batch.column(1).filter(pc.equal(batch.column(0), lang)))
                    total[index[lang]] += np.bincount(bucket, minlength=BUCKETS + 1)
        i, b = np.nonzero(total[:, :BUCKETS])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(b), pa.array(total[i, b])], names=["i", "b", "n"])

    summed = drawn.mapInArrow(count, "i long, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), smoothing)
    table[summed["b"].to_numpy(int), summed["i"].to_numpy(int)] += summed["n"].to_numpy(float)
    log_p = np.zeros((BUCKETS + 1, len(languages)), np.float32)
    log_p[:BUCKETS] = np.log(table / table.sum(axis=0))
    return LanguageModel(languages, log_p)


def _mixture(p: np.ndarray, m: np.ndarray, starts: np.ndarray, counts: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM shares and log-likelihoods of documents; p: likelihoods by observation, m: the logs taken out of them."""
    doc = np.repeat(np.arange(len(counts)), counts)
    for _ in range(rounds):
        r = p * share[doc]
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(r, starts, axis=0) / counts[:, None]
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, np.add.reduceat(np.log(np.maximum((p * share[doc]).sum(axis=1), 1e-300)) + m, starts)


def infer(model: LanguageModel, texts: pa.Array, penalty: float = 1.0, rounds: int = 12) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, its share, all shares, and whether enough trigrams are familiar to some language, for each text."""
    n, k = len(texts), len(model.languages)
    shares, reliable = np.zeros((n, k)), np.zeros(n, bool)
    letter = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False).astype(bool)
    bucket, start, doc = observations(texts)
    if k and len(start):
        ll = np.add.reduceat(model.log_p[bucket], start, axis=0).astype(float)
        # Without a letter no trigram has weight, so what lies between observations adds nothing.
        size = np.add.reduceat((bucket < BUCKETS).astype(np.int64), start)
        m = ll.max(axis=1)
        p = np.exp(ll - m[:, None])
        docs, starts, counts = np.unique(doc, return_index=True, return_counts=True)
        share, like = _mixture(p, m, starts, counts, np.full((len(docs), k), 1 / k), rounds)
        live = np.arange(len(docs))
        cost = penalty * 0.5 * np.log(counts + 1.0)
        for left in range(k - 1, 0, -1):
            if not len(live):
                break
            trial = share[live].copy()
            trial[trial == 0] = 2
            drop = trial.argmin(axis=1)
            trial[trial == 2] = 0
            trial[np.arange(len(live)), drop] = 0
            trial /= np.maximum(trial.sum(axis=1, keepdims=True), 1e-300)
            empty = trial.sum(axis=1) == 0
            rows = np.concatenate([np.arange(starts[d], starts[d] + counts[d]) for d in live])
            at = np.concatenate([[0], np.cumsum(counts[live])[:-1]])
            new, fit_ = _mixture(p[rows], m[rows], at, counts[live], trial, max(3, rounds // 3))
            better = (fit_ + cost[live] >= like[live]) & ~empty
            share[live[better]], like[live[better]] = new[better], fit_[better]
            live = live[better]
        shares[docs] = share
        familiar = np.append(model.log_p[:BUCKETS].max(axis=1) > -np.log(BUCKETS), False)
        reliable[docs] = np.add.reduceat(np.add.reduceat(familiar[bucket].astype(np.int64), start), starts) >= FAMILIAR * np.add.reduceat(size, starts)
    best = shares.argmax(axis=1) if k else np.zeros(n, np.int64)
    # A document whose letters are all outside the trigram alphabet falls back on the first language with share 0.
    names = [model.languages[b] if ok and k else "und" for b, ok in zip(best, letter, strict=True)]
    score = np.where(letter, shares[np.arange(n), best] if k else 0.0, 0.0)
    return names, np.clip(score, 0, 1), shares, reliable & letter


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with ``lang_pred``, ``score``, ``lang_shares`` and ``lang_reliable``.

    ``lang_pred`` is the language with the largest share, ties to the first by name, and ``und`` for a text that is
    null or has no letter; ``score`` is that share (0 for ``und``). ``lang_reliable`` is false where less than FAMILIAR
    of the trigrams are likelier in any language than by chance, as for scripts nobody taught.
    """
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_shares", T.ArrayType(T.DoubleType())), T.StructField("lang_reliable", T.BooleanType())])

    def compute(texts: pa.Array) -> list:
        names, score, shares, reliable = infer(model, texts)
        return [pa.array(names, pa.string()), pa.array(score), pa.array(list(shares), pa.list_(pa.float64())), pa.array(reliable)]

    return append_columns(docs, text_col, schema, lambda: compute)

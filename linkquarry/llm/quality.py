"""Quality classifier: histogram gradient-boosted trees over document statistics.

Fitting draws a bounded sample of labelled rows (``max_rows``), bins every statistic by quantiles and grows
trees level by level from gradient histograms on the driver. The trees are complete binary trees flattened
into arrays, so scoring walks all documents of a batch through all trees by numpy indexing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkquarry.llm.common import append_columns, hash_share, held_out, text_bytes

FEATURES = (
    "log_bytes", "log_words", "mean_word", "distinct_words", "lines", "mean_line", "repeated_lines", "longest_word",
    "upper", "lower", "digit", "space", "newline", "period", "comma", "exclaim", "question", "pipe", "symbol", "quote",
    "bracket", "colon", "slash", "control", "high", "words_with_symbol", "upper_words", "entropy",
)

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digit": b"0123456789", "space": b" \t", "newline": b"\n\r",
    "period": b".", "comma": b",", "exclaim": b"!", "question": b"?", "pipe": b"|", "symbol": b"#$%&*@~^+=", "quote": b"\"'`",
    "bracket": b"()[]{}<>", "colon": b":;", "slash": b"/\\_", "control": bytes([*range(9), *range(14, 32), 127]), "high": bytes(range(128, 256)),
}
_MEMBER = np.zeros((256, len(_CLASSES)))
for _k, _members in enumerate(_CLASSES.values()):
    _MEMBER[np.frombuffer(_members, np.uint8), _k] = 1
_SYMBOL_END = re.compile(r"[#$%&*!|]+(?!\S)")


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES for each text, of the whole text; an empty or null text has zeros."""
    data, at = text_bytes(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for i in range(len(texts)):
        raw = data[at[i] : at[i + 1]]
        if not len(raw):
            continue
        text = raw.tobytes().decode("utf-8", "replace")
        words, lines = text.split(), text.split("\n")
        count = np.bincount(raw, minlength=256)
        share = count[count > 0] / len(raw)
        n = max(1, len(words))
        out[i, :8] = (np.log1p(len(raw)), np.log1p(len(words)), len(text) / n, len(set(words)) / n, np.log1p(len(lines)), np.log1p(len(text) / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, words), default=0)))
        out[i, 8:25] = count @ _MEMBER / len(raw)
        out[i, 25:] = (len(_SYMBOL_END.findall(text)) / n, sum(map(str.isupper, words)) / n, -(share * np.log2(share)).sum())
    return out


@dataclass
class BoostedTrees:
    """Complete trees of one depth: ``feature`` and ``cut`` by tree and inner node, ``leaf`` by tree and leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.feature.shape
        rows, node = np.arange(len(x))[:, None], np.zeros((len(x), trees), np.int64)
        t = np.arange(trees)[None, :]
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[rows, self.feature[t, node]] > self.cut[t, node])
        return self.base + self.leaf[t, node - inner].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 48, rate: float = 0.15, l2: float = 2.0, least: float = 4.0) -> BoostedTrees:
    """Logistic boosting; with one class or no rows the model is a constant."""
    inner = 2**depth - 1
    feature, cut, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = BoostedTrees(feature, cut, leaf, float(np.log(p / (1 - p))))
    if len(y) == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width, at = bins + 1, np.full(len(y), model.base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-at))
        g, h = q - y, q * (1 - q)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best, where, which = np.full(count, 1e-9), np.zeros(count, np.int64), np.zeros(count, np.int64)
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = local * width + binned[:, j]
                gs = np.bincount(key, g, count * width).reshape(count, width).cumsum(1)
                hs = np.bincount(key, h, count * width).reshape(count, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain[(hs < least / 4) | (ht - hs < least / 4)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(1)
                better = gain[np.arange(count), k] > best
                best[better], where[better], which[better] = gain[np.arange(count), k][better], k[better], j
            for n in range(count):
                if best[n] > 1e-9:
                    feature[t, first + n], cut[t, first + n] = which[n], edges[which[n]][where[n]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        g_leaf, h_leaf = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf[t] = -rate * g_leaf / (h_leaf + l2)
        at = at + leaf[t, node - inner]
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality") -> BoostedTrees:
    """Trees fitted on about ``max_rows`` labelled documents, drawn by a hash of the id from those not held out.

    Null ids, null labels and labels other than 0 and 1 teach nothing; a document with several labels counts once
    with the smallest; several documents with one id count once, with the smallest vector of statistics.
    """
    usable = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    usable = usable.filter(~held_out("id")).groupBy("id").agg(F.min("y").alias("y"))
    total = usable.count()
    # The sample has max_rows rows in expectation, whatever the size of the labels: that bounds the broadcast and the collect.
    drawn = usable.filter(hash_share("id", F.lit("quality")) < min(1.0, max_rows / max(1, total)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "id")
    schema = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = append_columns(texts, "text", schema, lambda: lambda t: [pa.array(list(statistics(t)), pa.list_(pa.float64()))])
    rows = rows.groupBy("id", "y").agg(F.min("x").alias("x")).toPandas().sort_values("id")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["y"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: BoostedTrees, text_col: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 up). Null and empty texts score as a text without words."""
    schema = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def compute(texts: pa.Array) -> list:
        score = model.score(statistics(texts))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return append_columns(docs, text_col, schema, lambda: compute)

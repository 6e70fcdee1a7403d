"""Approximate nearest neighbours by adaptive dimension scans within probed lists.

An inverted-file index is fitted on a bounded sample (k-means); every row belongs to the list of its nearest
centroid. Vectors are rotated by a random orthogonal matrix and kept in blocks of columns. A query scans the lists
it probes block by block: from the squared distance over the first d of D rotated columns, a candidate is dropped
once that distance, scaled by D / d, exceeds the query's threshold by the factor (1 + e / sqrt(d))^2, a hypothesis
test whose risk e sets (Gao and Long, 2023). Survivors get their exact distance on the original vectors.

The base is scanned where it lies, once for each block of queries, and never shuffled, so a list with any share of the
rows is no hot spot. Thresholds start from the query's neighbours in the sample, and each task sends at most k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkquarry.llm.common import hash_share

SAMPLE = 12_000
LISTS = 64
QUERY_BLOCK = 4096
COLUMNS = 16
RISK = 2.5
#: Share of the sample's true neighbours that the probed lists must hold; more than the recall asked of the whole.
PROBED = 0.975


@dataclass
class Index:
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample: np.ndarray
    sample_ids: np.ndarray


def usable(vectors: DataFrame, vec_col: str, id_col: str, dim: int | None = None) -> tuple[DataFrame, int]:
    """Rows (vec_id, v) whose id isn't null and whose vector is whole: of the commonest length (or ``dim``), finite, not null and not zero."""
    v = F.col(vec_col)
    rows = vectors.select(F.col(id_col).alias("vec_id"), v.cast("array<double>").alias("v"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    if dim is None:
        most = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
        dim = most["n"] if most else 0
    return rows.filter(F.size("v") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def fit_index(rows: DataFrame, dim: int, k: int = 10, lists: int = LISTS, sample: int = SAMPLE, probed: float = PROBED, seed: int = 5) -> Index:
    """Rotation, centroids and number of probes, from about ``sample`` rows drawn by a hash of their id."""
    total = rows.count()
    got = rows.filter(hash_share("vec_id", F.lit("ann")) < min(1.0, sample / max(1, total))).limit(2 * sample).toPandas()
    x, ids = np.array(got["v"].tolist(), dtype=float).reshape(len(got), dim), got["vec_id"].to_numpy()
    order = np.lexsort((*x.T[::-1], ids)) if len(x) else np.zeros(0, int)
    order = order[np.unique(ids[order], return_index=True)[1]] if len(x) else order  # one row an id: the thresholds count ids
    x, ids = x[order], ids[order]
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0] if dim else np.zeros((0, 0))
    turned = x @ rotation
    unique = np.unique(turned, axis=0) if len(x) else turned
    lists = max(1, min(lists, len(unique) // 20 or 1))
    centroids = unique[rng.permutation(len(unique))[:lists]] if len(unique) else np.zeros((1, dim))
    for _ in range(12 if len(unique) else 0):
        near = _sq(unique, centroids).argmin(1)
        centroids = np.stack([unique[near == c].mean(0) if (near == c).any() else centroids[c] for c in range(len(centroids))])
    probes = len(centroids)
    if len(x) > 50:
        q = turned[rng.permutation(len(x))[:300]]
        d = _sq(q, turned)
        true = np.argsort(d, axis=1)[:, 1 : k + 1]
        rank = np.argsort(np.argsort(_sq(q, centroids), axis=1), axis=1)
        needed = np.sort(rank[np.arange(len(q))[:, None], _sq(turned, centroids).argmin(1)[true]].ravel())
        probes = int(needed[min(len(needed) - 1, int(np.ceil(probed * len(needed))))]) + 1
    return Index(rotation, centroids, probes, x, ids)


class Scanner:
    """Scans batches of rows for one block of queries and keeps each query's k best."""

    def __init__(self, index: Index, ids: np.ndarray, queries: np.ndarray, k: int):
        self.index, self.ids, self.queries, self.k = index, ids, queries, k
        self.turned = queries @ index.rotation
        near = np.argsort(_sq(self.turned, index.centroids), axis=1)[:, : index.probes]
        probed = np.zeros((len(ids), len(index.centroids)), bool)
        np.put_along_axis(probed, near, True, axis=1)
        self.probing: list[np.ndarray] = [np.flatnonzero(probed[:, c]) for c in range(len(index.centroids))]
        self.best: list[list[tuple[float, int]]] = [[] for _ in ids]
        self.limit = np.full(len(ids), np.inf)
        if len(index.sample) > k:
            lists = _sq(index.sample @ index.rotation, index.centroids).argmin(1)
            for s in range(0, len(ids), 256):
                d = _sq(queries[s : s + 256], index.sample)
                d[ids[s : s + 256, None] == index.sample_ids[None]] = np.inf
                d[~probed[s : s + 256][:, lists]] = np.inf
                # Rows of the sample are rows of the base, so the k-th best of the probed lists is no worse than this; the margin is for rounding.
                self.limit[s : s + 256] = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) + 1e-12

    def scan(self, vec_ids: np.ndarray, x: np.ndarray) -> None:
        turned = x @ self.index.rotation
        lists = _sq(turned, self.index.centroids).argmin(1)
        dim = x.shape[1]
        for c in np.unique(lists):
            own = np.flatnonzero(lists == c)
            blocks = [np.ascontiguousarray(turned[own, a : a + COLUMNS]) for a in range(0, dim, COLUMNS)]
            for q in self.probing[c]:
                live, partial, seen = np.arange(len(own)), np.zeros(len(own)), 0
                for a, block in zip(range(0, dim, COLUMNS), blocks, strict=True):
                    diff = block[live] - self.turned[q, a : a + COLUMNS]
                    partial = partial + np.einsum("ij,ij->i", diff, diff)
                    seen += block.shape[1]
                    risk = (1 + RISK / np.sqrt(seen)) ** 2 if seen < dim else 1 + 1e-9
                    keep = partial * (dim / seen) <= self.limit[q] * risk + 1e-12
                    live, partial = live[keep], partial[keep]
                    if not len(live):
                        break
                if len(live):
                    self._offer(q, vec_ids[own[live]], x[own[live]])

    def _offer(self, q: int, vec_ids: np.ndarray, x: np.ndarray) -> None:
        other = vec_ids != self.ids[q]
        score = np.sqrt(((x[other] - self.queries[q]) ** 2).sum(1))
        nearest: dict[int, float] = {}
        for s, v in sorted([*self.best[q], *zip(score.tolist(), vec_ids[other].tolist(), strict=True)]):
            nearest.setdefault(v, s)
            if len(nearest) == self.k:
                break
        self.best[q] = [(s, v) for v, s in nearest.items()]
        if len(self.best[q]) == self.k:
            self.limit[q] = min(self.limit[q], self.best[q][-1][0] ** 2 * (1 + 1e-9) + 1e-12)


def search(base: DataFrame, queries: DataFrame, k: int = 10, vec_col: str = "embedding", id_col: str = "vec_id", dim: int | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of base found for each query, nearest first, ties to the smaller id.

    Score is the Euclidean distance in double precision on the original vectors. Rows that ``usable`` refuses take
    no part. A query's own id is never its candidate. Ids are keys: of several rows with one id the first by vector
    is the query, and a candidate id counts once, with its nearest row. Fewer than k candidates give fewer rows.
    """
    rows, dim = usable(base, vec_col, id_col, dim)
    asked, _ = usable(queries, vec_col, id_col, dim)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    index = fit_index(rows, dim, k)
    blocks, out = max(1, -(-asked.count() // block)), None
    for b in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toPandas()
        ids, q = own["vec_id"].to_numpy(dtype=np.int64), np.array(own["v"].tolist(), dtype=float).reshape(len(own), dim)

        def scan(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            scanner = None
            for batch in batches:
                if batch.num_rows and len(ids):
                    scanner = scanner or Scanner(index, ids, q, k)
                    scanner.scan(batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1), dim))
            found = [(int(ids[i]), v, s) for i, best in enumerate(scanner.best if scanner else []) for s, v in best]
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

        found = rows.mapInArrow(scan, "query_id long, vec_id long, score double")
        out = found if out is None else out.unionByName(found)
    out = out.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def exact_sql(every: int = 100, k: int = 10) -> str:
    """Brute force in DuckDB SQL over ``embeddings``, to measure recall against."""
    return f"""
SELECT q.vec_id AS query_id, e.vec_id, list_distance(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score
FROM embeddings q JOIN embeddings e ON q.vec_id % {every} = 0 AND q.vec_id <> e.vec_id
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score, e.vec_id) <= {k}
"""

"""SimHash near-duplicate groups through vantage-point trees.

Fingerprints that are equal form a class first, so copies cost one row. The distinct fingerprints are dealt to
shards by a vantage-point tree fitted on a bounded sample: each inner node splits by Hamming distance to its
vantage fingerprint. A fingerprint is at home in one shard, and is sent as a query to every further shard whose
region the triangle bound can't exclude; of two near fingerprints whose homes part at a node, the one inside the
radius crosses over, so each pair meets exactly once. Shards search themselves by smaller trees of the same kind and
compare bits in their leaves. They return a spanning forest of their links, not all pairs, and components are
joined by alternating star contractions on the shared store, never on the driver. Where the driver's sample is too
small for shards of bounded size, each large shard is dealt on by a tree of its own, fitted on a sample of that shard.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from linkquarry.llm.common import append_columns, durable, few, hash_share, narrow

WORDS = 3
RADIUS = 2
#: Distinct fingerprints that a shard is meant to hold: at least, at most, and the shards that are enough between.
SHARD = 1024
LARGE_SHARD = 1 << 16
SHARDS = 4096
#: Fingerprints of the sample that fits the first tree, and of that of a shard which is dealt on.
SAMPLE = 100_000
OWN_SAMPLE = 4096
#: Sampled fingerprints that a node needs to be split.
SPLIT = 16
#: Rows of a large shard that are dealt on in one task.
PART = 1 << 18
LEAF = 256


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the shingles of a whole text, repeats included; of fewer words that of the whole sequence."""
    tokens = (text or "").encode("utf-8").lower().split()  # on bytes: A-Z only, and exactly the six ASCII spaces
    if not tokens:
        return np.zeros(0, np.uint64)
    line = b" ".join(tokens)
    if len(tokens) < words:
        return np.array([xxh64_intdigest(line, 42)], dtype="<u8")
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    view = memoryview(line)
    return np.array([xxh64_intdigest(view[a:b], 42) for a, b in zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)], dtype="<u8")


def majority(hashes: np.ndarray) -> int:
    """A bit is set where over half of the hashes have it."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 255):  # a block's counts fit in bytes
        ones += np.add.reduce(np.unpackbits(hashes[k : k + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a whole text: a bit is set where over half of the shingles' hashes have it."""
    return majority(shingle_hashes(text, words))


def with_fingerprint(docs: DataFrame, text_col: str = "text", words: int = WORDS, name: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed 64-bit column; a null text counts as empty (fingerprint zero)."""

    def compute(texts: pa.Array) -> list:
        known: dict = {}
        out = np.zeros(len(texts), np.uint64)
        for i, text in enumerate(texts.to_pylist()):
            if (got := known.get(text)) is None:
                got = known[text] = fingerprint(text, words)
            out[i] = got
        return [pa.array(out.view(np.int64))]

    return append_columns(docs, text_col, T.StructType([T.StructField(name, T.LongType())]), lambda: compute)


@dataclass
class Tree:
    """A vantage-point tree in arrays: a node has a vantage and a radius, or, as a leaf, a shard number."""

    vantage: list[int] = field(default_factory=list)
    cut: list[int] = field(default_factory=list)
    inside: list[int] = field(default_factory=list)
    outside: list[int] = field(default_factory=list)
    shard: list[int] = field(default_factory=list)
    shards: int = 0

    def node(self) -> int:
        for x in (self.vantage, self.cut, self.inside, self.outside, self.shard):
            x.append(-1)
        return len(self.vantage) - 1


def _split(points: np.ndarray, rng: np.random.Generator, tries: int = 6) -> tuple[int, int] | None:
    """The vantage and radius, near the median, that leave the fewest points on the boundary; None if none parts the points well."""
    best, choice = 1.0, None
    seen = points if len(points) <= 4096 else points[rng.integers(0, len(points), 4096)]
    for v in points[rng.integers(0, len(points), tries)]:
        d = np.bitwise_count(seen ^ v).astype(np.int64)
        share = np.bincount(d, minlength=66).cumsum() / len(d)
        for r in range(65):
            if 0.3 <= share[r] <= 0.7:
                crossing = share[min(r + RADIUS, 65)] - (share[r - RADIUS] if r >= RADIUS else 0)
                if crossing < best:
                    best, choice = crossing, (int(v), r)
    return choice if best < 0.8 else None


def fit_tree(sample: np.ndarray, weight: float, shard: int = SHARD, seed: int = 7) -> Tree:
    """A tree whose leaves hold about ``shard`` fingerprints, where each of the sample stands for ``weight``."""
    tree, rng = Tree(), np.random.default_rng(seed)

    def grow(points: np.ndarray) -> int:
        at = tree.node()
        split = _split(points, rng) if len(points) * weight > shard and len(points) >= SPLIT else None
        if split is None:
            tree.shard[at] = tree.shards
            tree.shards += 1
            return at
        tree.vantage[at], tree.cut[at] = split
        near = np.bitwise_count(points ^ np.uint64(split[0])) <= split[1]
        tree.inside[at], tree.outside[at] = grow(points[near]), grow(points[~near])
        return at

    grow(sample)
    return tree


def route(tree: Tree, points: np.ndarray, at_home: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shard, index of the point, and whether it is at home there; ``at_home`` tells which points are at home under the tree, the others are queries."""
    out: list[tuple[int, np.ndarray, bool]] = []
    stack = [(0, np.flatnonzero(at_home), np.flatnonzero(~at_home))]
    while stack:
        at, home, query = stack.pop()
        if not len(home) and not len(query):
            continue
        if tree.inside[at] < 0:
            out += [(tree.shard[at], home, True), (tree.shard[at], query, False)]
            continue
        v, r = np.uint64(tree.vantage[at]), tree.cut[at]
        dh = np.bitwise_count(points[home] ^ v).astype(np.int64)
        dq = np.bitwise_count(points[query] ^ v).astype(np.int64)
        stack.append((tree.inside[at], home[dh <= r], query[dq <= r + radius]))
        crossing = home[(dh <= r) & (dh > r - radius)]
        stack.append((tree.outside[at], home[dh > r], np.concatenate([query[dq > r - radius], crossing])))
    shard = np.concatenate([np.full(len(i), s, np.int64) for s, i, _ in out] or [np.zeros(0, np.int64)])
    index = np.concatenate([i for _, i, _ in out] or [np.zeros(0, np.int64)])
    home = np.concatenate([np.full(len(i), h) for _, i, h in out] or [np.zeros(0, bool)])
    return shard, index, home


def forest(home: np.ndarray, query: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """Links (n x 2) that connect whatever pairs of home with home or query within the radius connect: one for each joined point."""
    points = np.concatenate([home, query])
    label = np.arange(len(points))
    rng = np.random.default_rng(11)
    stack = [(np.arange(len(home)), np.arange(len(home), len(points)))]
    while stack:
        h, q = stack.pop()
        if not len(h):
            continue
        split = _split(points[h], rng) if len(h) > leaf else None
        if split is not None:
            v, r = np.uint64(split[0]), split[1]
            dh, dq = np.bitwise_count(points[h] ^ v).astype(np.int64), np.bitwise_count(points[q] ^ v).astype(np.int64)
            stack.append((h[dh <= r], q[dq <= r + radius]))
            stack.append((h[dh > r], np.concatenate([q[dq > r - radius], h[(dh <= r) & (dh > r - radius)]])))
            continue
        both = np.concatenate([h, q])
        width = max(1, (1 << 20) // max(1, len(both)))
        for k in range(0, len(h), width):
            i, j = np.nonzero(np.bitwise_count(points[h[k : k + width], None] ^ points[None, both]) <= radius)
            i, j = h[k : k + width][i], both[j]
            i, j = i[i != j], j[i != j]
            while len(i):
                a, b = label[i], label[j]
                differ = a != b
                if not differ.any():
                    break
                low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
                np.minimum.at(label, high, low)
                while (label[label] != label).any():
                    label = label[label]
    joined = np.flatnonzero(label != np.arange(len(points)))
    return np.stack([points[joined], points[label[joined]]], axis=1)


def _dealt_on(dealt: DataFrame, level: int, radius: int, shard: int) -> DataFrame | None:
    """dealt (shard, fp, home) with every shard of over twice the size dealt on by a tree of its own; None if no shard is so large and can be parted.

    The points of a shard come to several tasks, each of which reads the shard's tree first and then streams the points.
    """
    sizes = dealt.groupBy("shard").agg(F.count_if("home").alias("n"), F.ceil(F.count("*") / PART).alias("parts"))
    large = durable(sizes.filter(F.col("n") > 2 * shard))
    drawn = dealt.filter("home").join(few(large), "shard").filter(hash_share("fp", F.lit(f"vp{level}")) < OWN_SAMPLE / F.col("n"))

    def fit(found: pa.Table) -> pa.Table:
        points = np.sort(found.column("fp").to_numpy().view(np.uint64))
        tree = fit_tree(points, found.column("n")[0].as_py() / len(points), shard)
        return found.select(["shard", "parts"]).slice(0, int(tree.shards > 1)).append_column("tree", pa.array([pickle.dumps(tree)][: int(tree.shards > 1)], pa.binary()))

    trees = durable(drawn.select("shard", "n", "parts", "fp").groupBy("shard").applyInArrow(fit, "shard long, parts long, tree binary"))
    if trees.isEmpty():
        return None

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, own = None, None
        for batch in batches:
            shards, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            points, home = batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy(zero_copy_only=False).astype(bool)
            ends = [0, *(np.flatnonzero((shards[1:] != shards[:-1]) | (parts[1:] != parts[:-1])) + 1).tolist(), len(shards)]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                if a < b and batch.column(4)[a].is_valid:
                    tree, own, a = pickle.loads(batch.column(4)[a].as_py()), (shards[a], parts[a]), a + 1
                if a == b:
                    continue
                if own != (shards[a], parts[a]):
                    raise ValueError("points without the tree of their shard")
                s, i, h = route(tree, points[a:b], home[a:b], radius)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), shards[a])), pa.array(s), pa.array(points[a:b][i].view(np.int64)), pa.array(h)], names=["shard", "sub", "fp", "home"])

    first = trees.select("shard", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"), F.lit(0).cast("bigint").alias("fp"), F.lit(False).alias("home"), "tree")
    known = few(trees.select("shard", "parts"))
    rows = dealt.join(known, "shard").select("shard", F.pmod(F.xxhash64("fp"), "parts").alias("part"), "fp", "home", F.lit(None).cast("binary").alias("tree"))
    sent = first.unionByName(rows).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("tree").isNull())
    moved = sent.mapInArrow(deal, "shard long, sub long, fp long, home boolean")
    # Should two names meet, the shards are searched as one, which loses and adds nothing.
    moved = moved.select(F.xxhash64("shard", "sub", F.lit(level)).alias("shard"), "fp", "home")
    return durable(dealt.join(known, "shard", "left_anti").unionByName(moved))


def links(distinct: DataFrame, radius: int = RADIUS, shard: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) over a column ``fp`` of distinct fingerprints whose components are those of all pairs within the radius.

    ``shard`` is the number of fingerprints meant to be at home in one shard, by default a 4096th of all between 1,024
    and 65,536: the smaller the shards, the more fingerprints cross over. Only fingerprints that no vantage point
    parts make a larger one.
    """
    total = distinct.count()
    shard = shard or min(LARGE_SHARD, max(SHARD, total // SHARDS))
    share = min(1.0, sample / max(1, total))
    drawn = np.array([r[0] for r in distinct.filter(hash_share("fp", F.lit("vp")) < share).select("fp").orderBy("fp").collect()], dtype=np.int64).view(np.uint64)
    weight = total / max(1, len(drawn))
    tree = fit_tree(drawn, weight, shard)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            s, i, h = route(tree, points, np.ones(len(points), bool), radius)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(points[i].view(np.int64)), pa.array(h)], names=["shard", "fp", "home"])

    def search(found: pa.Table) -> pa.Table:
        points, home = found.column("fp").to_numpy().view(np.uint64), found.column("home").to_numpy(zero_copy_only=False).astype(bool)
        pairs = forest(points[home], points[~home], radius)
        return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    if SPLIT * weight > shard:  # the sample, not the size of a shard, may have ended the tree
        dealt, level = durable(dealt), 1
        while (deeper := _dealt_on(dealt, level, radius, shard)) is not None:
            dealt, level = deeper, level + 1
    return dealt.groupBy("shard").applyInArrow(search, "a long, b long")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (a, b), root being the smallest node of its component.

    Alternating large-star and small-star contractions; each round's edges are cut from their lineage in the shared
    checkpoint folder, and only a count and a sum of hashes come to the driver.
    """
    edges = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    last = mark(edges)
    for _ in range(most_rounds):
        rows = last[0]
        if not rows:
            break
        edges = narrow(edges, rows)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = narrow(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), rows)
        large = narrow(both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), rows)
        low = narrow(large.groupBy("a").agg(F.min("b").alias("m")), rows)
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = durable(narrow(small.select("e.a", "e.b").filter("a <> b").distinct(), rows))
        now = mark(edges)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, radius: int = RADIUS, shard: int | None = None) -> DataFrame:
    """One row for each document: id, ``text_hash``, ``fp`` (signed), ``fingerprint`` (16 hexadecimal digits), ``component_id`` and ``root``.

    ``component_id`` is the smallest id reachable over links, the document's own included; null only where a whole
    component has null ids. ``root`` is the component's smallest signed fingerprint, which names it even where ids
    repeat or are null. Texts without words all have fingerprint zero and are one class. Repeated rows, and rows
    with one id and different texts, each keep their own row; ``text_hash`` tells the latter apart (``text_key``).
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = durable(with_fingerprint(own.withColumn("text_hash", text_key("text")), "text", words).select("doc_id", "text_hash", "fp"))
    classes = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes, radius, shard))
    joined = classes.join(roots, classes.fp == roots.node).select("fp", "root", "first")
    named = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = joined.select("fp", "root").join(named, "root").select("fp", "root", "component_id")
    whole = classes.join(grouped, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    return prints.join(durable(whole), "fp").select("doc_id", "text_hash", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "root")


def text_key(text_col: str) -> F.Column:
    """64 bits of a text; null and empty are one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def one_of_each_group(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", groups=near_duplicates, **how) -> DataFrame:
    """docs with one row of each group of near duplicates, as ``groups`` finds them: that with the smallest id, a null id only where no row has another.

    Of several texts with that id in one group the one with the smallest ``text_key`` stays, and of rows equal in both
    any single one. The columns are those of docs. Only the keys of rows that go or repeat are joined with docs: where
    they are few they are broadcast and no text is shuffled.
    """
    found = durable(groups(docs, text_col, id_col, **how).select("doc_id", "text_hash", "component_id", "root"))
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash"))
    *key, stays = (f"{k}__{uuid.uuid4().hex}" for k in ("null", "id", "text", "stays"))

    def keyed(df: DataFrame, own_id: str, text: F.Column) -> list[F.Column]:
        kind = df.schema[own_id].dataType
        zero = F.lit("" if isinstance(kind, T.StringType) else 0).cast(kind)
        return [F.col(own_id).isNull().alias(key[0]), F.coalesce(F.col(own_id), zero).alias(key[1]), text.alias(key[2])]

    rows = found.select(*keyed(found, "doc_id", F.col("text_hash"))).groupBy(key).count()
    marked = rows.join(chosen.select(*keyed(chosen, "doc_id", F.col("text_hash")), F.lit(True).alias(stays)), key, "left")
    marked = durable(marked.filter(F.col(stays).isNull() | (F.col("count") > 1)).select(*key, F.coalesce(stays, F.lit(False)).alias(stays)))
    joined = docs.select("*", *keyed(docs, id_col, text_key(text_col))).join(few(marked), key, "left")
    kept = joined.filter(F.col(stays).isNull())
    if not marked.filter(stays).isEmpty():
        kept = kept.unionByName(joined.filter(stays).dropDuplicates(key))
    return kept.select(*docs.columns)

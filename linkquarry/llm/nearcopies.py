"""Near copies by exact Jaccard similarity of word shingles: SimHash links first, then a prefix filter that loses no pair.

SimHash trees bring most tight groups together cheaply, but a similarity of 0.8 may differ in more bits than trees can
search, so they are not enough. A second search completes them: shingles have one global order, those common in a
sample last, and two sets of similarity t or more share one of their first n - ceil(t n) + 1 shingles. The sample and what
is taken as common decide how many candidates there are, never which pairs are found.

The classes that share a shingle of their prefixes are a meeting. Meetings are counted before they are formed: a signature
(members, least, greatest and exclusive or of their hashes) lets one meeting stand for all with the same members, a meeting
whose classes are joined already is never formed, and a large one is dealt as pairs of blocks. In a meeting only pairs
pass that are not joined yet and hold two bounds: sizes, and differing parity bits, which are never more than the
differing shingles. Rounds first offer each class its nearest partner alone, so a large group of near copies is joined
by about as many links as it has members; what then is still open is verified pair by pair.

Every link of either search is verified on the texts themselves: a pair's greater class travels to the lesser one, a hub,
whose text is sent once for every ``FAN`` partners. Shingles are told apart by 64-bit hashes, and equal sets of
shingles are one class. Texts without a word are one class too.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from linkquarry.llm import simhash
from linkquarry.llm.common import append_columns, bound_batches, durable, few, give_back, hash_share, narrow, release

WORDS = 5
JACCARD = 0.8
#: Documents that tell which shingles are common: this many at least, and this share of a large table.
SAMPLE = 10_000
SHARE = 0.01
#: Common shingles that are told to every task.
COMMON = 1 << 17
#: Members of a meeting that are compared in one task.
BLOCK = 2048
#: Partners that a hub's text is sent for at once.
FAN = 256
#: Rounds of nearest partners, at most, before all that is open is verified.
ROUNDS = 3


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct hashes, ascending, of the shingles of a text; of fewer words that of the whole sequence."""
    return np.unique(simhash.shingle_hashes(text, words))


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of 2^k places, at least one place a shingle, as 64-bit words."""
    places = max(64, 1 << (len(shingles) - 1).bit_length())
    bits = np.bincount((shingles & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def folded(parity: np.ndarray, words: int) -> np.ndarray:
    """Rows of parity words on fewer places: those of s mod 2^k follow from those of s mod 2^(k + 1)."""
    while parity.shape[1] > words:
        half = parity.shape[1] // 2
        parity = parity[:, :half] ^ parity[:, half:]
    return parity


def _lists(sets: list[np.ndarray]) -> pa.Array:
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), pa.int32()), pa.array(values.view(np.int64)))


def common_shingles(docs: DataFrame, words: int = WORDS, sample: int = SAMPLE, share: float = SHARE, most: int = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the shingles that most documents of a sample have, several at least, and in how many."""
    drawn = docs.filter(hash_share("text_hash", F.lit("common")) < min(1.0, max(share, sample / max(1, docs.count())))).select("text").distinct()
    sets = append_columns(drawn, "text", T.StructType([T.StructField("shingles", T.ArrayType(T.LongType()))]), lambda: lambda texts: [_lists([shingle_set(t, words) for t in texts.to_pylist()])])
    found = sets.select(F.explode("shingles").alias("s")).groupBy("s").count().filter("count > 1").orderBy(F.desc("count"), "s").limit(most).toPandas()
    hashes = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(np.int64)[order]


def _described(own: DataFrame, words: int, jaccard: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, text_hash, class, SimHash, number of shingles, their parity bits and the class's prefix."""
    hashes, counts = common

    def describe(text: str | None) -> tuple[int, int, int, bytes, np.ndarray]:
        every = simhash.shingle_hashes(text, words)
        own = np.unique(every)
        if not len(own):
            return 0, 0, 0, b"", own
        rank = np.zeros(len(own), np.int64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
            rank = np.where(hashes[at] == own, counts[at], 0)
        first = own[np.lexsort((own, rank))][: len(own) - math.ceil(jaccard * len(own) - 1e-9) + 1]
        return xxh64_intdigest(own.tobytes(), 43), simhash.majority(every), len(own), parity_bits(own).tobytes(), first

    def compute(texts: pa.Array) -> list:
        known: dict = {}
        rows = [known[t] if t in known else known.setdefault(t, describe(t)) for t in texts.to_pylist()]
        cls, fp, n, parity, prefix = zip(*rows, strict=True) if rows else ([], [], [], [], [])
        return [pa.array(np.array(cls, np.uint64).view(np.int64)), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(np.array(n, np.int64)), pa.array(parity, pa.binary()), _lists(list(prefix))]

    fields = [("cls", T.LongType()), ("fp", T.LongType()), ("n", T.LongType()), ("parity", T.BinaryType()), ("prefix", T.ArrayType(T.LongType()))]
    return append_columns(own, "text", T.StructType([T.StructField(*f) for f in fields]), lambda: compute).drop("text")


def _simhash_pairs(prints: DataFrame) -> DataFrame:
    """Classes of one fingerprint, and of fingerprints that SimHash trees link."""
    of = prints.filter("n > 0").select("fp", "cls").distinct()
    first = durable(of.groupBy("fp").agg(F.min("cls").alias("first")))
    same = of.join(first, "fp").select(F.col("first").alias("a"), F.col("cls").alias("b"))
    near = simhash.links(first.select("fp")).toDF("p", "q")
    near = near.join(first.toDF("p", "a"), "p").join(first.toDF("q", "b"), "q").select("a", "b")
    return same.unionByName(near)


def _pairs(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, own: DataFrame, classes: DataFrame, words: int, jaccard: float) -> DataFrame:
    """Those of the distinct pairs (a < b) of classes whose shingles are as similar as asked."""
    rows = pairs.count()
    pairs = narrow(pairs, rows)
    heavy = durable(pairs.groupBy("a").count().filter(F.col("count") > FAN).select("a", F.ceil(F.col("count") / FAN).alias("parts")))
    asked = narrow(pairs.join(few(heavy), "a", "left"), rows).select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    wanted = asked.select("a", "part", F.col("b").alias("cls")).unionByName(asked.select("a", "part", F.col("a").alias("cls")).distinct())
    keys = durable(narrow(classes.select("cls", "text_hash").join(few(wanted), "cls"), 2 * rows).select("text_hash", "a", "part", "cls"))
    bound_batches(own.sparkSession)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task sends what it holds of a class to a place once, however many copies of the text it has."""
        sent: set[tuple] = set()
        for batch in batches:
            place = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            new = [i for i, x in enumerate(place) if x not in sent and not sent.add(x)]
            if new:
                yield batch.take(pa.array(new))

    texts = own.select("text_hash", "text").join(few(keys), "text_hash").select("a", "part", "cls", "text").mapInArrow(once, "a long, part long, cls long, text string")
    sent = texts.repartition("a", "part").sortWithinPartitions("a", "part", F.col("cls") != F.col("a"), "cls")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, before = None, np.zeros(0, np.uint64), None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, part, cls, text in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                if (a, part, cls) == before:
                    continue
                before, shingles = (a, part, cls), shingle_set(text.as_py(), words)
                if cls == a:
                    hub, own = (a, part), shingles
                    continue
                if (a, part) != hub:
                    raise ValueError("a pair without its hub")
                shared = len(np.intersect1d(own, shingles, assume_unique=True))
                if shared + 1e-9 >= jaccard * (len(own) + len(shingles) - shared):
                    found.append((a, cls))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
        give_back()

    return durable(narrow(sent.mapInArrow(compare, "a long, b long"), rows))


def _meetings(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """(g, k, cls, n, parity, before): the classes that share a shingle g of their prefixes, k in number; one meeting for all with the same members. ``before`` is empty."""
    held = prints.filter("n > 0").select("cls", "prefix")
    shared = held.dropDuplicates(["cls"]).select("cls", F.explode("prefix").alias("g")).groupBy("g").agg(F.count("*").alias("k"), F.min("cls").alias("low"), F.max("cls").alias("high"), F.bit_xor("cls").alias("x")).filter("k > 1")
    met = durable(shared.groupBy("k", "low", "high", "x").agg(F.min("g").alias("g")))
    two = met.filter("k = 2").select("g", "k", F.explode(F.array("low", "high")).alias("cls"))
    more = met.filter("k > 2").select("g", "k")
    members = two.unionByName(held.select("cls", F.explode("prefix").alias("g")).join(few(more), "g").select("g", "k", "cls").distinct())
    return durable(members.join(classes.select("cls", "n", "parity"), "cls").withColumn("before", F.array().cast("array<bigint>")))


def _live(meetings: DataFrame, offers: DataFrame) -> DataFrame:
    """The meetings with offers, ``before`` being a class's other meetings of lesser g: two classes meet in earnest only at the first of theirs.

    Joining more classes lets no further pair pass, so a meeting without offers stays without.
    """
    live = meetings.drop("before").join(few(durable(offers.select("g").distinct())), "g", "left_semi")
    every = live.groupBy("cls").agg(F.collect_list("g").alias("every"))
    return durable(live.join(every, "cls").withColumn("before", F.filter("every", lambda x: x < F.col("g"))).drop("every"))


def _open_blocks(meetings: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """g and lists (cls, n, root, side, parity, before) for every block, or pair of blocks, of the meetings whose classes are not all joined."""
    rooted = meetings.join(few(roots.select(F.col("node").alias("cls"), "root")), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    parted = rooted.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("g")
    parts = F.ceil(F.col("k") / block)
    own = rooted.join(few(durable(parted)), "g", "left_semi").withColumn("side", F.pmod(F.xxhash64("cls"), parts))
    dealt = own.select("g", "cls", "n", "root", "side", "parity", "before", F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("other"))
    grouped = dealt.groupBy("g", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j")).agg(F.collect_list(F.struct("cls", "n", "root", "side", "parity", "before")).alias("m"))
    return grouped.select("g", (F.col("i") != F.col("j")).alias("apart"), *[F.col(f"m.{c}").alias(c) for c in ("cls", "n", "root", "side", "parity", "before")])


def _sets_as_bits(sets: list[np.ndarray]) -> np.ndarray:
    """Rows of 64-bit words, one bit for every value that several of the sets hold."""
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    bits = np.zeros((len(sets), max(1, -(-int(place[-1] + 1) // 64)) * 64), bool)
    several = count[at] > 1
    bits[np.repeat(np.arange(len(sets)), [len(x) for x in sets])[several], place[at][several]] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _pieces(values: pa.Array) -> list[np.ndarray]:
    """The 64-bit words of every list or binary of an array."""
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        flat, ends = values.flatten().to_numpy(zero_copy_only=False), np.cumsum(values.value_lengths().to_numpy(zero_copy_only=False))
    else:
        whole = values.cast(pa.large_binary())
        at = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + len(whole) + 1] // 8
        flat, ends = np.frombuffer(whole.buffers()[2], "<u8", at[-1] - at[0], 8 * at[0]), at[1:] - at[0]
    return np.split(flat, ends[:-1])


def passing(cls: np.ndarray, n: np.ndarray, root: np.ndarray, side: np.ndarray, parity: list[np.ndarray], before: list[np.ndarray], apart: bool, jaccard: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the pairs (indices) that are not joined, did not meet ``before`` and hold both bounds, with their differing bits; ``apart`` takes pairs of two sides only."""
    met = _sets_as_bits(before) if any(map(len, before)) else None
    width = np.array([len(p) for p in parity])
    slack = (1 - jaccard) / (1 + jaccard)
    for w in np.unique(width).tolist():
        rows, later = np.flatnonzero(width == w), np.flatnonzero(width > w)
        later = later[jaccard * n[later] <= n[rows].max() + 1e-9]
        both = np.concatenate([rows, later[np.argsort(width[later], kind="stable")]])
        bits = np.concatenate([folded(np.stack([parity[i] for i in both[width[both] == v]]), w) for v in np.unique(width[both])])
        step = max(1, (1 << 17) // (len(both) * w))
        for k in range(0, len(rows), step):
            at = rows[k : k + step]
            ok = (root[at, None] != root[both]) & (np.minimum(n[at, None], n[both]) + 1e-9 >= jaccard * np.maximum(n[at, None], n[both]))
            ok &= (width[both] > w) | (cls[at, None] < cls[both])
            if apart:
                ok &= side[at, None] != side[both]
            i, j = np.nonzero(ok)
            if len(i):
                differ = np.bitwise_count(bits[k + i] ^ bits[j]).sum(axis=1, dtype=np.int64)
                i, j = at[i], both[j]
                hold = differ <= (n[i] + n[j]) * slack + 1e-9
                if met is not None:
                    hold &= ~(met[i] & met[j]).any(axis=1)
                if hold.any():
                    yield i[hold], j[hold], differ[hold]


def _each_block(jaccard: float, emit: Callable) -> Callable:
    """A function over batches of ``_open_blocks`` that yields what ``emit(g, cls, pieces of passing pairs)`` makes of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, apart = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.concatenate([[0], np.cumsum(batch.column(2).value_lengths().to_numpy(zero_copy_only=False))]).tolist()
            cls, n, root, side = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in range(2, 6))
            parity, before = (_pieces(batch.column(c).flatten()) for c in (6, 7))
            for row, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                yield from emit(g[row], cls[a:b], passing(cls[a:b], n[a:b], root[a:b], side[a:b], parity[a:b], before[a:b], apart[row], jaccard))
        give_back()

    return run


def _all_pairs(blocks: DataFrame, jaccard: float) -> DataFrame:
    def emit(g: int, cls: np.ndarray, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        for i, j, _ in pieces:
            yield pa.RecordBatch.from_arrays([pa.array(cls[i]), pa.array(cls[j])], names=["a", "b"])

    return _pairs(blocks.mapInArrow(_each_block(jaccard, emit), "a long, b long"))


def _count_pairs(blocks: DataFrame, jaccard: float) -> int:
    def emit(g: int, cls: np.ndarray, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(len(i) for i, _, _ in pieces)], pa.int64())], names=["pairs"])

    return blocks.mapInArrow(_each_block(jaccard, emit), "pairs long").agg(F.sum("pairs")).first()[0] or 0


def _nearest(blocks: DataFrame, jaccard: float, turn: int) -> DataFrame:
    """(g, x, y, far): each open class x with its nearest partner in a block, by differing bits; a block's leader, another one each turn, counts as a little nearer than it is, so that links form stars."""

    def emit(g: int, cls: np.ndarray, pieces: Iterator) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            leader = np.argmin(cls.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * turn))
        near, least = np.full(len(cls), -1), np.full(len(cls), np.inf)
        for i, j, differ in pieces:
            x, y, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([differ, differ]).astype(float)
            far[y == leader] *= 0.85
            order = np.lexsort((cls[y], far, x))
            x, y, far = (v[order[np.unique(x[order], return_index=True)[1]]] for v in (x, y, far))
            nearer = (far < least[x]) | ((far == least[x]) & (cls[y] < cls[near[x]]))
            near[x[nearer]], least[x[nearer]] = y[nearer], far[nearer]
        open_ = np.flatnonzero(near >= 0)
        if len(open_):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(open_), g)), pa.array(cls[open_]), pa.array(cls[near[open_]]), pa.array(least[open_])], names=["g", "x", "y", "far"])

    return blocks.mapInArrow(_each_block(jaccard, emit), "g long, x long, y long, far double")


def near_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, jaccard: float = JACCARD, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, ``text_hash``, ``component_id`` and ``root`` for each document, as ``simhash.near_duplicates`` gives them.

    A component joins all documents reachable over pairs whose shingles have a Jaccard similarity of ``jaccard`` or more.
    ``block`` and ``rounds`` decide the cost alone.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", simhash.text_key("text"))
    prints = durable(_described(own, words, jaccard, common_shingles(own, words)))
    classes = durable(prints.filter("n > 0").groupBy("cls").agg(F.min("text_hash").alias("text_hash"), F.min("n").alias("n"), F.min("parity").alias("parity")))
    tested = durable(_pairs(_simhash_pairs(prints)))
    links = _verified(tested, own, classes, words, jaccard)
    meetings, enough, turn = _meetings(prints, classes), max(50_000, classes.count()), 0
    while True:
        release(docs.sparkSession)
        blocks = _open_blocks(meetings, simhash.components(links), block)
        blocks = durable(blocks) if turn else blocks
        last = turn >= rounds or (turn > 0 and _count_pairs(blocks, jaccard) <= enough)
        if last:
            offered = _all_pairs(blocks, jaccard)
        else:
            offers = durable(_nearest(blocks, jaccard, turn))
            meetings = _live(meetings, offers)
            offered = _pairs(offers.groupBy("x").agg(F.min(F.struct("far", "y")).alias("best")).select(F.col("x").alias("a"), F.col("best.y").alias("b")))
        offered = durable(offered.join(tested, ["a", "b"], "left_anti"))
        links = links.unionByName(_verified(offered, own, classes, words, jaccard))
        if last:
            break
        tested, turn, blocks = tested.unionByName(offered), turn + 1, None
    roots = durable(simhash.components(links))
    ids = prints.select("doc_id", "text_hash", "cls").join(few(roots.withColumnRenamed("node", "cls")), "cls", "left")
    ids = durable(ids.select("doc_id", "text_hash", F.coalesce("root", "cls").alias("root")))
    del blocks, offered, meetings
    release(docs.sparkSession)
    named = durable(ids.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return ids.join(few(named), "root").select("doc_id", "text_hash", "component_id", "root")

import random

import numpy as np

import corpus_pipeline
from linkquarry.llm import nearcopies


def brute_shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """The smallest id of each component over pairs of similarity 0.8 or more, by comparing all sets that share a shingle."""
    sets, root, at = [brute_shingles(t) for _, t in rows], list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for h in s:
            at.setdefault(h, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for h in s for j in at[h] if j > i} if s else {j for j, o in enumerate(sets) if not o}:
            if not s or 5 * len(s & sets[j]) >= 4 * len(s | sets[j]):
                root[find(j)] = find(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return sorted(low.values())


def test_stage_against_brute_force(spark, docs, sf):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.select("doc_id").collect()) == brute_kept(rows)


def test_similarity_at_the_border(spark, sf, monkeypatch):
    rng = random.Random(5)
    rows, common = [], " ".join(f"c{i}" for i in range(12))
    for g in range(40):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([9, 30, 49, 94, 300]))]
        rows.append((len(rows), " ".join(own)))
        for _ in range(3):
            cut = rng.randrange(1, max(2, len(own) // 4))
            rows.append((len(rows), " ".join(own[cut:] + [f"v{rng.randrange(10**6)}"] * (g % 3))))
        rows.append((len(rows), " ".join([*own, common])))
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "  ", "a b", "A  b", "a c"])]
    # 100 shingles of which 88 stay shared (88 / 112 < 0.8), and 89 (89 / 111 > 0.8)
    for changed in (12, 11):
        base = [f"b{changed}_{i}" for i in range(104)]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:-changed] + [f"x{i}" for i in range(changed)]))]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute_kept(rows)
    assert rows[-1][0] not in want and rows[-3][0] in want
    for sample in (20_000, 1):  # the sample decides the cost, not the result
        monkeypatch.setattr(nearcopies.common_shingles, "__defaults__", (nearcopies.WORDS, sample, 0.0, nearcopies.COMMON))
        assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, table, sf).collect()) == want


def test_large_groups_in_blocks_and_rounds(spark):
    """A group of near copies around one text, some of which are only joined through others; blocks and rounds don't change the result."""
    rng, rows = random.Random(9), []
    base = [f"m{i}" for i in range(60)]
    for _ in range(120):
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = f"e{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(text)))
    chain = [f"c{i}" for i in range(150)]
    rows += [(len(rows) + k, " ".join(chain[5 * k : 5 * k + 70])) for k in range(16)]
    rows += [(rows[-1][0] + 1 + k, " ".join([*base[:18], *(f"o{k}_{i}" for i in range(40))])) for k in range(30)]
    rows += [(1000 + i, t) for i, (_, t) in enumerate(rows[::7])]
    table, want = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), brute_kept(rows)
    for block, rounds in ((2048, 3), (2048, 0), (7, 1)):
        found = nearcopies.near_copies(table, block=block, rounds=rounds).collect()
        assert len(found) == len(rows) and sorted({r.component_id for r in found}) == want


def test_bounds_of_pairs():
    """Parity bits never differ in more places than the sets differ in shingles, on any common number of places."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([rng.choice(a, rng.integers(0, len(a) + 1), replace=False), rng.integers(0, 1 << 63, rng.integers(1, 200), dtype=np.uint64)]))
        pa, pb = nearcopies.parity_bits(a), nearcopies.parity_bits(b)
        w = min(len(pa), len(pb))
        differ = int(np.bitwise_count(nearcopies.folded(pa[None], w) ^ nearcopies.folded(pb[None], w)).sum())
        assert differ <= len(np.setxor1d(a, b)) and len(pa) * 64 >= len(a)


def test_hubs_with_many_partners_and_copies(spark, monkeypatch):
    """A hub whose partners fill several parts, and texts that stand in many rows."""
    monkeypatch.setattr(nearcopies, "FAN", 3)
    base = [f"h{i}" for i in range(80)]
    rows = [(i, " ".join(base[: 80 - i % 4])) for i in range(40)] + [(100 + i, " ".join([*base, f"t{i}"])) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.component_id for r in nearcopies.near_copies(table).collect()} == {0}

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from linkquarry.llm import ann, sharding, simhash
from linkquarry.llm.queries import OP7_SQL, QUERIES


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, prints, radius=2):
    values = np.array(prints, dtype=np.uint64)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    low = {}
    for i, d in enumerate(ids):
        r = find(i)
        low[r] = d if r not in low else min(low[r], d)
    return [low[find(i)] for i in range(len(ids))]


def test_fingerprints_and_groups(spark, sf):
    got = QUERIES["op8_simhash_vptree"](spark, sf).toPandas()
    text = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id").text
    got = got.set_index("doc_id").loc[text.index]
    want = [brute_fingerprint(t) for t in text]
    assert got.fingerprint.tolist() == [f"{w:016x}" for w in want]
    assert got.component_id.tolist() == brute_components(text.index.tolist(), want)


def test_tree_loses_no_pair(spark, monkeypatch):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(1500)]
    near = []
    for b in base[:500]:
        for _ in range(rng.randint(1, 6)):
            b ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                b ^= 1 << rng.randrange(64)
            near.append(b)
    ball = base[0]
    near += [ball ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i + 1, 20)]  # one dense group
    prints = sorted({*base, *near})
    want = brute_components(prints, prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long").repartition(4)
    levels, dealt_on = [], simhash._dealt_on
    monkeypatch.setattr(simhash, "PART", 500)
    for shard, sample in ((64, 100_000), (100_000, 100_000), (64, 100), (8, 30)):  # small samples: shards are dealt on, once or several times
        monkeypatch.setattr(simhash, "_dealt_on", lambda dealt, level, *how: levels.append((shard, level)) or dealt_on(dealt, level, *how))
        roots = simhash.components(simhash.links(df, shard=shard, sample=sample)).toPandas()
        group = {int(np.int64(n).astype(np.uint64)): r for n, r in zip(roots.node, roots.root, strict=True)}
        got = [group.get(p, ("alone", p)) for p in prints]
        first_got, first_want = {}, {}
        assert [first_got.setdefault(g, i) for i, g in enumerate(got)] == [first_want.setdefault(g, i) for i, g in enumerate(want)]
    assert max(k for s, k in levels if s == 64) >= 2 and (8, 2) in levels and (100_000, 1) not in levels


def test_long_chain_of_links(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (7, 7)]
    random.Random(1).shuffle(edges)
    got = simhash.components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    assert dict(zip(got.node, got.root, strict=True)) == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000}


def test_group_odd_rows(odd, none):
    got = simhash.near_duplicates(odd).toPandas()
    assert len(got) == odd.count()
    zero = got[got.fingerprint == "0" * 16]
    assert len(zero) == 5 and (zero.component_id == 1).all() and zero.doc_id.isna().sum() == 1
    assert simhash.near_duplicates(none).count() == 0


def test_one_row_of_each_group_stays(spark):
    texts = ["alpha beta gamma delta", "one two three four five", "quite another set of words"]
    rows = [(5, texts[0], 1), (3, texts[0], 2), (3, texts[0], 2), (5, texts[1], 3), (None, texts[1], 4), (None, texts[2], 5), (None, texts[2], 5), (3, None, 6), (7, "", 7), (3, texts[1] + "!", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Root long").repartition(3)
    got = simhash.one_of_each_group(docs)
    assert got.columns == docs.columns
    # An id that repeats stands for each of its groups, and a null id only for a group that has no other.
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(3, texts[0]), (5, texts[1]), (0, texts[2]), (3, ""), (3, texts[1] + "!")])
    assert simhash.one_of_each_group(docs.filter("doc_id > 9")).count() == 0


def test_jump_moves_rows_only_into_the_new_shard():
    keys = np.random.default_rng(2).integers(0, 1 << 60, 20_000).astype(np.uint64)
    for n in (1, 2, 7, 16, 100):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert (a < n).all() and ((a == b) | (b == n)).all() and abs((a != b).mean() - 1 / (n + 1)) < 0.02
    assert np.bincount(sharding.jump(keys, 16)).std() < 80


def test_shards_against_sql(spark, sf, monkeypatch):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(OP7_SQL).df().sort_values("doc_id", ignore_index=True)
    for rows in (50_000, 5):
        monkeypatch.setattr(sharding, "RUN_ROWS", rows)
        got = QUERIES["op7_jump_shards"](spark, sf).toPandas().sort_values("doc_id", ignore_index=True)
        pd.testing.assert_frame_equal(got[list(want.columns)], want, check_dtype=False)
    text = pd.read_parquet(f"{sf}/documents.parquet").sort_values("doc_id", ignore_index=True).text
    assert got.text_crc32.tolist() == [zlib.crc32(t.encode()) for t in text]


def test_shard_odd_rows(odd, none):
    got = sharding.assign_shards(odd, 3).toPandas()
    assert len(got) == odd.count()
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert got[got.doc_id.isna()]["size"].tolist() == [1]
    assert sharding.assign_shards(none).count() == 0


def test_recall(spark, sf):
    for d in (sf, "/root/testdata/sf0.1"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
        want = con.execute(ann.exact_sql()).df()
        got = QUERIES["op9_adaptive_ann"](spark, d).toPandas()
        both = got.merge(want, on=["query_id", "vec_id"], suffixes=("", "_exact"))
        assert len(got) == len(want) and len(both) >= 0.9 * len(want)
        assert np.allclose(both.score, both.score_exact, rtol=1e-12)
        for _, part in got.sort_values(["query_id", "rank"]).groupby("query_id"):
            assert part["rank"].tolist() == list(range(1, 11))
            assert list(zip(part.score, part.vec_id, strict=True)) == sorted(zip(part.score, part.vec_id, strict=True))


@pytest.mark.parametrize("n", [0, 1, 4])
def test_vector_odd_rows(spark, n):
    rows = [(i, [float(i), 1.0, 0.5]) for i in range(n)] + [(50, None), (51, [0.0, 0.0, 0.0]), (52, [1.0, float("nan"), 0.0]), (53, [float("inf"), 1.0, 1.0]), (54, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    if n == 4:
        rows += [(3, [3.0, 1.0, 0.5]), (60, [1.0]), (61, [2.0, 1.0, 0.5])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    got = ann.search(base, base.filter("vec_id = 0 or vec_id between 50 and 54")).orderBy("rank").toPandas()
    assert got.vec_id.tolist() == {0: [], 1: [], 4: [1, 2, 61, 3]}[n]


def test_rows_of_a_hot_key_are_dealt_over_parts(spark):
    """A third of the rows with one id, another third without any, in runs of 50 rows."""
    rows = [(None if i % 3 == 1 else 7 if i % 3 else i, f"text {i % 40}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.assign_shards(table, 4, run_rows=50).toPandas()
    assert len(got) == 3000
    for shard, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert got[got.doc_id == 7].shard.nunique() == 1 and got[got.doc_id.isna()].shard.nunique() == 1
    plain = sharding.assign_shards(table, 4).toPandas()
    keys = ["doc_id", "text_crc32", "shard", "grown_shard"]
    assert got[keys].sort_values(keys).values.tolist().__repr__() == plain[keys].sort_values(keys).values.tolist().__repr__()

import gzip
import json

import pytest
from pyspark.sql import functions as F

from linkquarry.functions import hashing, strings
from linkquarry.operators import evaluate, models, prepare, rulelists, sampling, splits, staging, verify
from linkquarry.operators.sampling import InsufficientCandidates
from linkquarry.sources import candidates, corpus, index_table


def test_end_to_end(spark, tmp_path):
    hosts = "abcdefg"
    raw = [f"https://{h}.example/{i}" for h in hosts for i in range(2 if h in "ab" else 1)]
    raw = [raw[0] + "?fbclid=1", *raw, "mailto:x@example.com"]
    (tmp_path / "raw.jsonl").write_text("".join(json.dumps({"url": u}) + "\n" if k % 2 else json.dumps(u) + "\n" for k, u in enumerate(raw)))
    rows = staging.canonicalized(candidates.read_candidates(spark, [str(tmp_path / "raw.jsonl")])).cache()
    assert rows.count() == 11 and staging.accepted(rows).count() == 10
    assert [tuple(r) for r in staging.rejection_counts(staging.rejected(rows)).collect()] == [("unsupported-protocol", 1)]
    unique = sampling.distinct_candidates(staging.accepted(rows))
    assert unique.count() == 9
    final = splits.five_way_splits(sampling.balanced_sample(unique, 7, "sample-seed", 0.8, 2), "sample-seed")
    manifest = corpus.corpus_manifest(final, "sample-seed")
    assert manifest.rows == 7
    with pytest.raises(InsufficientCandidates):
        sampling.balanced_sample(unique, 10, "s")
    corpus.write_corpus(final, str(tmp_path / "corpus"))
    back = corpus.read_corpus(spark, str(tmp_path / "corpus"))
    assert verify.schema_matches(back) and [r.url for r in back.collect()] == sorted(r.url for r in final.collect())
    packed = corpus.pack_shards(back, 32)
    assert packed.count() >= 2 and corpus.unpack(packed).count() == 7 and corpus.pack_violations(packed).count() == 0
    assert max(r.url_bytes for r in packed.collect()) <= 32
    broken = packed.withColumn("splits", F.unhex(F.lit("09"))).withColumn("offsets", F.substring("offsets", 1, 4))
    assert {r.problem for r in corpus.pack_violations(broken).collect()} >= {"offset-count", "splits"}
    assert manifest.write(str(tmp_path / "m.json")) and corpus.CorpusManifest.read(str(tmp_path / "m.json")) == manifest
    done = staging.write_shards(staging.accepted(rows), str(tmp_path / "shards"), 4)
    assert done.agg(F.sum("records")).first()[0] == 10


def test_sample_is_exact_and_reproducible(spark):
    rows = spark.range(21_000).select(F.concat(F.lit("https://h"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit(".example/u")).alias("url")).withColumn("hostname", strings.hostname(F.col("url")))
    a = sampling.balanced_sample(rows, 5000, "s", 1.0, 1)
    b = sampling.balanced_sample(rows.repartition(7), 5000, "s", 1.0, 1)
    assert a.count() == 5000 == a.distinct().count() and a.exceptAll(b).count() == 0
    assert sampling.balanced_sample(rows.limit(50), 50, "s", 0.5, 1).count() == 50
    assert sampling.top_up(rows, 300, "s", lambda r: r.select("url", "hostname"), 0.5, 1000, cap=1).count() == 300
    assert sampling.hash_sample(rows, 100, "s").count() == 100
    kept = sampling.reservoir(iter(range(1000)), 50, 7)
    assert kept == sampling.reservoir(iter(range(1000)), 50, 7) and len(set(kept)) == 50
    with pytest.raises(InsufficientCandidates):
        sampling.reservoir(iter(range(3)), 5, 7)


def test_splits_do_not_leak(spark):
    rows = spark.createDataFrame([(f"https://host-{i}.example/{j}", f"host-{i}.example") for i in range(200) for j in range(i % 11 + 1)], "url string, hostname string")
    got = splits.five_way_splits(rows, "partition-test").cache()
    again = splits.five_way_splits(rows.repartition(5), "partition-test")
    assert got.exceptAll(again).count() == 0 and splits.leakage_violations(got).count() == 0
    assert verify.verify_corpus(got)["rows"] == got.count()
    bad = got.withColumn("split", F.when(F.col("url").endswith("/0"), 4).otherwise(F.col("split")).cast("tinyint"))
    with pytest.raises(verify.VerificationError, match="leak"):
        verify.verify_corpus(bad)
    with pytest.raises(verify.VerificationError, match="manifest"):
        verify.verify_corpus(got, {"rows": 3})
    with pytest.raises(ValueError):
        splits.five_way_splits(rows, "s", 0.5, 0.5)


def test_stage0(spark, tmp_path):
    lines = [json.dumps({"url": f"https://one.example/{i}", "timestamp": f"2026-01-{i + 1:02d}T00:00:00Z", "tags": ["t"]}) for i in range(10)] + [json.dumps({"url": "https://lone.example/"}), "", "{broken", json.dumps({"url": 3}), json.dumps({"url": "https://one.example/0?fbclid=1", "tags": ["u"]})]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    raw, unparsed = candidates.read_stage0(spark, f"src={tmp_path / 'in.jsonl'}")
    raw = raw.withColumn("ordinal", F.col("source_index")).cache()
    records, rejected = prepare.prepare(raw, "seed", 0.2)
    rows = {r.url: r for r in records.collect()}
    assert len(rows) == 11 and sum(r.seen_host == "test" for r in rows.values()) == 2 and rejected.count() == 0 and unparsed.count() == 2
    first = rows["https://one.example/0"]
    assert first.tags == ["t", "u"] and first.source_index == 1 and "popular-host" in first.classes and first.raw_url is None
    assert sorted(r.url for r in rows.values() if r.temporal_seen_host == "test") == ["https://one.example/8", "https://one.example/9"]
    assert rows["https://lone.example/"].temporal_seen_host == "excluded" and "unknown-host" in rows["https://lone.example/"].classes
    one = prepare.summary(prepare.normalized(raw), records, unparsed).first()
    assert (one["input"], one["unique"], one.duplicates, one.rejected, one.hosts) == (12, 11, 1, 2, 2)
    limited, _ = candidates.read_stage0(spark, f"{tmp_path / 'in.jsonl'}", limit=3)
    assert limited.count() == 3 and limited.first().source == "in"


def test_normalisations(spark):
    urls = ["https://e.example/index.html?fbclid=1", "https://e.example/index.html", "https://e.example/"]
    raw = spark.createDataFrame([(k, "s", k, u, None, None) for k, u in enumerate(urls)], "ordinal long, source string, source_index long, url string, timestamp double, tags array<string>")
    assert [prepare.merge_duplicates(prepare.normalized(raw, n)).count() for n in ("clean", "exact", "aggressive", "raw")] == [2, 3, 1, 3]
    with pytest.raises(ValueError):
        prepare.normalized(raw, "other")


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(" https://a.example/ \n\n\t \n﻿https://b.example/\n")
    with gzip.open(tmp_path / "b.txt.gz", "wt") as f:
        f.write("https://c.example/\n")
    spark.createDataFrame([("https://d.example/", 1)], "url string, x int").write.parquet(str(tmp_path / "c.parquet"))
    got = candidates.read_candidates(spark, [str(tmp_path / n) for n in ("a.txt", "b.txt.gz", "c.parquet")]).orderBy("ordinal").collect()
    assert [r.url[8] for r in got] == list("abcd")
    for text in ('{"other": 1}', '{"url": 5}', "3", "nonsense"):
        (tmp_path / "bad.jsonl").write_text(text + "\n")
        with pytest.raises(Exception, match="neither a string"):
            candidates.read_candidates(spark, [str(tmp_path / "bad.jsonl")]).collect()
    spark.createDataFrame([(1,)], "url int").write.parquet(str(tmp_path / "d.parquet"))
    with pytest.raises(ValueError):
        candidates.read_file(spark, str(tmp_path / "d.parquet"))
    assert [candidates.candidate_format(p) for p in ("A.PARQUET", "x.ndjson.GZ", "x.jsonl", "x.txt", "x.txt.gz")] == ["parquet", "jsonl-gzip", "jsonl", "text", "text-gzip"]
    with pytest.raises(ValueError):
        candidates.candidate_format("x.csv")
    big = tmp_path / "lines.txt"
    big.write_text("".join(f"line{i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    numbered = candidates.numbered_lines(spark, str(big))
    assert spark.read.text(str(big)).rdd.getNumPartitions() > 1 and numbered.count() == 20_000 and numbered.filter("value <> concat('line', line_number - 1)").count() == 0
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_index_table(spark, tmp_path):
    source = index_table.IndexSource("now", str(tmp_path / "t"), table="url_index_test")
    try:
        index_table.create_table(spark, source)
        part = tmp_path / "p"
        spark.sql("SELECT 'https://a.example/' url, 'a.example' url_host_name, 'https' url_protocol, cast(200 as smallint) fetch_status, 'text/html' content_mime_type").write.parquet(str(part))
        index_table.add_partition(spark, source, str(part))
        found = index_table.eligible_rows(spark.table("url_index_test"), source)
        assert found.count() == 1
        plan = found._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(crawl" in plan and "In(url_protocol" in plan
        assert index_table.acquire(spark.table("url_index_test"), source, 1, str(tmp_path / "c")) == (0, 1_000_000)
        assert spark.read.parquet(str(tmp_path / "c")).count() == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS url_index_test")


def test_statistics(spark):
    one = evaluate.describe_frame(spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double"), "v").first()
    assert (one["count"], one["min"], one["max"], one["mean"], one["median"], one["p95"], one["p99"]) == (4, 1, 4, 2.5, 2.5, 3.8499999999999996, 3.9699999999999998)
    assert spark.createDataFrame([], "v double").agg(evaluate.describe("v").alias("s")).first().s is None


def test_rule_lists(spark):
    rows = spark.createDataFrame([("two", 200, ["gclid", "SHARED"], ["example.com"], False), ("one", 100, ["shared", "fbclid"], ["EXAMPLE.com"], None), ("gone", 300, ["x"], [], True)], "id string, last_modified long, stripList array<string>, allowList array<string>, deleted boolean")
    assert rulelists.compile_rules(rows) == {"strip_parameters": ["gclid", "shared", "fbclid"], "allow_base_domains": ["example.com"]}
    for bad in ("exa mple.com", "a@b.example", "a.example:80", "a.example/x"):
        with pytest.raises(ValueError):
            rulelists.check_domain(bad)
    with pytest.raises(ValueError):
        rulelists.compile_rules(rows.limit(0))


def test_models(spark):
    train = spark.createDataFrame([("ab",), ("ab",), ("ac",)], "url string")
    uni, gram = models.unigram_bits(train, train.distinct()).collect(), models.ngram_bits(train, train.distinct()).collect()
    assert {r.id for r in uni} == {"ab", "ac"} and sum(r.bits for r in gram) < sum(r.bits for r in uni)
    with pytest.raises(Exception, match="outside the codec alphabet"):
        models.unigram_counts(models.token_rows(spark.createDataFrame([("é",)], "url string"))).collect()
    assert models.excluded_count(train, most=1).first().excluded == 3 and models.balanced_score(2, 4) == 3


def test_sizes_and_hashes(spark):
    assert [strings.format_bytes(n) for n in (5, 2048, 20 << 20)] == ["5 B", "2.00 KiB", "20.0 MiB"]
    assert hashing.bucket_width(10_000, 1_000_000) == 20_000
    for bad in ((0, 5), (6, 5)):
        with pytest.raises(ValueError):
            hashing.bucket_width(*bad)
    for bad in ((5, 5), (-1, 2), (0, 11)):
        with pytest.raises(ValueError):
            hashing.check_bucket_range(*bad, 10)
    import xxhash

    got = spark.createDataFrame([("abc",), (None,)], "u string").select(hashing.xxhash64_seed0(F.col("u"))).collect()
    assert got[0][0] & (2**64 - 1) == xxhash.xxh64_intdigest(b"abc", 0) and got[1][0] is None


def test_batches(spark):
    rows = spark.createDataFrame([("x" * n,) for n in (1, 2, 3, 5, 5, 5, 9, 400)], "url string")
    got = corpus.batches(rows, 2, 7).collect()
    assert sum(r["size"] for r in got) == 8 and all(len({len(t) for t in r.tokens}) == 1 for r in got)


def test_benchmark(spark):
    from linkquarry.functions.codec import FragmentCodec, IdentityCodec

    rows = spark.createDataFrame([(1, "https://example.com/", ["a", "b"], {"seenHost": "test"}), (2, "HTTPS://example.com/", ["a"], {"seenHost": "excluded"})], "ordinal int, url string, classes array<string>, splits map<string,string>")
    got = evaluate.benchmark(rows, FragmentCodec({1: IdentityCodec()}, 1)).cache()
    assert [r.status for r in got.orderBy("ordinal").collect()] == ["exact", "decode-error"]
    assert {(r["class"], r.total, r.exact) for r in evaluate.by_class(got).collect()} == {("a", 2, 1), ("b", 1, 1)}
    assert [(r.split, r.exact_rate) for r in evaluate.by_split(got).collect()] == [("seenHost:test", 1.0)]
    assert evaluate.failures(got).count() == 1 and evaluate.select_records(got, "seen-host:test").count() == 1
    for bad in ("seen-host", "x:test", "seen-host:other"):
        with pytest.raises(ValueError):
            evaluate.select_records(got, bad)


def test_ingestion(spark, tmp_path):
    from linkquarry.streaming.ingest import ingest

    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "1.txt").write_text("https://a.example/?fbclid=1\nhttps://a.example/\nbad\n")
    args = (str(landing), str(tmp_path / "table"), str(tmp_path / "state"))
    ingest(spark, *args)
    (landing / "2.txt").write_text("https://a.example/\nhttps://b.example/\n")
    ingest(spark, *args)
    assert sorted(r.url for r in spark.read.parquet(args[1]).collect()) == ["https://a.example/", "https://b.example/"]

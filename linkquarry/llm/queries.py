"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkquarry.llm import ann, bpe, decontaminate, language, licenses, quality, secrets, sharding, simhash, tokens
from linkquarry.llm.common import held_out, spread, table


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(*columns))


def op1_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "lang_reliable")


def op3_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licences(documents(spark, sf_dir, "doc_id", "text"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir, "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_jump_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir, "doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op9_adaptive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "embeddings")
    return ann.search(base, base.filter(F.col("vec_id") % 100 == 0))


def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality_trees, op2_language_mixture, op3_secret_links, op4_token_counts, op5_license_dice, op6_decontaminate, op7_jump_shards, op8_simhash_vptree, op9_adaptive_ann, op10_bpe_chunks, pipeline)}

_OP6_SQL = """
WITH texts AS (
  SELECT 0 AS side, doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10ffff}]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id, regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10ffff}]+') FROM benchmark
),
shingles AS (
  SELECT side, id, unnest(list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, greatest(1, len(w) - 4) + 1)])) AS s
  FROM texts WHERE len(w) > 0
),
item AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM shingles WHERE side = 1)
SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_shingles, count(*) AS n_shared, count(*) / i.n::DOUBLE AS containment
FROM shingles d JOIN item i USING (s) WHERE d.side = 0
GROUP BY d.id, i.id, i.n HAVING count(*) >= ceil(0.8 * i.n - 1e-9)
"""

_OP7_SQL = """
WITH RECURSIVE keys AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents
),
steps(r, n, k, b, j) AS (
  SELECT r, n, key::UHUGEINT, 0::BIGINT, 0::BIGINT FROM keys, (VALUES (16), (17)) AS v(n)
  UNION ALL
  SELECT r, n, k2, j, floor((j + 1) * (2147483648.0::DOUBLE / ((k2 >> 33)::DOUBLE + 1)))::BIGINT
  FROM (SELECT r, n, j, (k * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS k2 FROM steps WHERE j < n)
),
shards AS (
  SELECT r, max(b) FILTER (n = 16)::INTEGER AS shard, max(b) FILTER (n = 17)::INTEGER AS grown_shard FROM steps GROUP BY r
)
SELECT doc_id, size, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, doc_id, size) - 1 AS slot, grown_shard
FROM keys JOIN shards USING (r)
"""

#: op7's SQL leaves out the checksum, which DuckDB has no function for, so it is a test of the fixture, not an oracle.
OP7_SQL = _OP7_SQL

ORACLE_SQL = {"op5_license_dice": licenses.licences_sql(), "op6_decontaminate": _OP6_SQL}

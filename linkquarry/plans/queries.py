"""Registered queries over the derived views and the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkquarry import rules
from linkquarry.functions import codec, hashing, strings
from linkquarry.functions.canonical import canonicalize_batch
from linkquarry.operators import evaluate, models, prepare, rulelists, sampling, splits, staging, verify
from linkquarry.plans.views import VIEWS, table, view
from linkquarry.session import spread
from linkquarry.sources import adversarial, corpus, index_table

SEED = "sample-seed"
PACK_BYTES = 16 << 20
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *used: str):
    """Register a query; ``sql`` may use the derived views named in ``used``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            views = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
            body = sql.strip()
            if views:
                body = f"WITH {views}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
            ORACLE_SQL[f.__name__] = body
        return f

    return add


def _score(*parts: str) -> str:
    text = " || chr(0) || ".join(parts)
    return f"(('0x' || substr(sha256({text}), 1, 13))::BIGINT::DOUBLE / 4503599627370495::DOUBLE)"


def _order(kind: str, value: str) -> str:
    return f"sha256('{len(SEED)}:{SEED}{len(kind)}:{kind}' || {value})"


def _class(score: str) -> str:
    train = 1 - 0.1 - 0.1
    return f"CASE WHEN {score} < {train!r}::DOUBLE THEN 0 WHEN {score} < {train + 0.1!r}::DOUBLE THEN 1 ELSE 2 END"


def _five_way(source: str) -> str:
    return f"""
classes AS (
  SELECT *, {_class(_score(f"'{SEED}'", "'host'", 'hostname'))} AS host_class, {_class(_score(f"'{SEED}'", "'url'", 'url'))} AS url_class FROM {source}
),
ranked AS (
  SELECT *, min(url_class) OVER (PARTITION BY hostname) AS least, row_number() OVER (PARTITION BY hostname ORDER BY {_score(f"'{SEED}'", "'repair'", 'url')}, url) AS k FROM classes
),
five AS (
  SELECT url, hostname, CASE WHEN host_class > 0 THEN host_class + 2 WHEN least > 0 AND k = 1 THEN 0 ELSE url_class END AS split,
    host_class = 0 AND least > 0 AND k = 1 AS repaired FROM ranked
)"""


_CANDIDATES = "candidates AS (SELECT DISTINCT url, hostname FROM web_urls)"
_SAMPLE = f"""
size AS (SELECT CAST(floor(count(*) * 0.4) AS BIGINT) AS n FROM candidates),
covered AS (
  SELECT url, hostname FROM (SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY {_order('sample-url', 'url')}, url) AS k FROM candidates) t
  WHERE k <= 3 ORDER BY k, {_order('sample-host', 'hostname')}, {_order('sample-url', 'url')}, url LIMIT (SELECT CAST(floor(n * 0.8) AS BIGINT) FROM size)
),
fill AS (
  SELECT c.url, c.hostname FROM candidates c ANTI JOIN covered USING (url)
  ORDER BY {_order('sample-prevalence', 'c.url')}, c.url LIMIT (SELECT n - (SELECT count(*) FROM covered) FROM size)
),
selected AS (SELECT * FROM covered UNION ALL SELECT * FROM fill)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.distinct_candidates(view(spark, sf_dir, "web_urls"))


def _n(candidates: DataFrame) -> int:
    return int(candidates.count() * 0.4)


@query(f"WITH {_CANDIDATES}, {_SAMPLE}, {_five_way('selected')} SELECT url, CAST(split AS INTEGER) AS split FROM five", "web_urls")
def corpus_sample_split(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    sample = sampling.balanced_sample(candidates, _n(candidates), SEED, 0.8, 3, check=False)
    return splits.five_way_splits(sample, SEED).select("url", F.col("split").cast("int").alias("split"))


@query(f"WITH {_CANDIDATES} SELECT count(*) AS urls, count(DISTINCT hostname) AS hosts FROM candidates", "web_urls")
def candidate_distinct_counts(spark, sf_dir):
    return sampling.candidate_counts(_candidates(spark, sf_dir))


@query("SELECT hostname, count(*) AS urls FROM event_urls GROUP BY hostname", "event_urls")
def host_counts(spark, sf_dir):
    return prepare.host_counts(view(spark, sf_dir, "event_urls"))


@query("SELECT hostname, count(*) AS urls FROM event_urls GROUP BY hostname HAVING count(*) >= 10 ORDER BY urls DESC, hostname LIMIT 20", "event_urls")
def popular_hosts(spark, sf_dir):
    return prepare.popular_hosts(prepare.host_counts(view(spark, sf_dir, "event_urls")), 10, 20)


@query(f"WITH {_CANDIDATES}, {_SAMPLE} SELECT url, hostname FROM covered", "web_urls")
def host_coverage_rank(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    return sampling.host_coverage(candidates, int(_n(candidates) * 0.8), SEED, 3).select("url", "hostname")


@query(f"WITH {_CANDIDATES}, {_SAMPLE} SELECT url, hostname FROM fill", "web_urls")
def prevalence_fill(spark, sf_dir):
    candidates = _candidates(spark, sf_dir)
    n = _n(candidates)
    covered = sampling.host_coverage(candidates, int(n * 0.8), SEED, 3)
    return sampling.prevalence_fill(candidates, covered, n - covered.count(), SEED).select("url", "hostname")


@query(f"WITH {_five_way('event_urls')} SELECT url, hostname, CAST(split AS INTEGER) AS split FROM five", "event_urls")
def five_way_splits(spark, sf_dir):
    return splits.five_way_splits(view(spark, sf_dir, "event_urls"), SEED).select("url", "hostname", F.col("split").cast("int").alias("split"))


@query(f"WITH {_CANDIDATES}, {_five_way('candidates')} SELECT url, hostname FROM five WHERE repaired", "web_urls")
def split_repair_rows(spark, sf_dir):
    return splits.five_way_splits(_candidates(spark, sf_dir), SEED).filter("repaired").select("url", "hostname")


_NAMES = ", ".join(f"({k}, '{n}')" for k, n in enumerate(rules.SPLITS))


@query(f"WITH {_five_way('event_urls')} SELECT v.split, v.name, count(five.split) AS rows FROM (VALUES {_NAMES}) AS v(split, name) LEFT JOIN five USING (split) GROUP BY v.split, v.name", "event_urls")
def split_counts(spark, sf_dir):
    return splits.split_counts(splits.five_way_splits(view(spark, sf_dir, "event_urls"), SEED))


@query(f"WITH {_five_way('event_urls')}, masks AS (SELECT hostname, bit_or(1 << CAST(split AS INTEGER)) AS mask FROM five GROUP BY hostname) SELECT hostname FROM masks WHERE (mask & 24 <> 0 AND mask NOT IN (8, 16)) OR (mask & 24 = 0 AND mask & 1 = 0)", "event_urls")
def split_leakage_violations(spark, sf_dir):
    return splits.leakage_violations(splits.five_way_splits(view(spark, sf_dir, "event_urls"), SEED)).select("hostname")


@query("WITH rows AS (SELECT hostname, CAST(ordinal % 5 AS INTEGER) AS split FROM event_urls), masks AS (SELECT hostname, bit_or(1 << split) AS mask FROM rows GROUP BY hostname) SELECT hostname, CAST(mask AS INTEGER) AS mask FROM masks WHERE (mask & 24 <> 0 AND mask NOT IN (8, 16)) OR (mask & 24 = 0 AND mask & 1 = 0)", "event_urls")
def split_leakage_control(spark, sf_dir):
    rows = view(spark, sf_dir, "event_urls").withColumn("split", (F.col("ordinal") % 5).cast("int"))
    return splits.leakage_violations(rows).select("hostname", "mask")


def _stage0(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "url_times").select("url", F.col("page_id").alias("ordinal"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"))
    return rows.withColumn("id", hashing.sha256_hex(F.col("url"))).withColumn("hostname", strings.hostname(F.col("url")))


_STAGE0 = "base AS (SELECT url, page_id AS ordinal, epoch_ms(ts)::DOUBLE AS timestamp, sha256(url) AS id, lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS hostname FROM url_times)"
_SEEN = f"""
seen AS (
  SELECT *, CASE WHEN n >= 2 AND k <= least(n - 1, greatest(1, floor(n * 0.1::DOUBLE))) THEN 'test' ELSE 'train' END AS seen_host FROM (
    SELECT *, count(*) OVER (PARTITION BY hostname) AS n, row_number() OVER (PARTITION BY hostname ORDER BY {_score(f"'{SEED}:seen-host'", 'id')}, ordinal) AS k FROM base) t
)"""
_UNSEEN = f"CASE WHEN {_score(f"'{SEED}:unseen-host'", 'hostname')} < 0.1::DOUBLE THEN 'test' ELSE 'train' END"
_TEMPORAL = """
temporal AS (
  SELECT *, CASE WHEN timestamp IS NULL OR m < 2 THEN 'excluded' WHEN r > m - least(m - 1, greatest(1, floor(m * 0.1::DOUBLE))) THEN 'test' ELSE 'train' END AS temporal_seen_host FROM (
    SELECT *, count(*) OVER (PARTITION BY hostname, timestamp IS NULL) AS m, row_number() OVER (PARTITION BY hostname, timestamp IS NULL ORDER BY timestamp, id) AS r FROM seen) t
)"""


@query(f"WITH {_STAGE0}, {_SEEN} SELECT url, seen_host FROM seen", "url_times")
def seen_host_holdout(spark, sf_dir):
    return splits.seen_host_holdout(_stage0(spark, sf_dir), SEED, 0.1).select("url", "seen_host")


@query(f"WITH {_STAGE0} SELECT url, {_UNSEEN} AS unseen_host FROM base", "url_times")
def unseen_host_holdout(spark, sf_dir):
    return splits.unseen_host_holdout(_stage0(spark, sf_dir), SEED, 0.1).select("url", "unseen_host")


@query(f"WITH {_STAGE0}, {_SEEN}, {_TEMPORAL} SELECT url, temporal_seen_host FROM temporal", "url_times")
def temporal_holdout(spark, sf_dir):
    return splits.temporal_holdout(_stage0(spark, sf_dir), 0.1).select("url", "temporal_seen_host")


_LONG = f"""WITH {_STAGE0}, {_SEEN}, {_TEMPORAL}, long AS (
  SELECT hostname, 'seenHost' AS split_name, seen_host AS assignment FROM temporal UNION ALL
  SELECT hostname, 'unseenHost', {_UNSEEN} FROM temporal UNION ALL SELECT hostname, 'temporalSeenHost', temporal_seen_host FROM temporal)"""


def _assigned(spark, sf_dir):
    rows = splits.unseen_host_holdout(splits.seen_host_holdout(_stage0(spark, sf_dir), SEED, 0.1), SEED, 0.1)
    return splits.assignment_counts(splits.temporal_holdout(rows, 0.1))


@query(f"{_LONG} SELECT split_name, assignment, count(*) AS records FROM long GROUP BY ALL", "url_times")
def split_assignment_counts(spark, sf_dir):
    return _assigned(spark, sf_dir).select("split_name", "assignment", "records")


@query(f"{_LONG} SELECT split_name, assignment, count(DISTINCT hostname) AS hosts FROM long GROUP BY ALL", "url_times")
def split_host_counts(spark, sf_dir):
    return _assigned(spark, sf_dir).select("split_name", "assignment", "hosts")


@query("SELECT url, CAST(('0x' || substr(sha256(hostname), 1, 8))::BIGINT % 64 AS INTEGER) AS shard FROM event_urls", "event_urls")
def staging_shards(spark, sf_dir):
    return staging.shards(view(spark, sf_dir, "event_urls"), 64).select("url", "shard")


_SOURCE = index_table.IndexSource("current")
_ELIGIBLE = "crawl = 'current' AND subset = 'warc' AND url_protocol IN ('http', 'https') AND fetch_status IN (200) AND coalesce(content_mime_detected, content_mime_type) IN ('text/html', 'application/pdf') AND url IS NOT NULL AND url_host_name IS NOT NULL"


@query(f"SELECT url, url_host_name AS hostname FROM index_rows WHERE {_ELIGIBLE}", "index_rows")
def eligible_filter(spark, sf_dir):
    return index_table.eligible_rows(view(spark, sf_dir, "index_rows"), _SOURCE)


@query(f"SELECT count(*) AS eligible, greatest(1, CAST(ceil(10 * 2::DOUBLE / count(*) * 1000000) AS BIGINT)) AS width FROM index_rows WHERE {_ELIGIBLE}", "index_rows")
def bucket_width(spark, sf_dir):
    n = index_table.eligible_rows(view(spark, sf_dir, "index_rows"), _SOURCE).agg(F.count("*").alias("eligible"))
    return n.withColumn("width", F.greatest(F.lit(1).cast("bigint"), F.ceil(F.lit(20.0) / F.col("eligible") * 1_000_000)))


@query()
def hash_bucket_range(spark, sf_dir):
    return sampling.hash_bucket_range(view(spark, sf_dir, "event_urls"), SEED, 0, 250_000).select("url", "bucket")


def _names_sql(pattern: bool) -> str:
    kept = ", ".join(f"'{p}'" for p in rules.CONSERVATIVE_PARAMETERS)
    name = "lower(regexp_extract(s, '^[?]?([^=]*)', 1))"
    gone = f"{name} IN ({kept})"
    if pattern:
        gone += " OR regexp_matches(" + name + ", '^(?:" + "|".join(p for _, p in rules.AGGRESSIVE_PARAMETERS) + r")\z')"
    spared = "" if pattern else " OR hostname = 'googleadservices.com' OR ends_with(hostname, '.googleadservices.com')"
    return f"""
SELECT ordinal, CASE WHEN NOT contains(regexp_extract(url, '^[^#]*'), '?'){spared} THEN url ELSE
  regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || regexp_extract(url, '(#.*)\\z', 1) END AS url
FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda s: NOT ({gone})) AS kept FROM web_urls) t"""


@query(_names_sql(False), "web_urls")
def clean_strip_params(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.strip_parameters(F.col("url")).alias("url"))


@query(_names_sql(True), "web_urls")
def aggressive_strip_params(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.strip_parameters(F.col("url"), "aggressive").alias("url"))


_INDEX = "|".join(n.replace(".", "[.]") for n in rules.INDEX_FILES)


@query(rf"SELECT ordinal, regexp_replace(url, '(?i)^([a-z]+://[^/?#]*(?:/[^/?#]*)*/)(?:{_INDEX})(\z|[?#])', '\1\2') AS url FROM web_urls", "web_urls")
def drop_index_file(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.drop_index_file(F.col("url")).alias("url"))


_SHOPS = " OR ".join(f"hostname = '{d}' OR ends_with(hostname, '.{d}')" for d in rules.AMAZON_DOMAINS)


@query(
    rf"""SELECT ordinal, CASE WHEN ({_SHOPS}) AND p <> '' THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/dp/' || upper(p) || regexp_extract(url, '^[^?#]*([?#].*)?\z', 1) ELSE url END AS url
FROM (SELECT *, regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '(?i)^/(?:[^/]+/)?(?:dp|gp/product)/([A-Z0-9]{{10}})(?:/.*)?\z', 1) AS p FROM web_urls) t""",
    "web_urls",
)
def amazon_product_path(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.product_path(F.col("url")).alias("url"))


@query()
def percent_normalize(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.percent_normalize(F.col("url")).alias("url"))


def _canonical(spark, sf_dir, preset):
    return canonicalize_batch(spread(view(spark, sf_dir, "url_candidates").select("ordinal", "url")), "url", preset)


@query()
def exact_serialize(spark, sf_dir):
    return _canonical(spark, sf_dir, "exact").select("ordinal", "canonical.url", "canonical.hostname", F.col("canonical.error_code").alias("code"))


@query()
def canonicalize_clean(spark, sf_dir):
    return _canonical(spark, sf_dir, "clean").select("ordinal", "canonical.url", "canonical.effective_preset", F.col("canonical.error_code").alias("code"))


@query()
def canonicalize_ledger(spark, sf_dir):
    rows = _canonical(spark, sf_dir, "aggressive").select("ordinal", F.posexplode("canonical.changes").alias("step", "change"))
    return rows.select("ordinal", "step", "change.*", strings.change_description(F.col("change")).alias("text"))


@query()
def unwrap_redirects(spark, sf_dir):
    rows = view(spark, sf_dir, "web_urls").select("ordinal", F.concat(F.lit("https://www.google.com/url?q="), F.url_encode("url")).alias("url"))
    return canonicalize_batch(rows, "url", "aggressive").select("ordinal", "canonical.url", F.transform("canonical.warnings", lambda w: w["code"]).alias("warnings"))


@query()
def ledger_savings(spark, sf_dir):
    saved = F.aggregate("canonical.changes", F.lit(0), lambda a, c: a + c["saved_chars"])
    return _canonical(spark, sf_dir, "aggressive").filter("canonical.error_code is null").select("ordinal", F.size("canonical.changes").alias("changes"), saved.alias("saved_chars"), strings.compression_detail(F.length("canonical.browser_url"), F.length("canonical.url")).alias("detail"))


@query()
def canonical_chain_violations(spark, sf_dir):
    return verify.canonical_violations(_canonical(spark, sf_dir, "aggressive")).select("ordinal")


_LIST = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_NAMES_OF = "list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: lower(regexp_extract(s, '^[?]?([^=]*)', 1)))"
_SIGNED = rf"""CASE WHEN regexp_matches(p, '{rules.CLOUDINARY_PATH}') THEN 'Cloudinary delivery URL signing'
  WHEN hostname = 'maps.googleapis.com' AND regexp_matches(p, '{rules.MAPS_PATH}') AND list_contains(n, 'signature') AND list_has_any(n, ['key', 'client']) THEN 'Google Maps Platform URL signing'
  WHEN regexp_matches(p, '{rules.SUPABASE_PATH}') AND list_contains(n, 'token') THEN 'Supabase Storage signed URL'
  WHEN list_contains(n, 'x-amz-signature') AND list_has_any(n, {_LIST(rules.AWS_V4)}) THEN 'AWS Signature Version 4'
  WHEN list_contains(n, 'x-goog-signature') AND list_has_any(n, {_LIST(rules.GOOGLE_V4)}) THEN 'Google Cloud Storage V4 signing'
  WHEN list_has_all(n, ['signature', 'key-pair-id']) AND list_has_any(n, ['expires', 'policy']) THEN 'Amazon CloudFront signing'
  WHEN list_has_all(n, ['awsaccesskeyid', 'expires', 'signature']) THEN 'Amazon S3 Signature Version 2'
  WHEN list_has_all(n, ['googleaccessid', 'expires', 'signature']) THEN 'Google Cloud Storage V2 signing'
  WHEN list_contains(n, 'sig') AND list_has_any(n, {_LIST(rules.AZURE_SAS)}) AND (list_contains(n, 'sv') OR {' OR '.join(f"ends_with(hostname, '{s}')" for s in rules.AZURE_HOSTS)}) THEN 'Azure Storage shared access signature' END"""
_PARTS = f"parts AS (SELECT *, {_NAMES_OF} AS n, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS p FROM web_urls)"


@query(f"WITH {_PARTS} SELECT ordinal, {_SIGNED} AS scheme FROM parts", "web_urls")
def signed_url_scheme(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", strings.signed_scheme(F.col("url")).alias("scheme"))


@query(rf"WITH {_PARTS} SELECT ordinal, concat_ws(',', CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*[^/?#:@][^/?#]*@') THEN 'credentials-in-url' END, CASE WHEN ({_SIGNED}) IS NOT NULL THEN 'signed-url-detected' END) AS codes FROM parts", "web_urls")
def preflight_warnings(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").select("ordinal", F.array_join(strings.preflight_codes(F.col("url")), ",").alias("codes"))


def _merged(spark, sf_dir):
    rows = view(spark, sf_dir, "web_urls").withColumn("key", F.col("url")).withColumn("canonical", F.struct("hostname"))
    rows = rows.withColumn("source_index", F.col("ordinal")).withColumn("timestamp", F.lit(None).cast("double")).withColumn("tags", F.array("source"))
    return prepare.merge_duplicates(rows)


_MERGE = "merged AS (SELECT url, min(ordinal) AS ordinal, arg_min(hostname, ordinal) AS hostname, list_sort(list_distinct(list(source))) AS sources FROM web_urls GROUP BY url)"


@query(f"WITH {_MERGE} SELECT sha256(url) AS id, url, hostname, ordinal AS source_index, array_to_string(sources, ',') AS sources FROM merged", "web_urls")
def dedupe_merge_sources(spark, sf_dir):
    return _merged(spark, sf_dir).select("id", "url", "hostname", "source_index", F.array_join("sources", ",").alias("sources"))


_CLASSIFY = rf"""{_MERGE},
counts AS (SELECT hostname, count(*) AS host_count FROM merged GROUP BY hostname),
popular AS (SELECT hostname FROM counts WHERE host_count >= 10 ORDER BY host_count DESC, hostname LIMIT 100),
seen AS (
  SELECT m.*, host_count, m.hostname IN (SELECT hostname FROM popular) AS popular, regexp_extract(url, '^[a-z]+://[^/?#]*(.*)\z', 1) AS rest,
    list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda s: s <> ''), lambda s: regexp_extract(s, '=(.*)', 1)) AS v,
    len(list_filter(string_split(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '')) AS segments
  FROM merged m JOIN counts USING (hostname)
),
flags AS (SELECT *, regexp_matches(rest, '{rules.OPAQUE}') AS opaque FROM seen),
classified AS (
  SELECT url, list_sort(list_distinct(list_filter(list_concat(sources, [
    CASE WHEN regexp_matches(url, '{rules.UUID}') OR regexp_matches(url, '{rules.HASH}') THEN 'uuid-or-hash-bearing' END,
    CASE WHEN len(list_filter(v, lambda x: regexp_matches(url_decode(replace(x, '+', ' ')), '(?i)^https?://') OR regexp_matches(url_decode(url_decode(replace(x, '+', ' '))), '(?i)^https?://'))) > 0 THEN 'wrapped' END,
    CASE WHEN len(v) >= 4 OR (contains(rest, '?') AND length(regexp_extract(rest, '[?][^#]*')) >= 100) THEN 'query-heavy' END,
    CASE WHEN host_count = 1 THEN 'unknown-host' END, CASE WHEN opaque THEN 'opaque-id' END, CASE WHEN popular THEN 'popular-host' END,
    CASE WHEN popular AND opaque THEN 'popular-host-opaque-id' END, CASE WHEN popular AND NOT opaque AND segments <= 2 THEN 'popular-host-short-path' END
  ]), lambda x: x IS NOT NULL))) AS classes FROM flags
)"""


@query(f"WITH {_CLASSIFY} SELECT url, array_to_string(classes, ',') AS classes FROM classified", "web_urls")
def classify_url(spark, sf_dir):
    return prepare.classified(_merged(spark, sf_dir)).select("url", F.array_join("classes", ",").alias("classes"))


@query(f"WITH {_CLASSIFY} SELECT class, count(*) AS urls FROM (SELECT unnest(classes) AS class FROM classified) t GROUP BY class", "web_urls")
def class_counts(spark, sf_dir):
    return prepare.classified(_merged(spark, sf_dir)).select(F.explode("classes").alias("class")).groupBy("class").agg(F.count("*").alias("urls"))


@query("SELECT CASE WHEN url LIKE 'ftp:%' THEN 'unsupported-protocol' ELSE 'invalid-url' END AS code, count(*) AS rows FROM url_candidates WHERE url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' GROUP BY 1", "url_candidates")
def rejection_counts(spark, sf_dir):
    return staging.rejection_counts(staging.rejected(staging.canonicalized(view(spark, sf_dir, "url_candidates"))))


@query("SELECT ordinal, url, CASE WHEN url LIKE 'ftp:%' THEN 'unsupported-protocol' ELSE 'invalid-url' END AS code FROM url_candidates WHERE url NOT LIKE 'http://%' AND url NOT LIKE 'https://%' ORDER BY ordinal LIMIT 100", "url_candidates")
def rejection_sample(spark, sf_dir):
    return staging.rejection_sample(staging.rejected(staging.canonicalized(view(spark, sf_dir, "url_candidates")))).select("ordinal", "url", "code")


_DESCRIBE = lambda v: f'count({v}) AS "count", min({v})::DOUBLE AS "min", max({v})::DOUBLE AS "max", round(avg({v}), 6) AS mean, quantile_cont({v}::DOUBLE, 0.5) AS median, quantile_cont({v}::DOUBLE, 0.5) AS p50, round(quantile_cont({v}::DOUBLE, 0.95), 6) AS p95, round(quantile_cont({v}::DOUBLE, 0.99), 6) AS p99'
_ROUNDED = ("mean", "p95", "p99")


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in _ROUNDED})


@query(f"SELECT {_DESCRIBE('length(url)')} FROM event_urls", "event_urls")
def describe_lengths(spark, sf_dir):
    return _rounded(evaluate.describe_frame(view(spark, sf_dir, "event_urls").withColumn("n", F.length("url")), "n"))


@query(f"SELECT class, {_DESCRIBE('size')} FROM codec_results GROUP BY class", "codec_results")
def describe_by_class(spark, sf_dir):
    return _rounded(evaluate.describe_frame(view(spark, sf_dir, "codec_results"), "size", ["class"]))


@query(f"SELECT assignment, {_DESCRIBE('size')} FROM codec_results GROUP BY assignment", "codec_results")
def describe_by_split(spark, sf_dir):
    return _rounded(evaluate.describe_frame(view(spark, sf_dir, "codec_results"), "size", ["assignment"]))


def _summary_sql(by: str, where: str = "") -> str:
    return f"""WITH r AS (SELECT *, 'seenHost:' || assignment AS split FROM codec_results {where}),
reasons AS (SELECT {by}, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons FROM (SELECT {by}, reason, count(*) AS n FROM r WHERE status <> 'exact' AND reason IS NOT NULL GROUP BY ALL) t GROUP BY {by}),
statuses AS (SELECT {by}, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM (SELECT {by}, status, count(*) AS n FROM r GROUP BY ALL) t GROUP BY {by})
SELECT {by}, count(*) AS total, CAST(count_if(status = 'exact') AS BIGINT) AS "exact", round(count_if(status = 'exact') / count(*)::DOUBLE, 6) AS exact_rate, any_value(statuses) AS statuses, any_value(reasons) AS reasons, quantile_cont(size::DOUBLE, 0.5) AS median
FROM r JOIN statuses USING ({by}) LEFT JOIN reasons USING ({by}) GROUP BY {by}"""


def _flat(df: DataFrame, by: str) -> DataFrame:
    joined = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return df.select(by, "total", "exact", F.round("exact_rate", 6).alias("exact_rate"), joined("statuses").alias("statuses"), joined("reasons").alias("reasons"), "payload_symbols.median")


def _results(spark, sf_dir):
    rows = view(spark, sf_dir, "codec_results").withColumn("payload_symbols", F.col("size")).withColumn("rendered_characters", F.col("size"))
    return rows.withColumn("classes", F.array("class")).withColumn("splits", F.create_map(F.lit("seenHost"), "assignment"))


@query(_summary_sql("class"), "codec_results")
def summarize_by_class(spark, sf_dir):
    return _flat(evaluate.by_class(_results(spark, sf_dir)), "class")


@query(_summary_sql("split"), "codec_results")
def summarize_by_split(spark, sf_dir):
    return _flat(evaluate.by_split(_results(spark, sf_dir)), "split")


@query("SELECT ordinal, expected, status, reason FROM codec_results WHERE status <> 'exact' ORDER BY ordinal LIMIT 10", "codec_results")
def failure_sample(spark, sf_dir):
    return evaluate.failures(view(spark, sf_dir, "codec_results")).select("ordinal", "expected", "status", "reason")


@query("SELECT ordinal FROM codec_results WHERE assignment = 'test'", "codec_results")
def select_records(spark, sf_dir):
    return evaluate.select_records(_results(spark, sf_dir), "seen-host:test").select("ordinal")




def _url_part(side: str) -> str:
    """Origin in lower case, path, path without empty segments, query without a bare mark, fragment and all behind the path of a URL, in SQL."""
    path = f"coalesce(nullif(regexp_extract({side}, '^[^/?#]*//[^/?#]*([^?#]*)', 1), ''), '/')"
    return f"""lower(regexp_extract({side}, '^[^/?#]*//[^/?#]*')) AS {side}_origin, {path} AS {side}_path,
regexp_replace({path}, '/+', '/', 'g') AS {side}_dense, regexp_extract({side}, '^[^?#]*[?]([^#]*)', 1) AS {side}_query,
regexp_extract({side}, '#(.*)', 1) AS {side}_fragment, regexp_extract({side}, '^[^?#]*(.*)', 1) AS {side}_tail"""


@query(
    f"""SELECT ordinal, CASE WHEN actual IS NULL THEN NULL WHEN expected = actual THEN 'exact' WHEN expected || '/' = actual OR actual || '/' = expected THEN 'trailing-slash'
WHEN expected IN (actual || '?', actual || '#') THEN 'bare-query-or-fragment'
WHEN contains(expected, '?') AND NOT contains(expected, '#') AND expected || '=' = actual THEN 'valueless-parameter'
WHEN expected_origin <> actual_origin THEN 'other'
WHEN expected_dense || expected_tail = actual_dense || actual_tail THEN 'path-slash-normalization'
WHEN expected_path = actual_path AND expected_fragment = actual_fragment AND expected_query <> actual_query THEN 'query-changed' ELSE 'other' END AS label
FROM (SELECT ordinal, expected, actual, {_url_part('expected')}, {_url_part('actual')} FROM codec_results) t""",
    "codec_results",
)
def classify_difference(spark, sf_dir):
    rows = view(spark, sf_dir, "codec_results")
    return rows.select("ordinal", strings.classify_difference(F.col("expected"), F.col("actual")).alias("label"))


_ALPHABET = rules.CODEC_ALPHABET.replace("'", "''")
_TRAIN, _TEST = "SELECT url FROM event_urls WHERE ordinal % 4 <> 0", "SELECT url FROM event_urls WHERE ordinal % 4 = 0"
_TOKENS = f"list_append(list_transform(regexp_extract_all(url, '.'), lambda c: instr('{_ALPHABET}', c) - 1), 91)"
_TOKEN_ROWS = f"""
tokens AS (SELECT u.*, {_TOKENS} AS w FROM (SELECT url, true AS train FROM ({_TRAIN}) a UNION ALL SELECT url, false FROM ({_TEST}) b) u WHERE strlen(url) <= 511),
rows AS (SELECT url, train, w, unnest(range(0, len(w))) AS pos FROM tokens)"""


def _halves(spark, sf_dir):
    urls = spread(view(spark, sf_dir, "event_urls"))
    return urls.filter("ordinal % 4 <> 0"), urls.filter("ordinal % 4 = 0")


@query(
    f"""WITH {_TOKEN_ROWS}, t AS (SELECT url, train, w[pos + 1] AS target FROM rows), c AS (SELECT target, count(*) AS n FROM t WHERE train GROUP BY target), s AS (SELECT sum(n) + 0.5::DOUBLE * 92 AS total FROM c)
SELECT url, round(sum(-log2((coalesce(n, 0) + 0.5::DOUBLE) / total)), 6) AS bits FROM t LEFT JOIN c USING (target), s WHERE NOT train GROUP BY url""",
    "event_urls",
)
def unigram_bits(spark, sf_dir):
    return models.unigram_bits(*_halves(spark, sf_dir)).select(F.col("id").alias("url"), F.round("bits", 6).alias("bits"))


def _context_sql(order: int) -> str:
    out = "0"
    for back in range(order, 0, -1):
        out = f"({out} * 92 + CASE WHEN pos >= {back} THEN w[pos - {back} + 1] ELSE 91 END) % {models.BUCKETS[order - 1]}"
    return out


def _ngram_sql() -> str:
    contexts = ", ".join(f"{_context_sql(k)} AS c{k}" for k in range(1, 5))
    tables, joins, p = "", "", "(coalesce(u.n, 0) + 0.5::DOUBLE) / (s.total + 46::DOUBLE)"
    for k in range(1, 5):
        tables += f", n{k} AS (SELECT c{k}, target, count(*) AS n FROM t WHERE train GROUP BY ALL), t{k} AS (SELECT c{k}, sum(n) AS n FROM n{k} GROUP BY c{k})"
        joins += f" LEFT JOIN n{k} ON n{k}.c{k} = t.c{k} AND n{k}.target = t.target LEFT JOIN t{k} ON t{k}.c{k} = t.c{k}"
        p = f"((coalesce(n{k}.n, 0) + 8::DOUBLE * {p}) / (coalesce(t{k}.n, 0) + 8::DOUBLE))"
    return f"""WITH {_TOKEN_ROWS}, t AS (SELECT url, train, w[pos + 1] AS target, {contexts} FROM rows), u AS (SELECT target, count(*) AS n FROM t WHERE train GROUP BY target), s AS (SELECT sum(n) AS total FROM u){tables}
SELECT t.url, round(sum(-log2({p})), 6) AS bits FROM t LEFT JOIN u ON u.target = t.target CROSS JOIN s {joins} WHERE NOT t.train GROUP BY t.url"""


@query(_ngram_sql(), "event_urls")
def ngram_bits(spark, sf_dir):
    return models.ngram_bits(*_halves(spark, sf_dir)).select(F.col("id").alias("url"), F.round("bits", 6).alias("bits"))


@query("SELECT count(*) AS urls, CAST(count_if(strlen(url) > 40) AS BIGINT) AS excluded FROM event_urls", "event_urls")
def excluded_count(spark, sf_dir):
    return models.excluded_count(view(spark, sf_dir, "event_urls"), most=40)




@query()
def fragment_frame(spark, sf_dir):
    rows = view(spark, sf_dir, "event_urls").withColumn("codec_id", F.when(F.col("ordinal") % 5 > 0, F.col("ordinal") % 130 + 1))
    return rows.select("ordinal", codec.frame_payload(F.col("url").cast("binary"), F.col("codec_id")).alias("f")).select("ordinal", F.col("f.value").alias("fragment"), "f.error")


@query()
def fragment_roundtrip(spark, sf_dir):
    links = codec.FragmentCodec({1: codec.IdentityCodec()}, 1, codec.V1_LIMITS)
    return evaluate.benchmark(spread(view(spark, sf_dir, "event_urls")), links).select("ordinal", "status", "reason", "rendered_characters")


@query("SELECT ordinal, CAST(ceil(strlen(url) * 8 / log2(84::DOUBLE)) AS BIGINT) AS c84, CAST(ceil(strlen(url) * 8 / log2(43::DOUBLE)) AS BIGINT) AS c43 FROM event_urls", "event_urls")
def payload_char_estimate(spark, sf_dir):
    return view(spark, sf_dir, "event_urls").select("ordinal", hashing.payload_characters(F.octet_length("url"), 84).alias("c84"), hashing.payload_characters(F.octet_length("url"), 43).alias("c43"))


@query(
    """WITH v AS (SELECT lower(raw) AS value, last_modified, id, pos FROM (SELECT id, last_modified, unnest(string_split(strip, ',')) AS raw, generate_subscripts(string_split(strip, ','), 1) AS pos FROM rule_records WHERE NOT deleted) t),
f AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY last_modified DESC, id, pos) AS k FROM v)
SELECT value, row_number() OVER (ORDER BY last_modified DESC, id, pos) AS position FROM f WHERE k = 1""",
    "rule_records",
)
def rule_list_compile(spark, sf_dir):
    rows = view(spark, sf_dir, "rule_records").withColumn("stripList", F.split("strip", ","))
    return rulelists.compile_parameters(rows).select("value", F.col("position").cast("bigint").alias("position"))


@query(
    r"""SELECT size_text, CASE WHEN regexp_matches(size_text, '(?i)^[0-9]+([.][0-9]+)?\s*(B|KB|MB|GB|KIB|MIB|GIB)?\z') AND b > 0 THEN CAST(floor(b) AS BIGINT) END AS bytes
FROM (SELECT *, TRY_CAST(regexp_extract(size_text, '^([0-9.]+)', 1) AS DOUBLE) * CASE upper(regexp_extract(size_text, '([A-Za-z]+)\z', 1)) WHEN 'KB' THEN 1000 WHEN 'MB' THEN 1000000 WHEN 'GB' THEN 1000000000 WHEN 'KIB' THEN 1024 WHEN 'MIB' THEN 1048576 WHEN 'GIB' THEN 1073741824 ELSE 1 END AS b FROM sizes) t""",
    "sizes",
)
def byte_size_parse(spark, sf_dir):
    return view(spark, sf_dir, "sizes").select("size_text", strings.byte_size(F.col("size_text")).alias("bytes"))


@query(f"WITH {_CANDIDATES} SELECT url, CAST(coalesce(sum(strlen(url)) OVER (ORDER BY url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte FROM candidates", "web_urls")
def pack_offsets(spark, sf_dir):
    """Start byte of every record in the packs in their order, read back from their offsets."""
    rows = _candidates(spark, sf_dir).withColumn("split", F.lit(0))
    packs = corpus.pack_shards(rows, PACK_BYTES)  # one range: each shard is bounded, and the cut is the same when read again
    base = packs.select("shard", (F.sum("url_bytes").over(Window.orderBy("shard")) - F.col("url_bytes")).alias("base"))
    records = corpus.unpack(packs).join(base, "shard")
    w = Window.partitionBy("shard").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    return records.select("url", (F.col("base") + F.coalesce(F.sum(F.octet_length("url")).over(w), F.lit(0))).cast("bigint").alias("start_byte"))


@query(f"WITH {_CANDIDATES}, {_five_way('candidates')} SELECT url, CAST(split AS INTEGER) AS split FROM five", "web_urls")
def pack_roundtrip(spark, sf_dir):
    """Records of a corpus after packing into many shards and unpacking."""
    rows = splits.five_way_splits(_candidates(spark, sf_dir), SEED)
    return corpus.unpack(corpus.pack_shards(rows, 4096, ranges=4)).select("url", F.col("split").cast("int").alias("split"))


@query(f"WITH {_CANDIDATES}, {_five_way('candidates')} SELECT count(*) AS rows, count(DISTINCT url) AS urls, CAST(count_if(url IS NULL OR url = '' OR split NOT BETWEEN 0 AND 4) AS BIGINT) AS invalid FROM five", "web_urls")
def corpus_facts(spark, sf_dir):
    return verify.corpus_facts(splits.five_way_splits(_candidates(spark, sf_dir), SEED))


@query("SELECT 'percent-byte-' || printf('%02X', i) AS name, 'https://bytes.example/path?value=%' || printf('%02X', i) AS url FROM range(256) t(i)")
def adversarial_bytes(spark, sf_dir):
    return adversarial.byte_cases(spark).select("name", "url")


@query("SELECT LEAST(15, GREATEST(0, CAST(ceil(log2(greatest(1, strlen(url)))) AS INTEGER))) AS len_bucket, count(*) AS urls FROM event_urls GROUP BY 1", "event_urls")
def length_buckets(spark, sf_dir):
    return corpus.length_buckets(view(spark, sf_dir, "event_urls"), 7).groupBy("len_bucket").agg(F.count("*").alias("urls"))


@query("SELECT regexp_matches(url, '^[!#-;=?-~]*\\z') AS ok, count(*) AS urls FROM url_candidates GROUP BY 1", "url_candidates")
def codec_alphabet(spark, sf_dir):
    return view(spark, sf_dir, "url_candidates").groupBy(strings.is_codec_spelling(F.col("url")).alias("ok")).agg(F.count("*").alias("urls"))


@query("SELECT hostname, hostname = 'example.com' OR ends_with(hostname, '.example.com') AS inside, count(*) AS urls FROM web_urls GROUP BY ALL", "web_urls")
def host_suffix(spark, sf_dir):
    return view(spark, sf_dir, "web_urls").groupBy("hostname", strings.host_has_suffix(F.col("hostname"), "example.com").alias("inside")).agg(F.count("*").alias("urls"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_sample_split(spark, sf_dir)


__all__ = ["ORACLE_SQL", "QUERIES", "flagship", "table"]

"""Input views derived from the driver's tables, stated so that Spark and DuckDB can both make them.

``VIEWS`` holds SQL that both engines run as it stands; functions give them as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# URL variants by page number: tracked parameters, copies that cleaning joins, wrappers, signatures, credentials, other schemes.
URL_CANDIDATES = """
SELECT page_id * 2 + 1 AS ordinal, 'crawl' AS source, url AS base_url,
  CASE page_id % 12
    WHEN 0 THEN concat(url, CASE WHEN url LIKE '%#%' THEN '' WHEN url LIKE '%?%' THEN '&fbclid=x1' ELSE '?fbclid=x1' END)
    WHEN 1 THEN concat('https://shop.example/item/index.html?utm_source=mail&id=', CAST(page_id % 40 AS STRING))
    WHEN 2 THEN concat('https://www.amazon.com/Some-Thing/dp/B0', lpad(CAST(page_id % 50 AS STRING), 8, '0'), '/ref=x?th=1')
    WHEN 3 THEN concat('https://cdn.example.com/f/', CAST(page_id AS STRING), '?X-Amz-Date=2026&X-Amz-Signature=ab')
    WHEN 4 THEN concat('https://user:pw@example.com/', CAST(page_id AS STRING))
    WHEN 5 THEN concat('ftp://files.example.com/', CAST(page_id AS STRING))
    WHEN 6 THEN concat('https://example.com/items/123e4567-e89b-12d3-a456-', lpad(CAST(page_id AS STRING), 12, '0'))
    WHEN 7 THEN concat('https://example.org/redirect?url=https%3A%2F%2Fa.example%2F', CAST(page_id AS STRING))
    WHEN 8 THEN 'not a url'
    WHEN 9 THEN concat('https://app.example/s?a=1&b=2&c=3&d=', CAST(page_id AS STRING), '&gclid=z&keep')
    WHEN 10 THEN concat('https://account.blob.core.windows.net/c/o?se=2026&sig=x', CAST(page_id AS STRING))
    ELSE url
  END AS url
FROM pages
UNION ALL
SELECT page_id * 2 + 2 AS ordinal, 'list' AS source, url AS base_url, url FROM pages WHERE page_id % 3 = 0
"""

# Serialised http and https URLs of the view before, with the host.
WEB_URLS = f"""
SELECT ordinal, source, url, lower(regexp_extract(url, '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS hostname
FROM ({URL_CANDIDATES}) u WHERE url LIKE 'http://%' OR url LIKE 'https://%'
"""

URL_TIMES = """
SELECT p.url, p.page_id, e.ts FROM pages p LEFT JOIN events e ON p.page_id = e.event_id AND p.page_id % 7 <> 0
"""

INDEX_ROWS = """
SELECT url, regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) AS url_host_name, regexp_extract(url, '^([a-z]+):', 1) AS url_protocol,
  CAST(CASE WHEN page_id % 11 = 0 THEN 404 ELSE 200 END AS SMALLINT) AS fetch_status,
  CASE WHEN page_id % 5 = 0 THEN 'image/png' ELSE 'text/html' END AS content_mime_type,
  CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 10 = 1 THEN 'application/pdf' ELSE 'text/html' END AS content_mime_detected,
  CASE WHEN page_id % 13 = 0 THEN 'older' ELSE 'current' END AS crawl, CASE WHEN page_id % 17 = 0 THEN 'robotstxt' ELSE 'warc' END AS subset
FROM pages
"""

EVENT_URLS = """
SELECT event_id AS ordinal, concat('https://app', CAST(user_id % 97 AS STRING), '.example/', event_type, '/', CAST(user_id AS STRING), '?e=', CAST(event_id AS STRING)) AS url,
  concat('app', CAST(user_id % 97 AS STRING), '.example') AS hostname
FROM events
"""

CODEC_RESULTS = """
SELECT page_id AS ordinal, url AS expected,
  CASE page_id % 9
    WHEN 0 THEN url WHEN 1 THEN concat(url, '/') WHEN 2 THEN concat(url, '?') WHEN 3 THEN replace(url, 'http', 'HTTP')
    WHEN 4 THEN NULL WHEN 5 THEN url WHEN 6 THEN url WHEN 7 THEN concat(url, 'x') ELSE url
  END AS actual,
  CASE page_id % 9 WHEN 1 THEN 'mismatch' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'mismatch' WHEN 4 THEN 'encode-error' WHEN 7 THEN 'mismatch' ELSE 'exact' END AS status,
  CASE page_id % 9 WHEN 1 THEN 'trailing-slash' WHEN 2 THEN 'bare-query-or-fragment' WHEN 3 THEN 'other' WHEN 4 THEN 'too-long' WHEN 7 THEN 'other' END AS reason,
  CASE WHEN page_id % 2 = 0 THEN 'even' ELSE 'odd' END AS class, CASE WHEN page_id % 3 = 0 THEN 'test' ELSE 'train' END AS assignment,
  CASE WHEN page_id % 9 <> 4 THEN length(url) END AS size
FROM pages
"""

RULE_RECORDS = """
SELECT * FROM (VALUES
  ('b-record', 200, 'gclid,SHARED,_ga', 'example.com', false), ('a-record', 100, 'shared,fbclid,Gclid', 'EXAMPLE.com,other.example', false),
  ('c-record', 300, 'gone', 'gone.example', true), ('d-record', 100, 'zclid', '', false)
) AS t(id, last_modified, strip, allow, deleted)
"""

SIZES = "SELECT * FROM (VALUES ('70GB'), ('256MiB'), ('1.5 kib'), ('12'), ('0B'), ('x'), ('3 TB'), ('10 mb')) AS t(size_text)"

VIEWS = {"url_candidates": URL_CANDIDATES, "web_urls": WEB_URLS, "url_times": URL_TIMES, "index_rows": INDEX_ROWS, "event_urls": EVENT_URLS, "codec_results": CODEC_RESULTS, "rule_records": RULE_RECORDS, "sizes": SIZES}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view as a DataFrame; temporary names stay out of the catalog of the session."""
    return spark.sql(VIEWS[name].replace("FROM pages", "FROM {pages}").replace("JOIN events", "JOIN {events}").replace("FROM events", "FROM {events}"), **{t: table(spark, sf_dir, t) for t in ("pages", "events") if f" {t}" in VIEWS[name]})

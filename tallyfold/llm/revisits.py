"""Resolution of not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A crawl archive stores a page once and, while the server answers 304, only records that it had not changed. Each
such revisit is resolved to the latest response with a body that was captured before it under the same canonical URL. The
validators must agree (entity tags by weak comparison, else the modification dates); then the stored headers are
updated with those of the revisit that a 304 may change.

The join is an ordered scan that carries the last response forward in time, cut into time slices inside each URL, so
a URL with a large share of all captures is spread over many tasks. Bodies take no part in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyfold.operators.scan import carry_forward

# fixed values: header fields of a 304 that never update a stored response
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authentication-info", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
TRACKING = r"(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def canonical(url: Column) -> Column:
    """A URL without scheme, www, default port, fragment, tracking parameters and trailing slash, its host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[a-zA-Z]+://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, r"\?(.*)$", 1), TRACKING, ""), "^&", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolved(captures: DataFrame) -> DataFrame:
    """(record_id, url, captured, outcome, response_id, headers, payload_digest) of every revisit.

    ``captures`` has record_id, url, captured (long), kind, status, headers (map with lower-case names) and
    payload_digest; other columns are not read. Full responses are of kind response and status 200 with a digest;
    revisits are of kind revisit. outcome is resolved, mismatch (validators differ), no_validator (the revisit has
    none that the response has too) or no_response (none is earlier, or URL or time is null); only resolved rows have
    response_id, headers and digest. Of responses at one time the one with the greatest record_id counts; one at the revisit's own
    time is not earlier. Repeated rows stay; an empty table gives no rows.
    """
    rows = captures.select("record_id", "captured", "kind", "status", "headers", "payload_digest", canonical(F.col("url")).alias("url"))
    full = (F.col("kind") == "response") & (F.col("status") == 200) & F.col("payload_digest").isNotNull()
    known = F.col("url").isNotNull() & F.col("captured").isNotNull()
    stored = F.when(full, F.struct("record_id", "headers", "payload_digest"))
    wanted = rows.where(((F.col("kind") == "revisit") | full) & known).withColumns({"stored": stored, "turn": F.when(full, 1).otherwise(0), "tie": F.coalesce("record_id", F.lit(""))})
    met = carry_forward(wanted, ["url"], ["captured", "turn", "tie"], ["stored"], F.col("captured")).where("turn = 0").drop("turn", "tie")
    lost = rows.where((F.col("kind") == "revisit") & ~known).withColumn("stored", F.lit(None).cast(met.schema["stored"].dataType))
    every = met.select("record_id", "url", "captured", "headers", "stored").unionByName(lost.select("record_id", "url", "captured", "headers", "stored"))
    new, old = F.coalesce("headers", F.create_map().cast("map<string,string>")), F.col("stored.headers")
    tag, old_tag = new["etag"], old["etag"]
    date, old_date = new["last-modified"], old["last-modified"]
    agree = F.when(tag.isNotNull() & old_tag.isNotNull(), _weak(tag) == _weak(old_tag)).when(date.isNotNull() & old_date.isNotNull(), date == old_date)
    outcome = F.when(F.col("stored").isNull(), "no_response").when(agree.isNull(), "no_validator").when(agree, "resolved").otherwise("mismatch")
    update = F.map_filter(new, lambda k, v: ~k.isin(*NOT_UPDATED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(update, k)), update)
    at = every.select("record_id", "url", "captured", outcome.alias("outcome"), "stored", merged.alias("merged"))
    good = F.col("outcome") == "resolved"
    return at.select(
        "record_id", "url", "captured", "outcome", F.when(good, F.col("stored.record_id")).alias("response_id"),
        F.when(good, F.col("merged")).alias("headers"), F.when(good, F.col("stored.payload_digest")).alias("payload_digest"),
    )


def with_payload(found: DataFrame, captures: DataFrame) -> DataFrame:
    """Resolved revisits with the body of their response; the others keep a null one. Record ids must be unique among responses."""
    bodies = captures.where("kind = 'response'").select(F.col("record_id").alias("response_id"), "payload")
    return found.join(bodies, "response_id", "left").select(*found.columns, "payload")


def header_text(headers: Column) -> Column:
    """Headers as sorted lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat_ws(": ", e["key"], e["value"])), "\n")


# --- a crawl derived from raw pages ---

START, MINUTE, DAY = 1_700_000_000, 60, 86_400

RESPONSES = f"""
SELECT 'r' || CAST(page_id AS STRING) AS record_id, url, {START} + page_id * {MINUTE} AS captured, 'response' AS kind, 200 AS status, sha2(html, 256) AS payload_digest, html AS payload,
  map('content-type', 'text/html', 'content-length', CAST(length(html) AS STRING), 'etag', '"' || substr(sha2(html, 256), 1, 16) || '"',
      'last-modified', CAST({START} + page_id * {MINUTE} - 10 AS STRING), 'cache-control', 'max-age=600') AS headers
FROM {{pages}}
"""
REVISITS = f"""
SELECT 'v' || CAST(page_id AS STRING) AS record_id, regexp_replace(url, '^https?', 'HTTPS') || '#again' AS url,
  {START} + page_id * {MINUTE} + CASE WHEN page_id % 13 = 0 THEN -1 ELSE {DAY} * (1 + page_id % 5) END AS captured, 'revisit' AS kind, 304 AS status,
  CAST(NULL AS STRING) AS payload_digest, CAST(NULL AS STRING) AS payload,
  map_filter(map('etag', CASE WHEN page_id % 7 = 0 THEN '"stale"' WHEN page_id % 11 = 0 OR page_id % 17 = 0 THEN NULL ELSE 'W/"' || substr(sha2(html, 256), 1, 16) || '"' END,
      'last-modified', CASE WHEN page_id % 11 = 0 THEN CAST({START} + page_id * {MINUTE} - 10 AS STRING) END,
      'cache-control', 'max-age=900', 'content-length', '0', 'date', CAST(page_id AS STRING)), (k, v) -> v IS NOT NULL) AS headers
FROM {{pages}}
"""


def captures_of(pages: DataFrame) -> DataFrame:
    """A crawl with one full response and one later (sometimes earlier, stale or unvalidated) revisit for each page."""
    spark = pages.sparkSession
    return spark.sql(RESPONSES, pages=pages).unionByName(spark.sql(REVISITS, pages=pages))


_BARE = "regexp_replace(regexp_replace(trim(url), '^[a-zA-Z]+://', ''), '#.*$', '')"
_HOST = f"regexp_replace(regexp_replace(lower(regexp_extract({_BARE}, '^[^/?]*', 0)), '^www\\.', ''), ':(80|443)$', '')"
_PATH = f"regexp_replace(regexp_extract({_BARE}, '^[^/?]*([^?]*)', 1), '/+$', '')"
_QUERY = f"regexp_replace(regexp_replace(regexp_extract({_BARE}, '\\?(.*)$', 1), '{TRACKING}', '', 'g'), '^&', '')"

SQL = f"""
WITH p AS (SELECT page_id, {_HOST} || {_PATH} || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END AS url, sha256(html) AS digest, length(html) AS n FROM pages),
r AS (SELECT page_id AS rid, 'r' || page_id AS response_id, url, {START} + page_id * {MINUTE} AS at, digest, n, substr(digest, 1, 16) AS tag, CAST({START} + page_id * {MINUTE} - 10 AS VARCHAR) AS lm FROM p),
v AS (SELECT page_id, 'v' || page_id AS record_id, url, {START} + page_id * {MINUTE} + CASE WHEN page_id % 13 = 0 THEN -1 ELSE {DAY} * (1 + page_id % 5) END AS captured,
  CASE WHEN page_id % 7 = 0 THEN 'stale' WHEN page_id % 11 = 0 OR page_id % 17 = 0 THEN NULL ELSE substr(digest, 1, 16) END AS tag,
  CASE WHEN page_id % 11 = 0 THEN CAST({START} + page_id * {MINUTE} - 10 AS VARCHAR) END AS lm FROM p),
j AS (SELECT v.*, r.response_id, r.digest, r.n, r.tag AS rtag, r.lm AS rlm, row_number() OVER (PARTITION BY v.page_id ORDER BY r.at DESC NULLS LAST, r.response_id DESC) AS k
  FROM v LEFT JOIN r ON r.url = v.url AND r.at < v.captured),
o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag IS NOT NULL THEN CASE WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END
  WHEN lm IS NOT NULL THEN CASE WHEN lm = rlm THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome FROM j WHERE k = 1)
SELECT record_id, url, captured, outcome, CASE WHEN outcome = 'resolved' THEN response_id END AS response_id, CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=900' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || page_id || chr(10) ||
    'etag: ' || CASE WHEN tag IS NOT NULL THEN 'W/' ELSE '' END || '"' || coalesce(tag, rtag) || '"' || chr(10) || 'last-modified: ' || coalesce(lm, rlm) END AS headers FROM o
"""

"""Queries that crawl the pages through a stand-in for a site, and save what they find by its content."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators.relational import half_year
from lexmill.plans.registry import query
from lexmill.session import Workspace
from lexmill.sources import crawl, store

#: Of a page: its site, and a date of filing made from the number in its address.
_FILED = "DATE '2015-01-01' + CAST(coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER), 0) % 3650 AS INTEGER)"
_SITE = "coalesce(nullif(regexp_extract(lower(url), '^[a-z]+://[^/:?#]*?([^/.:?#]+\\.[^/.:?#]+)(?:[/:?#]|$)', 1), ''), 'none')"
_HALF = "year(filed) || CASE WHEN month(filed) <= 6 THEN 'H1' ELSE 'H2' END"
#: What is asked for; what several questions find counts for the first.
QUESTIONS, SIZE = ["/en/", "/de/", "ref=", "/"], 50


def _site(url):
    s = F.regexp_extract(F.lower(url), r"^[a-z]+://[^/:?#]*?([^/.:?#]+\.[^/.:?#]+)(?:[/:?#]|$)", 1)
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("none"))


def _site_of_pages(t):
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(url, '/([0-9]+)', 1) as int)"), F.lit(0)) % 3650
    filed = F.date_add(F.lit("2015-01-01").cast("date"), number)
    x = t.pages.select(F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("content"), filed.alias("filed"))
    return x.select(F.col("id").cast("string").alias("id"), "url", "content", F.col("filed").cast("string").alias("filed"), _site(F.col("url")).alias("host"), half_year(filed).alias("window"))


_CRAWL = f"""
WITH p AS (SELECT CAST(page_id AS VARCHAR) AS id, coalesce(url, '') AS url, coalesce(html, '') AS content, {_FILED} AS filed FROM pages),
s AS (SELECT *, {_SITE} AS host, {_HALF} AS win FROM p),
hits AS (
  SELECT id, host, win, q, content, row_number() OVER (PARTITION BY host, win, q ORDER BY filed DESC, id) - 1 AS k
  FROM s, unnest(range(0, {len(QUESTIONS)})) AS t(q) WHERE contains(url, {QUESTIONS!r}[q + 1])
),
sizes AS (SELECT x.host, x.win, g.q, greatest(1, ceil(count(hits.id) / {SIZE}.0)) AS n FROM (SELECT DISTINCT host, win FROM s) x CROSS JOIN (SELECT unnest(range(0, {len(QUESTIONS)})) AS q) g LEFT JOIN hits ON hits.host = x.host AND hits.win = x.win AND hits.q = g.q GROUP BY ALL),
before AS (SELECT host, win, q, coalesce(sum(n) OVER (PARTITION BY host, win ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sizes)
SELECT id, host, win AS "window", CAST(base + k // {SIZE} AS INTEGER) AS request, CAST(q AS INTEGER) AS query, CAST(k // {SIZE} AS INTEGER) AS page, CAST(k % {SIZE} AS INTEGER) AS place, sha256(content) AS digest
FROM hits JOIN before USING (host, win, q)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY q) = 1
"""


@query(_CRAWL)
def crawled_pages(t):
    """All pages by way of a site that gives them out in cursor pages, for a plan of hosts, half-years and questions;
    a page that several questions find comes once, with the request that found it first."""
    ws = Workspace(t.spark, "crawl")
    site = _site_of_pages(t)
    site.repartition("host", "window").write.partitionBy("host", "window").parquet(ws.at("site"))
    plan = t.spark.read.parquet(ws.at("site")).select("host", "window")
    found = crawl.crawl(t.spark, plan, QUESTIONS, "lexmill.sources.crawl:FolderServer", {"folder": ws.at("site"), "size": SIZE}, ws.at("answers"))
    out = crawl.first_found(found)
    return out.select("id", "host", "window", "request", "query", "page", "place", F.sha2(F.col("content").cast("binary"), 256).alias("digest"))


_KIND = r"CASE WHEN regexp_matches(ltrim(lower(substr(html, 1, 200))), '^<(!doctype html|html)') THEN 'html' ELSE 'other' END"
_STORE = rf"""
WITH p AS (
  SELECT page_id, html, sha256(html) AS digest, {_KIND} AS kind, strlen(html) AS bytes, page_id % 4 = 1 AS early,
    CASE WHEN html IS NULL OR html = '' THEN 'empty' WHEN {_KIND} <> 'html' OR regexp_matches(lower(html), '<title>[^<]*(not found|404|access denied)') THEN 'refused' END AS d
  FROM pages
),
old AS (SELECT DISTINCT digest FROM p WHERE early AND d IS NULL)
SELECT page_id, CASE WHEN d IS NOT NULL THEN d WHEN digest IN (SELECT digest FROM old) THEN 'exists' WHEN page_id = min(page_id) OVER (PARTITION BY digest, d IS NULL) THEN 'saved' ELSE 'duplicate' END AS decision,
  digest, CAST(CASE WHEN d IS NULL THEN bytes END AS BIGINT) AS stored_bytes
FROM p WHERE NOT early
"""


@query(_STORE)
def content_store(t):
    """Pages saved under a digest of their content in two runs; what the second decides for each page, and the size of
    what the store has under its digest, read back and digested anew."""
    root = Workspace(t.spark, "objects").at("store")
    pages = t.pages.select("page_id", "html")
    store.save(pages.where("page_id % 4 = 1"), root, "page_id", "html", kind="html")
    now = store.save(pages.where("not coalesce(page_id % 4 = 1, false)"), root, "page_id", "html", kind="html")
    there = store.objects(t.spark, root).select(F.sha2("content", 256).alias("digest"), F.octet_length("content").cast("bigint").alias("stored_bytes"))
    kept = F.when(F.col("decision").isin("saved", "exists", "duplicate"), F.col("stored_bytes"))
    return now.join(there, "digest", "left").select(F.col("key").cast("bigint").alias("page_id"), "decision", "digest", kept.alias("stored_bytes"))

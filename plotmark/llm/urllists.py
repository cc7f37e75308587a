"""Captures and dated list entries derived from the pages table, in Spark and in SQL.

The supplied tables have urls but neither fetch times nor lists. A page's fetch day follows
from its id. Hosts, their parent domains, first path segments and whole urls of the pages
stand for the listed patterns; an MD5 of the pattern says whether it is listed, on which list,
and on which days it is added, removed and added again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

START = "2024-01-01"
DAYS = 730
_HOST = r"^[a-z]+://([^/?#]+)"
_SEGMENT = r"^[a-z]+://([^/?#]+/[^/?#]+)"
_WHOLE = r"^[a-z]+://([^#]*?)/?(?:#.*)?$"


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched) of every page."""
    day = F.date_add(F.to_date(F.lit(START)), (F.col("page_id") * 37 % DAYS).cast("int"))
    return pages.select("page_id", "url", day.cast("timestamp").alias("fetched"))


def entries(pages: DataFrame) -> DataFrame:
    """(list, kind, pattern, action, time) of the derived lists."""
    url = F.col("url")
    host = F.regexp_extract(url, _HOST, 1)
    values = {
        "host": host,
        "domain": F.regexp_replace(host, r"^[^.]*\.", ""),
        "prefix": F.regexp_extract(url, _SEGMENT, 1),
        "url": F.regexp_extract(url, _WHOLE, 1),
    }
    named = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("pattern")) for k, v in values.items()])
    listed = pages.select(F.inline(named)).filter("pattern <> ''").distinct()
    h = F.conv(F.substring(F.md5(F.concat("kind", F.lit(" "), F.col("pattern"))), 1, 8), 16, 10).cast("long")
    listed = listed.withColumn("h", h).filter((F.col("kind") != "url") | (F.col("h") % 8 == 0))
    first = F.floor(F.col("h") / 8) % DAYS
    gone = first + 20 + F.floor(F.col("h") / 1000) % 300

    def event(action: str, day: Column, when: Column) -> Column:
        return F.when(when, F.struct(F.lit(action).alias("action"), day.cast("int").alias("day")))

    every = F.array(
        event("add", first, F.lit(True)),
        event("remove", gone, F.col("h") % 3 > 0),
        event("add", gone + 25, F.col("h") % 5 == 0),
        event("add", first + 3, F.col("h") % 7 == 0),
    )
    dated = listed.withColumn("e", F.explode(F.filter(every, lambda e: e.isNotNull())))
    on = F.when(F.col("h") % 4 == 1, "allow").otherwise("block")
    time = F.date_add(F.to_date(F.lit(START)), F.col("e.day")).cast("timestamp")
    return dated.select(on.alias("list"), "kind", "pattern", "e.action", time.alias("time"))


#: The rows of the query in DuckDB: intervals from changes of state, matched by kind.
ORACLE_SQL = f"""
WITH cap AS (SELECT page_id, url, CAST(DATE '{START}' + CAST(page_id * 37 % {DAYS} AS INTEGER) AS TIMESTAMP) AS fetched,
   regexp_extract(url, '{_HOST}', 1) AS host, regexp_extract(url, '{_SEGMENT}', 1) AS seg, regexp_extract(url, '{_WHOLE}', 1) AS whole FROM pages),
 names AS (SELECT DISTINCT kind, pattern FROM (
   SELECT 'host' AS kind, host AS pattern FROM cap UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]*\\.', '') FROM cap
   UNION ALL SELECT 'prefix', seg FROM cap UNION ALL SELECT 'url', whole FROM cap) WHERE pattern <> ''),
 listed AS (SELECT *, CAST('0x' || substr(md5(kind || ' ' || pattern), 1, 8) AS BIGINT) AS h FROM names),
 dated AS (SELECT *, h // 8 % {DAYS} AS day, h // 8 % {DAYS} + 20 + h // 1000 % 300 AS gone FROM listed WHERE kind <> 'url' OR h % 8 = 0),
 events AS (SELECT kind, pattern, CASE WHEN h % 4 = 1 THEN 'allow' ELSE 'block' END AS list, d, bool_or(adds) AS adds FROM (
   SELECT *, day AS d, true AS adds FROM dated UNION ALL SELECT *, gone, false FROM dated WHERE h % 3 > 0
   UNION ALL SELECT *, gone + 25, true FROM dated WHERE h % 5 = 0 UNION ALL SELECT *, day + 3, true FROM dated WHERE h % 7 = 0) GROUP BY ALL),
 changes AS (SELECT * FROM (SELECT *, coalesce(lag(adds) OVER w, false) AS was FROM events WINDOW w AS (PARTITION BY kind, pattern ORDER BY d)) WHERE adds <> was),
 spans AS (SELECT list, kind, pattern, CAST(DATE '{START}' + CAST(d AS INTEGER) AS TIMESTAMP) AS since, CAST(DATE '{START}' + CAST(until AS INTEGER) AS TIMESTAMP) AS until
   FROM (SELECT *, lead(d) OVER (PARTITION BY kind, pattern ORDER BY d) AS until FROM changes) WHERE adds),
 hits AS (SELECT c.page_id, s.* FROM cap c JOIN spans s ON s.since <= c.fetched AND (s.until IS NULL OR c.fetched < s.until) AND (
   s.kind = 'host' AND s.pattern = c.host OR s.kind = 'domain' AND (s.pattern = c.host OR suffix(c.host, '.' || s.pattern))
   OR s.kind = 'prefix' AND s.pattern = c.seg OR s.kind = 'url' AND s.pattern = c.whole)),
 best AS (SELECT page_id, count(*) AS n, list, kind, pattern, since FROM (SELECT *, row_number() OVER (PARTITION BY page_id
   ORDER BY list_position(['url', 'prefix', 'host', 'domain'], kind), length(pattern) DESC, list DESC) AS i FROM hits) WHERE i = 1 GROUP BY ALL),
 counts AS (SELECT page_id, count(*) AS n_active FROM hits GROUP BY 1)
SELECT page_id, url, CAST(fetched AS DATE) AS fetched, coalesce(n_active, 0) AS n_active, list, kind, pattern, CAST(since AS DATE) AS since, coalesce(list = 'block', false) AS blocked
FROM cap LEFT JOIN counts USING (page_id) LEFT JOIN best USING (page_id)"""

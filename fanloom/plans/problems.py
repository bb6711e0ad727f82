"""The p-queries of the core: sessions, hot keys, lines that fail to parse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.functions.weblog import host_key, request_minute
from fanloom.operators.hot_keys import hot_keys, weblog_totals
from fanloom.operators.records import loaded, rejected, text_records
from fanloom.operators.sessions import activity, gap_tree, sessions_at, weblog_sessions
from fanloom.session import spread, table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return weblog_sessions(table(spark, d, "web_log_report"), 30).select("host_key", "started", "ended")


def p2_sessions(spark: SparkSession, d: str) -> DataFrame:
    return weblog_sessions(table(spark, d, "web_log_report"), 30)


def p2_settings(spark: SparkSession, d: str) -> DataFrame:
    """Sessions and requests for several settings, all from one set of trees."""
    log = table(spark, d, "web_log_report")
    nodes = gap_tree(activity(log, host_key(F.col("host")), request_minute(F.col("day"), F.col("hour"), F.col("minute")), [F.col("line_no")]))
    each = F.explode(F.array(*[F.lit(m).cast("bigint") for m in (5, 30, 120)])).alias("minutes")
    cut = nodes.select("*", each).where((F.col("gap") <= F.col("minutes")) & (F.col("parent_gap") > F.col("minutes")))
    return cut.groupBy("minutes").agg(F.count("*").alias("n_sessions"), F.sum("events").alias("n_requests"), F.max(F.col("end") - F.col("start")).alias("longest"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return hot_keys(table(spark, d, "web_log_report"), 0.02)


def p3_totals(spark: SparkSession, d: str) -> DataFrame:
    return weblog_totals(table(spark, d, "web_log_report")).select("field", "item", "requests", "bytes")


def _raw_log(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "raw_log").select("line_id", "value"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rejected(_raw_log(spark, d), ids=["line_id"]).select("line_id", "reason")


def p6_loaded(spark: SparkSession, d: str) -> DataFrame:
    return loaded(_raw_log(spark, d), ids=["line_id"]).select("line_id", "host", "method", "url", "status", "bytes")


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The bad lines again, found in texts put together from the lines of each file, in which broken quotes run on."""
    lines = table(spark, d, "raw_log").select("file_name", "line_id", "value").distinct()
    return text_records(lines, "file_name", "line_id").where("reason IS NOT NULL").select(F.col("line_no").alias("line_id"), "reason")


QUERIES = {f.__name__: f for f in (p2_found, p2_sessions, p2_settings, p3_found, p3_totals, p6_found, p6_loaded, p6_texts)}

_HOST = "lower(regexp_replace(trim(host, ' ' || chr(9)), '\\.$', ''))"
_URL = "regexp_extract(url, '^[^?#]*')"
_MINUTES = f"""
 ticks AS (SELECT {_HOST} AS h, (day - DATE '1970-01-01') * 1440 + hour * 60 + minute AS t, count(DISTINCT line_no) AS c
  FROM web_log_report WHERE hour BETWEEN 0 AND 23 AND minute BETWEEN 0 AND 59 AND day IS NOT NULL AND {_HOST} NOT IN ('', '-') GROUP BY 1, 2)"""
_SESSIONS = f"""
WITH {_MINUTES},
 marked AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY h ORDER BY t) <= 30 THEN 0 ELSE 1 END AS new FROM ticks),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY h ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM marked),
 found AS (SELECT h AS host_key, strftime(make_timestamp(min(t) * 60000000), '%Y-%m-%d %H:%M') AS started,
  strftime(make_timestamp(max(t) * 60000000), '%Y-%m-%d %H:%M') AS ended, max(t) - min(t) AS duration, sum(c)::BIGINT AS requests
  FROM numbered GROUP BY h, k)"""
_TOTALS = f"""
WITH requests AS (SELECT line_no, any_value({_HOST}) AS host, any_value({_URL}) AS url, max(CASE WHEN bytes >= 0 THEN bytes ELSE 0 END) AS bytes FROM web_log_report GROUP BY line_no),
 keys AS (SELECT 'host' AS field, host AS item, bytes FROM requests WHERE host NOT IN ('', '-')
  UNION ALL SELECT 'url', url, bytes FROM requests WHERE url LIKE '/%'),
 totals AS (SELECT field, item, count(*) AS requests, sum(bytes)::BIGINT AS bytes FROM keys GROUP BY field, item)"""
LINES_SQL = r"""
WITH lines AS (SELECT line_id, any_value(rtrim(value, chr(13))) AS s FROM raw_log GROUP BY line_id),
 q AS (SELECT *, regexp_replace(regexp_replace(coalesce(s, ''), '\\\\', 'xx', 'g'), '\\"', 'xx', 'g') AS u FROM lines),
 n AS (SELECT *, length(u) - length(replace(u, '"', '')) AS quotes FROM q),
 f AS (SELECT *, regexp_extract_all(u, '\[[^\]]*\]|"[^"]*"|[^ \t]+') AS fields,
  regexp_extract_all(regexp_replace(coalesce(s, ''), '\\\\', chr(1) || chr(1), 'g'), '\[[^\]]*\]|"(?:[^"\\]|\\.)*"|[^ \t]+') AS parts FROM n),
 p AS (SELECT *, parts[1] AS host, list_filter(string_split(regexp_replace(regexp_replace(parts[5], '^"', ''), '"$', ''), ' '), lambda x: x <> '') AS request, parts[7] AS size FROM f),
 judged AS (SELECT line_id, parts, host, request, size, parts[6] AS status, CASE
  WHEN quotes <> 0 AND NOT (quotes = 2 AND regexp_matches(u, '^[^"]*[ \t]"[^"]*"([ \t]|$)')) THEN 'quoting'
  WHEN len(fields) <> 7 OR regexp_matches(u, '^[ \t]') THEN 'columns'
  WHEN NOT coalesce(CASE WHEN regexp_full_match(host, '[0-9.]+')
     THEN regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|0[0-9]|00[0-9]|0[0-9][0-9])\.){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|0[0-9]|0[0-9][0-9])\.?')
     ELSE host <> '-' AND (regexp_full_match(host, '[A-Za-z0-9_-]+(\.[A-Za-z0-9_-]+)*\.?') OR regexp_full_match(host, '[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*')) END, false) THEN 'host'
  WHEN len(request) NOT IN (2, 3) OR NOT regexp_full_match(request[2], '(/|http://)([!-$&-~]|%[0-9A-Fa-f]{2})*') THEN 'url'
  WHEN NOT (size = '-' OR (regexp_full_match(size, '[0-9]+') AND TRY_CAST(size AS BIGINT) IS NOT NULL)) THEN 'bytes' END AS reason FROM p)"""

ORACLE = {
    "p2_found": f"{_SESSIONS} SELECT host_key, started, ended FROM found",
    "p2_sessions": f"{_SESSIONS} SELECT * FROM found",
    "p2_settings": f"""
WITH {_MINUTES}, settings AS (SELECT unnest([5, 30, 120])::BIGINT AS minutes),
 marked AS (SELECT h, t, c, minutes, CASE WHEN t - lag(t) OVER (PARTITION BY h, minutes ORDER BY t) <= minutes THEN 0 ELSE 1 END AS new FROM ticks, settings),
 numbered AS (SELECT *, sum(new) OVER (PARTITION BY h, minutes ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM marked),
 found AS (SELECT minutes, sum(c) AS c, max(t) - min(t) AS duration FROM numbered GROUP BY minutes, h, k)
SELECT minutes, count(*) AS n_sessions, sum(c)::BIGINT AS n_requests, max(duration) AS longest FROM found GROUP BY minutes""",
    "p3_found": f"{_TOTALS}, sums AS (SELECT field, sum(requests) AS n FROM totals GROUP BY field) SELECT field, item FROM totals JOIN sums USING (field) WHERE requests >= 0.02 * n",
    "p3_totals": f"{_TOTALS} SELECT * FROM totals",
    "p6_found": f"{LINES_SQL} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_texts": f"{LINES_SQL} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_loaded": rf"{LINES_SQL} SELECT line_id, host, request[1] AS method, replace(request[2], chr(1) || chr(1), '\\') AS url, TRY_CAST(status AS BIGINT) AS status, TRY_CAST(size AS BIGINT) AS bytes FROM judged WHERE reason IS NULL",
}

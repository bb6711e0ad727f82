"""The web-log report: every section over the parsed log, with requests counted once per line number.

The log is first reduced to one row per line_no. Each section is one aggregation; the summary's figures all come from
totals per distinct key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.functions.scalar import parent_domain, top_level, week_day
from fanloom.operators.hot_keys import totals_by_key
from fanloom.operators.ordered import run_lengths, top_k, top_k_sum
from fanloom.session import table


def requests(spark: SparkSession, d: str) -> DataFrame:
    """One row per request: the largest byte count among its deliveries; all else is the same in each of them."""
    log = table(spark, d, "web_log_report")
    return log.groupBy("line_no", "host", "url", "day", "hour").agg(F.max(F.coalesce(F.greatest("bytes", F.lit(0)), F.lit(0))).alias("bytes"))


def _host_is_name():
    return ~top_level(F.col("host")).rlike("^[0-9]")


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """All figures from one pass over the requests and one over their distinct hosts, pages and days.

    Counting five columns' distinct values side by side would expand every request five times up to the shuffle; here
    requests are reduced to totals per host, page and day first, and domains are derived from the distinct hosts.
    """
    keyed = requests(spark, d).select("host", "url", F.coalesce(F.col("day").cast("string"), F.lit("")).alias("day"), "bytes")
    by_key = totals_by_key(keyed, ["host", "url", "day"], ["bytes"])
    host = F.col("field") == "host"
    name = ~top_level(F.col("item")).rlike("^[0-9]")
    derived = F.array(
        F.struct(F.col("field").alias("kind"), F.col("item").alias("value")),
        F.when(host & name, F.struct(F.lit("domain").alias("kind"), parent_domain(F.col("item")).alias("value"))),
        F.when(host & ~top_level(F.col("item")).rlike("[0-9]"), F.struct(F.lit("top").alias("kind"), top_level(F.col("item")).alias("value"))),
    )
    values = by_key.select(F.explode(derived).alias("k"), "requests", "bytes").where("k IS NOT NULL").groupBy("k.kind", "k.value").agg(F.sum("requests").alias("requests"), F.sum("bytes").alias("bytes"))
    n = lambda kind: F.count_if(F.col("kind") == kind)
    of_days = lambda c: F.sum(F.when(F.col("kind") == "day", F.col(c)))
    days = F.count_if((F.col("kind") == "day") & (F.col("value") != ""))
    one = values.agg(of_days("requests").alias("accesses"), of_days("bytes").alias("transferred"), n("host").alias("hosts"), n("domain").alias("domains"), n("top").alias("top_level_domains"), n("url").alias("pages"), days.alias("days"))
    return one.select(
        "accesses",
        F.round(F.col("transferred") / 2**30, 6).alias("gbytes"),
        "hosts",
        "domains",
        "top_level_domains",
        "pages",
        F.round(F.col("accesses") / F.col("days"), 6).alias("accesses_per_day"),
        F.round(F.col("transferred") / F.col("days") / 2**20, 6).alias("mbytes_per_day"),
    )


def report_top_hosts(spark: SparkSession, d: str) -> DataFrame:
    return top_k(requests(spark, d).where("host IS NOT NULL"), F.col("host"), 10)


def report_top_level_domains(spark: SparkSession, d: str) -> DataFrame:
    return top_k(requests(spark, d).where(_host_is_name()), top_level(F.col("host")), 20)


def report_top_domains(spark: SparkSession, d: str) -> DataFrame:
    return top_k(requests(spark, d).where(_host_is_name()), parent_domain(F.col("host")), 10)


def report_hosts_by_transfer(spark: SparkSession, d: str) -> DataFrame:
    return top_k_sum(requests(spark, d).where("host IS NOT NULL"), F.col("host"), F.col("bytes"), 10)


def report_top_areas(spark: SparkSession, d: str) -> DataFrame:
    """Grouped by area, not by runs of a sorted list, in which one area can come apart."""
    return top_k(requests(spark, d).where("url IS NOT NULL"), F.coalesce(F.try_element_at(F.split("url", "/"), F.lit(2)), F.lit("")), 20)


def report_top_requests(spark: SparkSession, d: str) -> DataFrame:
    return top_k(requests(spark, d).where("url IS NOT NULL"), F.col("url"), 20)


def report_by_date(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy("day").agg(F.count("*").alias("count"))


def report_date_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of equal dates in the order of the lines, null a value like any other."""
    return run_lengths(requests(spark, d), "line_no", "day").select("run", "day", "length")


def report_by_week_day(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).where("day IS NOT NULL").groupBy(week_day(F.col("day")).alias("week_day")).agg(F.count("*").alias("count"))


def report_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).groupBy("hour").agg(F.count("*").alias("count"))


QUERIES = {f.__name__: f for f in (report_summary, report_top_hosts, report_top_level_domains, report_top_domains, report_hosts_by_transfer, report_top_areas, report_top_requests, report_by_date, report_date_runs, report_by_week_day, report_by_hour)}

_WITH = "WITH requests AS (SELECT line_no, any_value(host) AS host, any_value(url) AS url, any_value(day) AS day, any_value(hour) AS hour, max(CASE WHEN bytes > 0 THEN bytes ELSE 0 END) AS bytes FROM web_log_report GROUP BY line_no)"
_LAST = "list_extract(string_split(host, '.'), -1)"
_PARENT = "CASE WHEN contains(host, '.') THEN regexp_replace(host, '^[^.]*', '') ELSE '' END"


def _top(item: str, where: str, k: int) -> str:
    return f"{_WITH} SELECT {item} AS item, count(*) AS count FROM requests WHERE {where} GROUP BY 1 ORDER BY count DESC, item DESC LIMIT {k}"


ORACLE = {
    "report_summary": f"""{_WITH} SELECT count(*) AS accesses, round(sum(bytes) / 1073741824, 6) AS gbytes, count(DISTINCT host) AS hosts,
 count(DISTINCT CASE WHEN NOT regexp_matches({_LAST}, '^[0-9]') THEN {_PARENT} END) AS domains,
 count(DISTINCT CASE WHEN NOT regexp_matches({_LAST}, '[0-9]') THEN {_LAST} END) AS top_level_domains, count(DISTINCT url) AS pages,
 round(count(*) / count(DISTINCT day), 6) AS accesses_per_day, round(sum(bytes) / count(DISTINCT day) / 1048576, 6) AS mbytes_per_day FROM requests""",
    "report_top_hosts": _top("host", "host IS NOT NULL", 10),
    "report_top_level_domains": _top(_LAST, f"NOT regexp_matches({_LAST}, '^[0-9]')", 20),
    "report_top_domains": _top(_PARENT, f"NOT regexp_matches({_LAST}, '^[0-9]')", 10),
    "report_hosts_by_transfer": f"{_WITH} SELECT host AS item, sum(bytes)::BIGINT AS total FROM requests WHERE host IS NOT NULL GROUP BY 1 ORDER BY total DESC, item DESC LIMIT 10",
    "report_top_areas": _top("coalesce(string_split(url, '/')[2], '')", "url IS NOT NULL", 20),
    "report_top_requests": _top("url", "url IS NOT NULL", 20),
    "report_by_date": f"{_WITH} SELECT day, count(*) AS count FROM requests GROUP BY day",
    "report_date_runs": f"""{_WITH}, marked AS (SELECT line_no, day, CASE WHEN row_number() OVER (ORDER BY line_no) > 1 AND lag(day) OVER (ORDER BY line_no) IS NOT DISTINCT FROM day THEN 0 ELSE 1 END AS new FROM requests),
 numbered AS (SELECT day, sum(new) OVER (ORDER BY line_no ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked)
SELECT run, any_value(day) AS day, count(*) AS length FROM numbered GROUP BY run""",
    "report_by_week_day": f"{_WITH} SELECT strftime(day, '%a') AS week_day, count(*) AS count FROM requests WHERE day IS NOT NULL GROUP BY 1",
    "report_by_hour": f"{_WITH} SELECT hour, count(*) AS count FROM requests GROUP BY hour",
}

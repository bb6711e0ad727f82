"""Joins, set operations, projections, order-dependent operators and stored values over the relational tables and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanloom.fuse import fuse_totals
from fanloom.functions import scalar
from fanloom.functions.scalar import transform_stages, transformed
from fanloom.operators import compare, ordered, project, totals
from fanloom.operators.monitor import monitor
from fanloom.session import table
from fanloom.store import Stores, last_record, record_window, time_window
from fanloom.stream import Stream, number_lines
from fanloom.streaming.live import activity_sessions, tumbling


def events_by_user(spark: SparkSession, d: str) -> DataFrame:
    return ordered.top_k(table(spark, d, "events"), F.col("user_id"), 10, "user_id")


def value_by_user(spark: SparkSession, d: str) -> DataFrame:
    return ordered.top_k_sum(table(spark, d, "events"), F.col("user_id"), F.round(F.col("value") * 100).cast("bigint"), 10, "user_id")


def events_by_hour(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(F.hour("ts").alias("hour"), "event_type").agg(F.count("*").alias("n"))


def events_by_week_day(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy(scalar.week_day(F.col("ts")).alias("week_day")).agg(F.count("*").alias("n"))


def join_orders_customers(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return compare.join_fields(table(spark, d, "customer").select("c_custkey", "c_name"), orders, "c_custkey", "o_custkey", "custkey")


def join_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose keys repeat on both sides give every pair."""
    left = table(spark, d, "customer").select("c_nationkey", "c_custkey")
    return compare.join_fields(left, table(spark, d, "supplier").select("s_nationkey", "s_suppkey"), "c_nationkey", "s_nationkey", "nation")


def rows_of_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return compare.keep_repeated(table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"), "l_partkey")


def _nations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return compare.compare_sets(table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")))


def only_left(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d)[0]


def only_right(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d)[1]


def in_both(spark: SparkSession, d: str) -> DataFrame:
    return _nations(spark, d)[2]


def unused_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts that no line uses: one set without another."""
    return compare.compare_sets(table(spark, d, "part").select(F.col("p_partkey").alias("partkey")), table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey")), distinct=True)[0]


def union_of_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


def reorder_columns(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return table(spark, d, "part").select(project.reorder(line, ",", [(4, 5), (2, 2)]).alias("value"))


def cut_ranges(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat_ws(",", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return table(spark, d, "part").select(project.cut(line, ",", [(5, 6), (1, 2)]).alias("value"))


def cut_several_outputs(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "part").select(F.concat_ws(",", "p_partkey", "p_name", "p_brand", "p_type", "p_size").alias("value"))
    first, second = project.cut_streams(lines, "value", ",", [(1, 2), (4, 5)])
    return first.select(F.lit(1).alias("channel"), "value").unionAll(second.select(F.lit(2), "value"))


def fields_and_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Fields of log lines by blanks: the first, the last as a number, and how many."""
    f = project.blank_fields(F.regexp_replace("value", "\r+$", ""))
    return table(spark, d, "raw_log").distinct().select("line_id", project.field(f, 1).alias("first"), project.number(project.field(f, -1)).cast("string").alias("last"), F.size(f).alias("n_fields")).where("line_id IS NOT NULL AND n_fields >= 0")


def paste_channels(spark: SparkSession, d: str) -> DataFrame:
    """Two channels of different length side by side; each has its own line numbers."""
    nations = table(spark, d, "nation").select((F.col("n_nationkey") + 1).cast("bigint").alias("line_no"), F.col("n_name").alias("value"))
    regions = table(spark, d, "region").select((F.col("r_regionkey") + 1).cast("bigint").alias("line_no"), F.col("r_name").alias("value"))
    return compare.paste([regions, nations, regions])


def compare_channels(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.col("o_orderstatus").alias("value"))
    right = left.withColumn("value", F.when(F.col("line_no") % 1000 == 999, "X").otherwise(F.col("value")))
    return compare.first_difference(left, right)


def _order_lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All orders as numbered lines, and the same with every seventh taken out, every eleventh changed and one put in behind every thirteenth."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(" ", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    left = number_lines(orders, ["k"])
    changed = orders.where("k % 7 <> 0").withColumn("value", F.when(F.col("k") % 11 == 0, F.concat("value", F.lit(" changed"))).otherwise(F.col("value")))
    added = orders.where("k % 13 = 0").withColumn("value", F.concat(F.lit("new "), F.col("k").cast("string")))
    right = number_lines(changed.select("k", F.lit(0).alias("i"), "value").unionAll(added.select("k", F.lit(1).alias("i"), "value")), ["k", "i"])
    return left.select("line_no", "value"), right.select("line_no", "value")


def edit_script(spark: SparkSession, d: str) -> DataFrame:
    """What an edit script between two versions of all orders takes out and puts in."""
    script = compare.diff(*_order_lines(spark, d))
    return script.where(F.col("value").rlike("^[<>] ")).select("value")


def patched_orders(spark: SparkSession, d: str) -> DataFrame:
    """The second version, rebuilt from the first and the edit script."""
    left, right = _order_lines(spark, d)
    return compare.patched(left, compare.diff(left, right))


def three_way_difference(spark: SparkSession, d: str) -> DataFrame:
    """The regions where three versions of all orders differ: two that change different lines, and what they come from.

    Every 20th line is taken out of the first, every 20th from the tenth on changed in the third.
    """
    base = number_lines(table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat_ws(" ", "o_orderkey", "o_orderstatus").alias("value")), ["k"])
    mine = number_lines(base.where("line_no % 20 <> 5").select("k", "value"), ["k"])
    yours = base.withColumn("value", F.when(F.col("line_no") % 20 == 10, F.concat("value", F.lit(" changed"))).otherwise(F.col("value")))
    return compare.diff3(*[x.select("line_no", "value") for x in (mine, base, yours)]).select("value")


def edit_scripts_by_file(spark: SparkSession, d: str) -> DataFrame:
    """Edit scripts of every text file against itself with every tenth line taken out: each line of the scripts."""
    text = table(spark, d, "text_lines").select("path", F.col("line_no").alias("k"), "value").distinct()
    dense = lambda df: df.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy("k")).cast("bigint"))
    script = compare.diff_by_group(dense(text), dense(text.where("k % 10 <> 0")), "path")
    return script.groupBy("path").agg(F.count("*").alias("n"), F.count_if(F.col("value").startswith("<")).alias("removed"), F.max("line_no").alias("last"))


def consecutive_distinct(spark: SparkSession, d: str) -> DataFrame:
    return ordered.squeeze(table(spark, d, "events"), "event_id", "event_type", ("user_id",)).select("event_id", "user_id", "event_type")


def run_lengths_all(spark: SparkSession, d: str) -> DataFrame:
    """Runs over the whole stream of events."""
    return ordered.run_lengths(table(spark, d, "events"), "event_id", "event_type")


def running_counters(spark: SparkSession, d: str) -> DataFrame:
    return monitor(table(spark, d, "events"), "event_id", "event_type").select("event_id", "nlines", "nbytes", "data")


def previous_events(spark: SparkSession, d: str) -> DataFrame:
    return ordered.previous(table(spark, d, "events"), "event_id", "event_type", ("user_id",), "before").select("event_id", "before")


def ranges_of_events(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events from a signup to the next error."""
    events = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return ordered.pattern_range(events, "event_id", F.col("event_type") == "signup", F.col("event_type") == "error", ("user_id",))


def last_records(spark: SparkSession, d: str) -> DataFrame:
    return record_window(table(spark, d, "events"), "event_id", 20, 5).select("event_id", "event_type")


def last_days(spark: SparkSession, d: str) -> DataFrame:
    return time_window(table(spark, d, "events"), "ts", 3, 1, "d").select("event_id", "event_type")


def first_records(spark: SparkSession, d: str) -> DataFrame:
    return ordered.head(table(spark, d, "events"), ["event_id"], 7).select("event_id", "event_type").unionAll(ordered.tail(table(spark, d, "events"), ["event_id"], 7).select("event_id", "event_type"))


def stored_ratios(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and value per event through named stores, one of which is read before the other is written."""
    events, stores = table(spark, d, "events"), Stores()
    stores.write("per_day", lambda: spark.range(1).select((stores.value("n") / stores.value("days")).alias("value")))
    stores.write("n", lambda: events.agg(F.count("*").alias("value")))
    stores.write("days", lambda: events.agg(F.count_distinct(F.to_date("ts")).alias("value")))
    stores.write("last", lambda: last_record(Stream(events, ("event_id",)), "event_type"))
    return spark.range(1).select(F.round(stores.value("per_day"), 6).alias("per_day"), stores.value("last", "event_type").alias("last_type"))


def percent_of_total(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    counts = totals.frequencies(orders, F.col("o_orderpriority"), "priority")
    return totals.with_percentage(counts, orders.agg(F.count("*")).scalar()).withColumn("percent", F.round("percent", 6))


def fused_totals(spark: SparkSession, d: str) -> DataFrame:
    """Six independent branches of one input in one pass."""
    one = F.lit(1)
    return fuse_totals(table(spark, d, "lineitem"), {
        "n": (None, one), "returned": (F.col("l_returnflag") == "R", one), "open": (F.col("l_linestatus") == "O", one),
        "cheap": (F.col("l_extendedprice") < 2000, one), "quantity": (None, F.col("l_quantity").cast("bigint")), "large_quantity": (F.col("l_quantity") > 45, F.col("l_quantity").cast("bigint")),
    })


def placed_from_both_sides(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return ordered.two_sided_places(counts, "user_id", "n").select("user_id", "place")


def presence_by_day(spark: SparkSession, d: str) -> DataFrame:
    days = table(spark, d, "events").select(F.to_date("ts").alias("day"), "user_id")
    return totals.presence(days, "day", "user_id")


def numeric_order(spark: SparkSession, d: str) -> DataFrame:
    """All lines of a descending numeric sort of text with their places, ties by the whole line."""
    rows = table(spark, d, "part").select(F.concat(F.col("p_size").cast("string"), F.lit(" "), F.col("p_name")).alias("value"))
    return number_lines(rows, ordered.sort_numeric("value", descending=True)).select("line_no", "value")


def order_from_field(spark: SparkSession, d: str) -> DataFrame:
    """All lines sorted from their second field on, with their places."""
    rows = table(spark, d, "part").select(F.concat_ws(" ", "p_partkey", "p_brand", "p_type").alias("value"))
    return number_lines(rows, ordered.sort_from_field("value", 2)).select("line_no", "value")


def scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat_ws("/", F.lit("data"), "p_brand", "p_name")
    return table(spark, d, "part").select(
        "p_partkey",
        scalar.base_name(path).alias("base"),
        scalar.dir_name(path).alias("folder"),
        scalar.replace_first(F.col("p_name"), "[aeiou]", "#").alias("first_replaced"),
        scalar.ascii_lower(F.col("p_brand")).alias("lowered"),
        scalar.underline(F.col("p_name")).alias("line"),
        F.format_string("%8d", F.col("p_size").cast("bigint")).alias("padded"),
        scalar.whole(F.col("p_retailprice") / -7).alias("whole"),
    )


def host_parts(spark: SparkSession, d: str) -> DataFrame:
    hosts = table(spark, d, "web_log_report").where("host IS NOT NULL").select("host").distinct()
    return hosts.select("host", scalar.top_level(F.col("host")).alias("top"), scalar.parent_domain(F.col("host")).alias("parent"))


def transform_of_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The transform of every vector, with as many channels as it has numbers: (vec_id, k, re, im)."""
    made = table(spark, d, "embeddings").select("vec_id", F.posexplode(transformed(F.col("embedding"))).alias("k", "v"))
    rounded = lambda c: (F.round(c, 4) + 0.0)
    return made.select("vec_id", "k", rounded(F.col("v.re")).alias("re"), rounded(F.col("v.im")).alias("im"))


def transform_of_channels(spark: SparkSession, d: str) -> DataFrame:
    """Eight channels of numbers through a network of butterflies, one projection for each of its stages: the prices of all parts by their number."""
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("key"), *[(F.col("p_retailprice") * ((F.col("p_partkey") + i) % 5)).alias(f"x{i}") for i in range(8)])
    made = transform_stages(parts, ["key"], [f"x{i}" for i in range(8)])
    return made.select("key", *[(F.round(f"{c}{k}", 3) + 0.0).alias(f"{c}{k}") for k in range(8) for c in ("re", "im")])


def tumbling_hours(spark: SparkSession, d: str) -> DataFrame:
    out = tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["event_type"], {"cents": F.round(F.col("value") * 100).cast("bigint")})
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n", "cents")


def sliding_hours(spark: SparkSession, d: str) -> DataFrame:
    out = tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", [], {}, slide="2 hours")
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "n")


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = activity_sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "2 hours", ["user_id"])
    return out.select("user_id", F.unix_micros("started").alias("started"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        events_by_user, value_by_user, events_by_hour, events_by_week_day, join_orders_customers, join_repeated_keys, rows_of_repeated_keys, only_left, only_right, in_both, unused_parts, union_of_keys,
        reorder_columns, cut_ranges, cut_several_outputs, fields_and_numbers, paste_channels, compare_channels, edit_script, patched_orders, three_way_difference, edit_scripts_by_file, consecutive_distinct, run_lengths_all,
        running_counters, previous_events, ranges_of_events, last_records, last_days, first_records, stored_ratios, percent_of_total, fused_totals, placed_from_both_sides, presence_by_day, numeric_order, order_from_field,
        scalar_functions, host_parts, transform_of_vectors, transform_of_channels, tumbling_hours, sliding_hours, event_sessions,
    )
}

_PART = "concat_ws(',', p_partkey, p_name, p_brand, p_type, p_size)"
_NATIONS = "SELECT c_nationkey AS nation FROM customer"
_SUPPLIERS = "SELECT s_nationkey AS nation FROM supplier"
_VERSIONS = """WITH base AS (SELECT o_orderkey AS k, concat_ws(' ', o_orderkey, o_custkey, o_orderstatus) AS value FROM orders),
 second AS (SELECT k, 0 AS i, CASE WHEN k % 11 = 0 THEN value || ' changed' ELSE value END AS value FROM base WHERE k % 7 <> 0 UNION ALL SELECT k, 1, 'new ' || k FROM base WHERE k % 13 = 0)"""


def _transform_sql() -> str:
    columns = []
    for k in range(8):
        for name, f in (("re", "cos"), ("im", "sin")):
            terms = " + ".join(f"p_retailprice * ((p_partkey + {i}) % 5) * {f}(2 * pi() * {i * k % 8} / 8)" for i in range(8))
            columns.append(f"round({terms}, 3) + 0.0 AS {name}{k}")
    return f"SELECT p_partkey AS key, {', '.join(columns)} FROM part"


ORACLE = {
    "events_by_user": "SELECT user_id, count(*) AS count FROM events GROUP BY user_id ORDER BY count DESC, user_id DESC LIMIT 10",
    "value_by_user": "SELECT user_id, sum(round(value * 100)::BIGINT)::BIGINT AS total FROM events GROUP BY user_id ORDER BY total DESC, user_id DESC LIMIT 10",
    "events_by_hour": "SELECT hour(ts)::INTEGER AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "events_by_week_day": "SELECT strftime(ts, '%a') AS week_day, count(*) AS n FROM events GROUP BY 1",
    "join_orders_customers": "SELECT c_custkey AS custkey, c_name, o_orderkey, o_orderstatus FROM customer JOIN orders ON c_custkey = o_custkey",
    "join_repeated_keys": "SELECT c_nationkey AS nation, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "rows_of_repeated_keys": "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)",
    "only_left": f"{_NATIONS} EXCEPT ALL {_SUPPLIERS}",
    "only_right": f"{_SUPPLIERS} EXCEPT ALL {_NATIONS}",
    "in_both": f"{_NATIONS} INTERSECT ALL {_SUPPLIERS}",
    "unused_parts": "SELECT p_partkey AS partkey FROM part EXCEPT SELECT l_partkey FROM lineitem",
    "union_of_keys": f"{_NATIONS} UNION {_SUPPLIERS}",
    "reorder_columns": "SELECT concat_ws(',', p_type, p_size, p_name) AS value FROM part",
    "cut_ranges": "SELECT concat_ws(',', p_partkey, p_name, p_size) AS value FROM part",
    "cut_several_outputs": "SELECT 1 AS channel, concat_ws(',', p_partkey, p_name) AS value FROM part UNION ALL SELECT 2, concat_ws(',', p_type, p_size) FROM part",
    "fields_and_numbers": """WITH f AS (SELECT DISTINCT line_id, file_name, value, list_filter(string_split_regex(regexp_replace(value, '\\r+$', ''), '[ \\t]+'), lambda x: x <> '') AS f FROM raw_log)
SELECT line_id, coalesce(f[1], '') AS first, coalesce(TRY_CAST(regexp_extract(f[-1], '^[+-]?[0-9]+') AS HUGEINT), 0)::VARCHAR AS last, len(f)::INTEGER AS n_fields FROM f WHERE line_id IS NOT NULL AND f IS NOT NULL""",
    "paste_channels": "SELECT (n_nationkey + 1)::BIGINT AS line_no, concat_ws(chr(9), coalesce(r_name, ''), n_name, coalesce(r_name, '')) AS value FROM nation LEFT JOIN region ON n_nationkey = r_regionkey",
    "compare_channels": "SELECT count(*) FILTER (WHERE o_orderkey % 1000 = 999) = 0 AS identical, min(o_orderkey) FILTER (WHERE o_orderkey % 1000 = 999) AS line_no FROM orders",
    "edit_script": f"{_VERSIONS} SELECT '< ' || value AS value FROM base WHERE k % 7 = 0 OR k % 11 = 0 UNION ALL SELECT '> ' || value FROM second WHERE k % 11 = 0 AND i = 0 OR i = 1",
    "patched_orders": f"{_VERSIONS} SELECT row_number() OVER (ORDER BY k, i) AS line_no, value FROM second",
    "three_way_difference": """WITH base AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS n, concat_ws(' ', o_orderkey, o_orderstatus) AS v FROM orders),
 out AS (SELECT n, n - 1 - (n - 1 + 14) // 20 AS m, v FROM base WHERE n % 20 = 5), chg AS (SELECT n, n - (n + 14) // 20 AS m, v FROM base WHERE n % 20 = 10)
SELECT unnest(['====1', '1:' || m || 'a', '2:' || n || 'c', '3:' || n || 'c', '  ' || v]) AS value FROM out
UNION ALL SELECT unnest(['====3', '1:' || m || 'c', '2:' || n || 'c', '  ' || v, '3:' || n || 'c', '  ' || v || ' changed']) FROM chg""",
    "edit_scripts_by_file": """WITH t AS (SELECT DISTINCT path, line_no, value FROM text_lines), r AS (SELECT path, count(*) FILTER (WHERE line_no % 10 = 0) AS removed FROM t GROUP BY path)
SELECT path, 2 * removed AS n, removed, 2 * removed AS last FROM r WHERE removed > 0""",
    "consecutive_distinct": "SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type",
    "run_lengths_all": """WITH m AS (SELECT event_id, event_type, CASE WHEN lag(event_type) OVER (ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events),
 n AS (SELECT *, sum(new) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM m)
SELECT run, any_value(event_type) AS event_type, count(*) AS length, min(event_id) AS first FROM n GROUP BY run""",
    "running_counters": """SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS nlines,
 coalesce(sum(strlen(coalesce(event_type, '')) + 1) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS nbytes, event_type AS data FROM events""",
    "previous_events": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events",
    "ranges_of_events": """WITH m AS (SELECT event_id, user_id, event_type, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER w AS s,
  max(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))
SELECT event_id, user_id, event_type FROM m WHERE s IS NOT NULL AND (e IS NULL OR s > e)""",
    "last_records": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id DESC) AS r FROM events) WHERE r > 5 AND r <= 20",
    "last_days": "SELECT event_id, event_type FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 3 DAY AND ts <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "first_records": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) AS a, row_number() OVER (ORDER BY event_id DESC) AS z FROM events) WHERE a <= 7 OR z <= 7",
    "stored_ratios": "SELECT round(count(*) / count(DISTINCT ts::DATE), 6) AS per_day, max_by(event_type, event_id) AS last_type FROM events",
    "percent_of_total": "SELECT o_orderpriority AS priority, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders) * 100, 6) AS percent FROM orders GROUP BY 1",
    "fused_totals": """SELECT count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(*) FILTER (WHERE l_linestatus = 'O') AS open,
 count(*) FILTER (WHERE l_extendedprice < 2000) AS cheap, sum(l_quantity::BIGINT)::BIGINT AS quantity, coalesce(sum(l_quantity::BIGINT) FILTER (WHERE l_quantity > 45), 0)::BIGINT AS large_quantity FROM lineitem""",
    "placed_from_both_sides": """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS m FROM c)
SELECT user_id, CASE WHEN r % 2 = 1 THEN (r - 1) // 2 ELSE m - r // 2 END AS place FROM r""",
    "presence_by_day": """WITH p AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events),
 c AS (SELECT unnest(generate_series((SELECT min(day) FROM p), (SELECT max(day) FROM p), INTERVAL 1 DAY))::DATE AS day)
SELECT day, user_id FROM c LEFT JOIN p USING (day)""",
    "numeric_order": "SELECT row_number() OVER (ORDER BY p_size DESC, value DESC) AS line_no, value FROM (SELECT p_size, p_size || ' ' || p_name AS value FROM part)",
    "order_from_field": "SELECT row_number() OVER (ORDER BY key, value) AS line_no, value FROM (SELECT ' ' || p_brand || ' ' || p_type AS key, concat_ws(' ', p_partkey, p_brand, p_type) AS value FROM part)",
    "scalar_functions": """SELECT p_partkey, p_name AS base, 'data/' || p_brand AS folder, regexp_replace(p_name, '[aeiou]', '#') AS first_replaced, lower(p_brand) AS lowered, repeat('-', length(p_name)) AS line,
 lpad(p_size::VARCHAR, 8, ' ') AS padded, trunc(p_retailprice / -7)::BIGINT AS whole FROM part""",
    "host_parts": "SELECT DISTINCT host, list_extract(string_split(host, '.'), -1) AS top, CASE WHEN contains(host, '.') THEN regexp_replace(host, '^[^.]*', '') ELSE '' END AS parent FROM web_log_report WHERE host IS NOT NULL",
    "transform_of_vectors": """WITH x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT vec_id, k::INTEGER AS k, round(sum(x * cos(2 * pi() * ((i * k) % n) / n)), 4) + 0.0 AS re, round(sum(x * sin(2 * pi() * ((i * k) % n) / n)), 4) + 0.0 AS im
FROM x, generate_series(0, (SELECT max(len(embedding)) FROM embeddings) - 1) AS g(k) WHERE k < n GROUP BY vec_id, k""",
    "transform_of_channels": _transform_sql(),
    "tumbling_hours": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1, 2",
    "sliding_hours": """SELECT strftime(time_bucket(INTERVAL 2 HOUR, ts, TIMESTAMP '1970-01-01') - d * INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') AS started, count(*) AS n FROM events, (VALUES (0), (1), (2)) AS o(d) GROUP BY 1""",
    "event_sessions": """WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
 n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS started, count(*) AS n FROM n GROUP BY user_id, k""",
}

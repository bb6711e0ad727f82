"""Sources and sinks by round trips through files, and stored values and windows of running streams.

Files are written below the folder that the cluster names; streams take in what there is and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.operators.records import RECORD
from fanloom.plans.problems import LINES_SQL
from fanloom.plans.programs import bibliography_comparison
from fanloom.plans.text_reports import lines
from fanloom.session import table, work_folder
from fanloom.sources import files
from fanloom.streaming import live


def _written_lines(spark: SparkSession, d: str) -> str:
    """A folder with a file for each path of the text files."""
    folder = work_folder(spark, "lines")
    text = lines(spark, d).where("path IS NOT NULL").select("path", "line_no", F.concat_ws("|", "path", F.coalesce(F.col("line_no").cast("string"), F.lit("")), F.coalesce("value", F.lit(""))).alias("value"))
    files.write_by_file(text, folder, "path", ["line_no", "value"])
    return folder


def file_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of files with their numbers in the file."""
    read = files.read_lines(spark, _written_lines(spark, d), terminator="\n").df
    return read.select(F.substring_index("value", "|", 1).alias("path"), "line_no", "value")


def file_listing(spark: SparkSession, d: str) -> DataFrame:
    """Files below a folder with their sizes."""
    found = files.list_files(spark, _written_lines(spark, d), "*.txt")
    return found.select(F.url_decode(F.regexp_extract("path", "/path=([^/]*)/", 1)).alias("path"), "length")


def compressed_file_words(spark: SparkSession, d: str) -> DataFrame:
    """Lines written compressed, twice, the second time added to the first, and counted when read again."""
    folder, text = work_folder(spark, "gzip"), lines(spark, d).select(F.coalesce("value", F.lit("")).alias("value"))
    files.write_lines(text, folder, compression="gzip")
    files.write_lines(text, folder, append=True, compression="gzip")
    return files.read_lines(spark, folder, terminator="\n").df.groupBy("value").agg(F.count("*").alias("n"))


def terminated_records(spark: SparkSession, d: str) -> DataFrame:
    """Records that end with a character other than a line end."""
    folder = work_folder(spark, "records")
    files.write_lines(table(spark, d, "part").select(F.concat_ws("\n", "p_partkey", "p_name").alias("value")), folder, terminator=";")
    return files.read_lines(spark, folder, terminator=";").df.select("value")


def fixed_width_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of 24 bytes, the last one of each a line end."""
    folder = work_folder(spark, "fixed")
    files.write_lines(table(spark, d, "orders").select(F.format_string("%012d %-10s", "o_orderkey", "o_orderstatus").alias("value")), folder)
    read = files.fixed_width(files.read_files(spark, folder, "*.txt"), 24)
    text = read.select(F.col("value").cast("string").alias("value"))
    return text.select(F.substring("value", 1, 12).cast("bigint").alias("orderkey"), F.rtrim(F.substring("value", 14, 10)).alias("status"), F.length("value").alias("length"))


def log_file_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Lines of log files by the reason why they do not load, null for those that do: read line by line, and as whole texts."""
    folder = work_folder(spark, "log")
    log = table(spark, d, "raw_log").select("file_name", "line_id", "value").distinct().withColumn("value", F.coalesce("value", F.lit("")))
    files.write_by_file(log, folder, "file_name", ["line_id"])
    by_line = files.read_log(spark, folder, terminator="\n").select(F.lit("lines").alias("read_as"), "reason")
    by_text = files.read_log_files(spark, folder, terminator="\n").select(F.lit("texts").alias("read_as"), "reason")
    return by_line.unionAll(by_text).groupBy("read_as", "reason").agg(F.count("*").alias("n"))


def log_file_rows(spark: SparkSession, d: str) -> DataFrame:
    """Typed rows of log files."""
    folder = work_folder(spark, "log")
    files.write_lines(table(spark, d, "raw_log").select("line_id", F.coalesce("value", F.lit("")).alias("value")).distinct(), folder)
    return files.read_log(spark, folder, terminator="\n").where("reason IS NULL").select(*[f.name for f in RECORD.fields[:3]], "method", "url", "status", "bytes")


def xml_rows(spark: SparkSession, d: str) -> DataFrame:
    folder = work_folder(spark, "xml")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.format("xml").option("rootTag", "customers").option("rowTag", "customer").save(folder)
    return files.read_xml_rows(spark, folder, "customer", "c_custkey bigint, c_name string, c_mktsegment string")


def delimited_rows(spark: SparkSession, d: str) -> DataFrame:
    """Fields with quotes, delimiters and nulls, written and read again."""
    folder = work_folder(spark, "delimited")
    rows = table(spark, d, "part").select("p_partkey", F.concat(F.lit('say "'), "p_name", F.lit('", twice')).alias("text"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("size"))
    rows.write.option("nullValue", "\\N").option("escape", '"').csv(folder)
    return files.read_delimited(spark, folder, schema="p_partkey bigint, text string, size int")


def numbers_file(spark: SparkSession, d: str) -> DataFrame:
    """One number per line: those of all vectors, a file for each vector."""
    folder = work_folder(spark, "numbers")
    numbers = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.posexplode("embedding").alias("i", "x"))
    files.write_by_file(numbers.withColumn("value", F.col("x").cast("double").cast("string")), folder, "path", ["i"])
    read = files.read_numbers(spark, folder)
    return read.groupBy("i").agg(F.round(F.sum("x"), 6).alias("total"), F.count("x").alias("n"))


def bibliography(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of records in the lines of a bibliography: documents as records, questions and answers as the kinds."""
    key = F.concat(F.lit('<article mdate="2002-01-03" key="'), "post_type", F.lit("/"), F.col("doc_id").cast("string"), F.lit('">'))
    author = F.when(F.col("author_id").isNotNull(), F.concat(F.lit("<author>"), F.col("author_id").cast("string"), F.lit("</author>")))
    each = F.posexplode(F.array(key, author, F.lit("<title>A title.</title>"), F.lit("<author>of what it cites</author>"), F.lit("</article>"))).alias("i", "value")
    rows = table(spark, d, "documents").where("post_type IS NOT NULL").select("doc_id", each)
    return bibliography_comparison(rows.where("value IS NOT NULL").select((F.col("doc_id") * 8 + F.col("i")).alias("line_no"), "value"), "question/", "answer/")


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream."""
    schema = table(spark, d, "events").schema
    # As a pattern, the path may be a file or a folder of files.
    return spark.readStream.schema(schema).parquet(f"{d}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def _stored(spark: SparkSession, name: str, stream: DataFrame, output: str = "complete", keys: tuple[str, ...] = ()) -> DataFrame:
    """What a store holds when its stream has ended."""
    folder = work_folder(spark, name)
    store = live.LiveStore(folder.rsplit("/", 1)[1].replace("-", "_"), stream, f"{folder}/checkpoint", output, f"{folder}/values", keys, once=True)
    try:
        return store.last()
    finally:
        store.stop()


def streamed_last_value(spark: SparkSession, d: str) -> DataFrame:
    """The last value of a store."""
    return _stored(spark, "last", live.latest(_events(spark, d), "event_id", "event_type"))


def streamed_last_records(spark: SparkSession, d: str) -> DataFrame:
    """For each type of event, the users of its last five records but for the last two."""
    kept = _stored(spark, "records", live.last_records(_events(spark, d), "event_type", "event_id", "user_id", 5, 2), "update", ("event_type",))
    return kept.select("event_type", F.array_join("values", " ").alias("users"))


def streamed_last_span(spark: SparkSession, d: str) -> DataFrame:
    """For each type of event, those of the two days before its last one, but for the last day."""
    kept = _stored(spark, "span", live.last_span(_events(spark, d), "event_type", "ts", "event_id", 2, 1, "d"), "update", ("event_type",))
    return kept.select("event_type", F.size("values").cast("bigint").alias("n"), F.array_join("values", " ").alias("events"))


def streamed_hours(spark: SparkSession, d: str) -> DataFrame:
    """Windows of event time over a stream."""
    out = _stored(spark, "hours", live.tumbling(_events(spark, d), "ts", "6 hours", ["event_type"], {"ids": F.col("event_id")}))
    return out.select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "event_type", "n", "ids")


def streamed_once(spark: SparkSession, d: str) -> DataFrame:
    """Records of a stream that delivers each one twice."""
    both = _events(spark, d).unionAll(_events(spark, d))
    return _stored(spark, "once", live.once_per_id(both.where("ts IS NOT NULL").select("event_id", "ts"), ["event_id"], "ts", "3650 days"), "append").select("event_id")


def observed_counters(spark: SparkSession, d: str) -> DataFrame:
    """Lines and bytes that passed a point of a plan, read from its observation once it has run."""
    text, seen = live.monitored(lines(spark, d).select(F.coalesce("value", F.lit("")).alias("value")), work_folder(spark, "seen").rsplit("/", 1)[1])
    text.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["nlines"], seen.get["nbytes"])], "nlines bigint, nbytes bigint")


QUERIES = {
    f.__name__: f
    for f in (
        file_lines, file_listing, compressed_file_words, terminated_records, fixed_width_records, log_file_reasons, log_file_rows, xml_rows, delimited_rows, numbers_file, bibliography,
        streamed_last_value, streamed_last_records, streamed_last_span, streamed_hours, streamed_once, observed_counters,
    )
}

_FILES = "WITH lines AS (SELECT DISTINCT path, line_no, value FROM text_lines), f AS (SELECT path, line_no, concat_ws('|', path, coalesce(line_no::VARCHAR, ''), coalesce(value, '')) AS value FROM lines WHERE path IS NOT NULL)"
ORACLE = {
    "file_lines": f"{_FILES} SELECT path, row_number() OVER (PARTITION BY path ORDER BY line_no NULLS FIRST, value) AS line_no, value FROM f",
    "file_listing": f"{_FILES} SELECT path, sum(strlen(value) + 1)::BIGINT AS length FROM f GROUP BY path",
    "compressed_file_words": "WITH lines AS (SELECT DISTINCT path, line_no, value FROM text_lines) SELECT coalesce(value, '') AS value, 2 * count(*) AS n FROM lines GROUP BY 1",
    "terminated_records": "SELECT p_partkey || chr(10) || p_name AS value FROM part",
    "fixed_width_records": "SELECT o_orderkey AS orderkey, o_orderstatus AS status, 24 AS length FROM orders",
    "log_file_reasons": f"{LINES_SQL} SELECT r AS read_as, reason, count(*) AS n FROM judged, (VALUES ('lines'), ('texts')) AS v(r) GROUP BY 1, 2",
    "log_file_rows": rf"{LINES_SQL} SELECT host, parts[2] AS ident, parts[3] AS auth_user, request[1] AS method, replace(request[2], chr(1) || chr(1), '\\') AS url, TRY_CAST(status AS BIGINT) AS status, TRY_CAST(size AS BIGINT) AS bytes FROM judged WHERE reason IS NULL",
    "xml_rows": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "delimited_rows": "SELECT p_partkey, 'say \"' || p_name || '\", twice' AS text, CASE WHEN p_size > 25 THEN p_size END AS size FROM part",
    "numbers_file": "WITH x AS (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT i, round(sum(x), 6) AS total, count(x) AS n FROM x GROUP BY i",
    "bibliography": """WITH n AS (SELECT author_id, count(*) FILTER (WHERE post_type = 'question') AS q, count(*) FILTER (WHERE post_type = 'answer') AS a FROM documents WHERE author_id IS NOT NULL GROUP BY 1)
SELECT (SELECT count(*) FROM documents WHERE post_type = 'question') AS first_records, (SELECT count(*) FROM documents WHERE post_type = 'answer') AS second_records,
 sum(greatest(q - a, 0))::BIGINT AS only_first, sum(greatest(a - q, 0))::BIGINT AS only_second, sum(least(a, q))::BIGINT AS both FROM n""",
    "streamed_last_value": "SELECT max_by(event_type, event_id) AS event_type FROM events",
    "streamed_last_records": """WITH r AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, string_agg(user_id::VARCHAR, ' ' ORDER BY event_id) AS users FROM r WHERE r BETWEEN 3 AND 5 AND n >= 5 GROUP BY event_type""",
    "streamed_last_span": """WITH m AS (SELECT event_type, ts, event_id::VARCHAR AS e, max(ts) OVER (PARTITION BY event_type) AS last FROM events WHERE ts IS NOT NULL)
SELECT event_type, count(*) AS n, string_agg(e, ' ' ORDER BY ts, e) AS events FROM m WHERE ts > last - INTERVAL 2 DAY AND ts <= last - INTERVAL 1 DAY GROUP BY event_type""",
    "streamed_hours": "SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS started, event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1, 2",
    "streamed_once": "SELECT event_id FROM events WHERE ts IS NOT NULL",
    "observed_counters": "SELECT count(*) AS nlines, sum(strlen(coalesce(value, '')) + 1)::BIGINT AS nbytes FROM (SELECT DISTINCT path, line_no, value FROM text_lines)",
}

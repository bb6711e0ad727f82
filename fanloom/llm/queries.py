"""The p-queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanloom.functions.weblog import area, host_key, url_key
from fanloom.llm import bpe, distinct, frequency, heavy, mixture, pieces
from fanloom.operators.hot_keys import distinct_records
from fanloom.session import spread, table


def _frequencies(spark: SparkSession, d: str) -> DataFrame:
    words = frequency.line_words(table(spark, d, "text_lines")).withColumn("field", F.lit("value"))
    keys = frequency.merged_keys(table(spark, d, "merge_sum")).withColumn("field", F.lit("key"))
    return words.unionByName(keys)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p1_frequencies(spark: SparkSession, d: str) -> DataFrame:
    return _frequencies(spark, d).select("field", "term", "occurrences", "records", "mark")


def _items(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "web_log_report")
    return distinct_records(log, [F.col("line_no")], {"host": host_key(F.col("host")), "url": url_key(F.col("url"))})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's candidates, and items it could hide, counted exactly."""
    return heavy.frequent_exactly(_items(spark, d), ["host", "url"], 0.003).select("field", "item")


def p4_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The sketch's own answer: candidates with their bounds."""
    return heavy.frequent(_items(spark, d), ["host", "url"], 0.003)


def _host_counts(spark: SparkSession, d: str) -> DataFrame:
    key = url_key(F.col("url"))
    log = table(spark, d, "web_log_report").where(F.col("day").isNotNull() & key.isNotNull())
    return distinct.distinct_counts(log, host_key(F.col("host")), {"day": F.col("day"), "area": area(key)}, [("day",), ("area",), ("day", "area")])


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days and areas; the few rows of a day, one per area, meet its total in a window."""
    counts = _host_counts(spark, d).where(F.col("in_set") != 1)
    total = F.max(F.when(F.col("in_set") == 0, F.col("n"))).over(Window.partitionBy("day"))
    return counts.withColumn("total", total).where((F.col("in_set") == 2) & (F.col("n") >= F.col("total") * 0.4)).select(F.col("day").cast("string").alias("day"), "area")


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return _host_counts(spark, d).select(F.col("day").cast("string").alias("day"), "area", "in_set", "n")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "source", "text"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", bpe.encode(F.col("text")).alias("ids"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what the ids of every document decode to, which is that of its text."""
    back = bpe.decode(bpe.encode(F.col("text")))
    return _documents(spark, d).select("doc_id", F.md5(back.cast("binary")).alias("digest"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.rates(mixture.measured(_documents(spark, d)), table(spark, d, "mix_targets")).where("falls_short").select("source")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Targets and what the mixture really reaches; the documents are tokenised once."""
    docs = mixture.kept(mixture.measured(_documents(spark, d)))
    return mixture.reached(docs, mixture.rates(docs, table(spark, d, "mix_targets")))


def p8_reached(spark: SparkSession, d: str) -> DataFrame:
    """Whether each source holds the tokens wanted of it: all its uses if it falls short, else what was wanted up to six standard deviations of the draw."""
    docs = mixture.kept(mixture.measured(_documents(spark, d)))
    plan = mixture.rates(docs, table(spark, d, "mix_targets"))
    part = F.col("rate") - F.floor("rate")
    spread = F.sqrt(F.sum(F.col("tokens").cast("double") * F.col("tokens") * part * (1 - part)))
    drawn = docs.select("source", "tokens").join(plan.select("source", "rate"), "source").groupBy("source").agg(spread.alias("spread"))
    held = mixture.reached(docs, plan).join(drawn, "source", "left")
    short = F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats")
    enough = F.abs(F.col("mixed_tokens") - F.col("wanted")) <= 6 * F.coalesce("spread", F.lit(0.0)) + 1e-6 * F.col("wanted")
    return held.select("source", F.when(F.col("falls_short"), short).otherwise(enough).alias("reached"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, one row per use; they are tokenised once."""
    docs = mixture.kept(mixture.measured(_documents(spark, d)))
    return mixture.mixture(docs, mixture.rates(docs, table(spark, d, "mix_targets")))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    cut = pieces.split_documents(_documents(spark, d), 1024, 64, with_text=False)
    return cut.where((F.col("pieces") > 1) & (F.col("piece") == 0)).select("doc_id")


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_documents(_documents(spark, d), 1024, 64)


def p9_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """A digest of what the pieces of every document put together to, each without what it repeats, which is that of its text."""
    cut = p9_pieces(spark, d)
    placed = F.array_sort(F.collect_list(F.struct("piece", "char_start", "char_end", "text")))
    rest = F.transform("parts", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.element_at("parts", i)["char_end"] - x["char_start"] + 1, F.length(x["text"]))))
    rebuilt = cut.groupBy("doc_id").agg(placed.alias("parts")).select("doc_id", F.array_join(rest, "").alias("text"))
    return rebuilt.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {f.__name__: f for f in (p1_found, p1_frequencies, p4_found, p4_bounds, p5_found, p5_counts, p7_ids, p7_round_trip, p8_found, p8_shares, p8_reached, p8_mixture, p9_found, p9_pieces, p9_rebuilt)}

_HOST = "lower(regexp_replace(trim(host, ' ' || chr(9)), '\\.$', ''))"
_URL = "regexp_extract(url, '^[^?#]*')"
_MARKED = """
WITH lines AS (SELECT path, line_no, any_value(value) AS value FROM text_lines GROUP BY path, line_no),
 words AS (SELECT path, line_no, unnest(string_split_regex(value, '[ \\t\\n\\r\\f]+')) AS term FROM lines),
 per_word AS (SELECT term, count(*) AS occurrences, count(DISTINCT (path, line_no)) AS records FROM words WHERE term <> '' GROUP BY term),
 parts AS (SELECT channel, seq, any_value(value) AS value, any_value(trim(key, ' ' || chr(9) || chr(13))) AS term FROM merge_sum GROUP BY channel, seq),
 per_key AS (SELECT term, sum(value)::BIGINT AS occurrences, count(DISTINCT channel) AS records FROM parts WHERE term <> '' AND value >= 1 GROUP BY term),
 found AS (SELECT 'value' AS field, *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * (SELECT count(*) FROM lines) THEN 'common' END AS mark FROM per_word
  UNION ALL SELECT 'key', *, CASE WHEN occurrences <= 2 THEN 'rare' WHEN records > 0.6 * (SELECT count(DISTINCT channel) FROM merge_sum) THEN 'common' END FROM per_key)"""
_COUNTS = f"""
WITH hosts AS (SELECT DISTINCT {_HOST} AS host, strftime(day, '%Y-%m-%d') AS day, split_part({_URL}, '/', 2) AS area FROM web_log_report
  WHERE day IS NOT NULL AND {_URL} LIKE '/%' AND {_HOST} NOT IN ('', '-'))"""

ORACLE = {
    "p1_found": f"{_MARKED} SELECT field, term, mark FROM found WHERE mark IS NOT NULL",
    "p1_frequencies": f"{_MARKED} SELECT field, term, occurrences, records, mark FROM found",
    "p4_found": f"""
WITH requests AS (SELECT line_no, any_value({_HOST}) AS host, any_value({_URL}) AS url FROM web_log_report GROUP BY line_no),
 keys AS (SELECT 'host' AS field, host AS item FROM requests WHERE host NOT IN ('', '-') UNION ALL SELECT 'url', url FROM requests WHERE url LIKE '/%'),
 totals AS (SELECT field, item, count(*) AS c FROM keys GROUP BY field, item), sums AS (SELECT field, sum(c) AS n FROM totals GROUP BY field)
SELECT field, item FROM totals JOIN sums USING (field) WHERE c >= 0.003 * n""",
    "p7_round_trip": "SELECT doc_id, md5(coalesce(text, '')) AS digest FROM documents",
    "p8_reached": "SELECT DISTINCT source, true AS reached FROM mix_targets",
    "p9_rebuilt": "SELECT doc_id, md5(text) AS digest FROM documents WHERE text <> ''",
    "p5_found": f"""{_COUNTS}, cells AS (SELECT day, area, count(DISTINCT host) AS n FROM hosts GROUP BY day, area),
 days AS (SELECT day, count(DISTINCT host) AS total FROM hosts GROUP BY day)
SELECT day, area FROM cells JOIN days USING (day) WHERE n >= 0.4 * total""",
    "p5_counts": f"""{_COUNTS} SELECT day, NULL::VARCHAR AS area, 0 AS in_set, count(DISTINCT host) AS n FROM hosts GROUP BY day
UNION ALL SELECT NULL, area, 1, count(DISTINCT host) FROM hosts GROUP BY area
UNION ALL SELECT day, area, 2, count(DISTINCT host) FROM hosts GROUP BY day, area""",
}

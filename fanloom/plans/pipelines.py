"""Pipelines and graphs written as text, over the lines of the text files and the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.graph import Function, from_text, run_graph
from fanloom.plans.text_reports import lines
from fanloom.session import table
from fanloom.store import Stores
from fanloom.stream import Stream, number_lines
from fanloom.tools import numbered, pipeline, registry


def _text(spark: SparkSession, d: str) -> Stream:
    """All lines of the text files, file by file."""
    return Stream(number_lines(lines(spark, d).select("path", F.col("line_no").alias("n"), F.coalesce("value", F.lit("")).alias("value")), ["path", "n", "value"]).select("line_no", "value"), dense=True)


def _parts(spark: SparkSession, d: str) -> Stream:
    """All parts as lines of fields between blanks."""
    return Stream(table(spark, d, "part").select(F.col("p_partkey").alias("line_no"), F.concat_ws(" ", "p_size", "p_brand", "p_partkey", "p_type").alias("value")))


def _placed(stream: Stream) -> DataFrame:
    """The whole stream with the place of every record."""
    return numbered(stream).df.select("line_no", "value")


def _run(spark: SparkSession, text: str, *inputs: Stream) -> DataFrame:
    return _placed(pipeline(spark, text)(*inputs)[0])


def pipe_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "words | sort | uniq -c | sort -rn", _text(spark, d))


def pipe_words_in_order(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "words", _text(spark, d))


def pipe_word_runs(spark: SparkSession, d: str) -> DataFrame:
    """Words that follow each other and are the same in lower case."""
    return _run(spark, "words | tr A-Z a-z | uniq -c", _text(spark, d))


def pipe_sorted_lines(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "sort", _text(spark, d))


def pipe_sorted_once(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "words | sort -u", _text(spark, d))


def pipe_sorted_by_fields(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "sort -k 2,2 -r", _parts(spark, d))


def pipe_sorted_by_number(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, "sort -k 3n | tail -n +101", _parts(spark, d))


def pipe_merged(spark: SparkSession, d: str) -> DataFrame:
    """Two sorted streams merged; both are sorted ahead."""
    graph = "1 parts\n2 lines\n3 sort\n4 sort -u\n5 sort -m\n%\npipe 1 3\npipe 2 4\npipe 3 5\npipe 4 5\n"
    return _placed(_graph(spark, d, graph)["5"][0])


def _graph(spark: SparkSession, d: str, text: str) -> dict:
    """A graph in text in which `lines`, `parts`, `orders` and `customers` are sources."""
    source = lambda s: lambda args: Function(lambda: s, 0, 1, "source")
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("line_no"), F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("value"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("line_no"), F.concat_ws(",", "c_custkey", "c_mktsegment").alias("value"))
    own = {"lines": source(_text(spark, d)), "parts": source(_parts(spark, d)), "orders": source(Stream(orders)), "customers": source(Stream(customers))}
    return run_graph(*from_text(text, registry(spark) | own))


def pipe_matches(spark: SparkSession, d: str) -> DataFrame:
    """Every number with its line number, in order."""
    return _run(spark, "grep -onh '[0-9]+'", _text(spark, d))


def pipe_context(spark: SparkSession, d: str) -> DataFrame:
    """Numbered lines with two digits in a row, and a line around each, stretches parted."""
    return _run(spark, "grep -n --context=1 '[0-9][0-9]'", _text(spark, d))


def pipe_listed_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold one of the words seen once, and two lines around each; the words are found by a pipeline of their own."""
    text = _text(spark, d)
    rare = pipeline(spark, "words | tr A-Z a-z | sort | uniq -u")(text)[0]
    return _run(spark, "grep -w --context=2 -f -", rare, text)


def pipe_scattered_counts(spark: SparkSession, d: str) -> DataFrame:
    """Lines scattered to six channels, cut into words in each, and counted together."""
    return _run(spark, "tee -s | parallel -n 6 words | cat | tr A-Z a-z | sort | uniq -c | sort -n", _text(spark, d))


def pipe_lettered_matches(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of lines that hold each of five letters, from one stage for each."""
    return _run(spark, "tee | parallel -l a,e,q,x,z grep -ci {} | paste", _text(spark, d))


def pipe_pasted(spark: SparkSession, d: str) -> DataFrame:
    """The lines that match, and their fields cut to characters, side by side: line numbers are given anew."""
    graph = "1 lines\n2 grep -i ^[a-m]\n3 tee\n4 cut -c 1-3\n5 tr a-z A-Z\n6 paste -d |\n%\npipe 1 2\npipe 2 3\npipe 3 4\npipe 3 5\npipe 4 6\npipe 5 6\n"
    return _placed(_graph(spark, d, graph)["6"][0])


def pipe_joined(spark: SparkSession, d: str) -> DataFrame:
    """Orders and customers joined by a field of each, between commas."""
    graph = "1 orders\n2 customers\n3 join -1 2 -2 1 -t ,\n4 sort\n%\npipe 1 3\npipe 2 3\npipe 3 4\n"
    return _placed(_graph(spark, d, graph)["4"][0])


def pipe_compared(spark: SparkSession, d: str) -> DataFrame:
    """Customers of orders and all customers: only in one, in the other, in both, told apart by tabs."""
    graph = "1 orders\n2 customers\n3 cut -d , -f 2\n4 cut -d , -f -1\n5 sort\n6 sort\n7 comm\n8 cat\n%\npipe 1 3\npipe 2 4\npipe 3 5\npipe 4 6\npipe 5 7\npipe 6 7\npipe 7 8\n"
    return _graph(spark, d, graph)["8"][0].df.select("channel", "value")


def pipe_differences(spark: SparkSession, d: str) -> DataFrame:
    """Edit scripts from all customers to those of two segments left out, one after the other: the lines that come out."""
    graph = "1 customers\n2 tee\n3 grep -v AUTO\n4 grep -v BUILD\n5 diff --from-file=-\n%\npipe 1 2\npipe 2 5\npipe 2 3\npipe 2 4\npipe 3 5\npipe 4 5\n"
    out = _graph(spark, d, graph)["5"][0].df
    return out.where(F.col("value").rlike("^[<>] ")).select("channel", "value")


def pipe_commands(spark: SparkSession, d: str) -> DataFrame:
    """Lines through two programs that treat each line by itself."""
    return _run(spark, "run sed 's/[0-9]/#/g' | run tr a-z A-Z", _text(spark, d))


def pipe_stored_share(spark: SparkSession, d: str) -> DataFrame:
    """Lines with a digit beside the number of all lines, which is stored by one branch and read by another."""
    stores = Stores()
    text = _text(spark, d)
    pipeline(spark, "wc -lwmc | writeval -s total", stores)(text)
    with_digit = pipeline(spark, "grep -c [0-9]", stores)(text)[0]
    total = pipeline(spark, "readval -s total", stores)()[0]
    return with_digit.df.select(F.col("value").alias("with_digit"), total.df.select("value").scalar().alias("total"))


QUERIES = {
    f.__name__: f
    for f in (
        pipe_word_counts, pipe_words_in_order, pipe_word_runs, pipe_sorted_lines, pipe_sorted_once, pipe_sorted_by_fields, pipe_sorted_by_number, pipe_merged, pipe_matches, pipe_context, pipe_listed_context,
        pipe_scattered_counts, pipe_lettered_matches, pipe_pasted, pipe_joined, pipe_compared, pipe_differences, pipe_commands, pipe_stored_share,
    )
}

_LINES = """WITH text AS (SELECT row_number() OVER (ORDER BY path NULLS FIRST, line_no NULLS FIRST, value) AS n, value FROM (SELECT DISTINCT path, line_no, coalesce(value, '') AS value, value IS NULL AS missing FROM text_lines))"""
_WORDS = f"""{_LINES}, lists AS (SELECT n, regexp_extract_all(value, '[A-Za-z]+') AS w FROM text),
 words AS (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM lists)"""
_PARTS = "SELECT p_partkey AS n, concat_ws(' ', p_size, p_brand, p_partkey, p_type) AS value FROM part"
ORACLE = {
    "pipe_word_counts": f"""{_WORDS}, counted AS (SELECT count(*) AS c, printf('%7d', count(*)) || ' ' || word AS value FROM words GROUP BY word)
SELECT row_number() OVER (ORDER BY c DESC, value DESC) AS line_no, value FROM counted""",
    "pipe_words_in_order": f"{_WORDS} SELECT row_number() OVER (ORDER BY n, place) AS line_no, word AS value FROM words",
    "pipe_word_runs": f"""{_WORDS}, placed AS (SELECT row_number() OVER (ORDER BY n, place) AS i, lower(word) AS w FROM words), marked AS (SELECT i, w, CASE WHEN lag(w) OVER (ORDER BY i) = w THEN 0 ELSE 1 END AS new FROM placed),
 runs AS (SELECT w, sum(new) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM marked)
SELECT run AS line_no, printf('%7d', count(*)) || ' ' || any_value(w) AS value FROM runs GROUP BY run""",
    "pipe_sorted_lines": f"{_LINES} SELECT row_number() OVER (ORDER BY value) AS line_no, value FROM text",
    "pipe_sorted_once": f"{_WORDS} SELECT row_number() OVER (ORDER BY word) AS line_no, word AS value FROM (SELECT DISTINCT word FROM words)",
    "pipe_sorted_by_fields": f"SELECT row_number() OVER (ORDER BY ' ' || string_split(value, ' ')[2] DESC, value DESC) AS line_no, value FROM ({_PARTS})",
    "pipe_sorted_by_number": f"SELECT line_no - 100 AS line_no, value FROM (SELECT row_number() OVER (ORDER BY n, value) AS line_no, value FROM ({_PARTS})) WHERE line_no > 100",
    "pipe_merged": f"{_LINES} SELECT row_number() OVER (ORDER BY value) AS line_no, value FROM (SELECT value FROM ({_PARTS}) UNION ALL SELECT DISTINCT value FROM text)",
    "pipe_matches": f"""{_LINES}, lists AS (SELECT n, regexp_extract_all(value, '[0-9]+') AS w FROM text), found AS (SELECT n, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM lists)
SELECT row_number() OVER (ORDER BY n, place) AS line_no, n || ':' || w AS value FROM found""",
    "pipe_context": f"""{_LINES}, hits AS (SELECT n FROM text WHERE regexp_matches(value, '[0-9][0-9]')), near AS (SELECT DISTINCT n + d AS n FROM hits, (VALUES (-1), (0), (1)) AS o(d)),
 kept AS (SELECT n, n || CASE WHEN n IN (SELECT n FROM hits) THEN ':' ELSE '-' END || value AS v, lag(n) OVER (ORDER BY n) AS before FROM text JOIN near USING (n)),
 shown AS (SELECT n, 1 AS k, v FROM kept UNION ALL SELECT n, 0, '--' FROM kept WHERE before < n - 1)
SELECT row_number() OVER (ORDER BY n, k) AS line_no, v AS value FROM shown""",
    "pipe_listed_context": f"""{_WORDS}, rare AS (SELECT lower(word) AS word FROM words GROUP BY 1 HAVING count(*) = 1), tokens AS (SELECT n, unnest(regexp_extract_all(lower(value), '[a-z0-9_]+')) AS word FROM text),
 near AS (SELECT DISTINCT n + d AS n FROM tokens, (VALUES (-2), (-1), (0), (1), (2)) AS o(d) WHERE word IN (SELECT word FROM rare))
SELECT row_number() OVER (ORDER BY n) AS line_no, value FROM text JOIN near USING (n)""",
    "pipe_scattered_counts": f"""{_WORDS}, counted AS (SELECT count(*) AS c, printf('%7d', count(*)) || ' ' || lower(word) AS value FROM words GROUP BY lower(word))
SELECT row_number() OVER (ORDER BY c, value) AS line_no, value FROM counted""",
    "pipe_lettered_matches": f"{_LINES} SELECT 1::BIGINT AS line_no, concat_ws(chr(9), " + ", ".join(f"count(*) FILTER (WHERE contains(lower(value), '{c}'))" for c in "aeqxz") + ") AS value FROM text",
    "pipe_pasted": f"{_LINES} SELECT row_number() OVER (ORDER BY n) AS line_no, substr(value, 1, 3) || '|' || translate(value, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS value FROM text WHERE regexp_matches(value, '^[a-mA-M]')",
    "pipe_joined": """WITH j AS (SELECT concat_ws(',', c_custkey, o_orderkey, o_orderstatus, c_mktsegment) AS value FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT row_number() OVER (ORDER BY value) AS line_no, value FROM j""",
    "pipe_compared": """WITH o AS (SELECT o_custkey::VARCHAR AS v FROM orders), c AS (SELECT c_custkey::VARCHAR AS v FROM customer)
SELECT 1 AS channel, v AS value FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM c) UNION ALL SELECT 2, chr(9) || v FROM (SELECT * FROM c EXCEPT ALL SELECT * FROM o) UNION ALL SELECT 3, chr(9) || chr(9) || v FROM (SELECT * FROM o INTERSECT ALL SELECT * FROM c)""",
    "pipe_differences": """WITH c AS (SELECT concat_ws(',', c_custkey, c_mktsegment) AS v FROM customer) SELECT 1 AS channel, '< ' || v AS value FROM c WHERE contains(v, 'AUTO') UNION ALL SELECT 2, '< ' || v FROM c WHERE contains(v, 'BUILD')""",
    "pipe_commands": f"{_LINES} SELECT n AS line_no, translate(regexp_replace(value, '[0-9]', '#', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS value FROM text",
    "pipe_stored_share": f"""{_LINES} SELECT count(*) FILTER (WHERE regexp_matches(value, '[0-9]'))::VARCHAR AS with_digit, concat_ws(' ', count(*), sum(len(list_filter(string_split_regex(value, '[ \\t\\n\\r\\f]+'), lambda x: x <> '')))::BIGINT,
 sum(length(value) + 1)::BIGINT, sum(strlen(value) + 1)::BIGINT) AS total FROM text""",
}

"""Whole programs built as graphs of stages, over tables that stand in for their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.functions import scalar
from fanloom.graph import Function, block, cat, parallel, perm, spread, tee
from fanloom.operators import compare, match, ordered, project, totals
from fanloom.session import table
from fanloom.stream import Bundle, Stream, enumerate_channels, literal


def _named(fn, name: str, n_in: int = 1, n_out: int = 1) -> Function:
    return Function(fn, n_in, n_out, name)


def labelled_tables(spark: SparkSession, d: str) -> DataFrame:
    """Labels and two tables gathered in order by one graph: block(label, regions, label, nations) | cat."""
    source = lambda name, column: _named(lambda: Stream(table(spark, d, name).select(F.col(column).cast("bigint").alias("line_no"), F.col(f"{name[0]}_name").alias("value"))), name, 0)
    label = lambda text: _named(lambda: literal(spark, text), "label", 0)
    graph = block(label("Regions"), source("region", "r_regionkey"), label("Nations"), source("nation", "n_nationkey")) | cat()
    return graph()[0].df.select("channel", "line_no", "value")


def copied_and_placed(spark: SparkSession, d: str) -> DataFrame:
    """Two channels copied as a group to six, placed anew and gathered by stride to two, then to one."""
    nations = Stream(table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("line_no"), F.col("n_name").alias("value")))
    regions = Stream(table(spark, d, "region").select(F.col("r_regionkey").cast("bigint").alias("line_no"), F.col("r_name").alias("value")))
    tag = lambda b: Bundle(tuple(s.map(lambda df, i=i: df.select("line_no", F.concat_ws(":", F.lit(i), "value").alias("value"))) for i, s in enumerate(b.streams, 1)))
    graph = tee() | perm(6, 5, 4, 3, 2, 1) | Function(lambda *s: tag(Bundle(s)), 6, 6, "tag") | cat(2) | cat()
    out = graph(nations, regions)[0].df
    return out.groupBy("channel", "value").agg(F.count("*").alias("n"))


def numbered_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Five rows of five numbers, each row a block of five parallel sources pasted side by side."""
    cell = lambda r: parallel(lambda c: _named(lambda r=r, c=c: literal(spark, f"{r}.{c}"), f"cell {r} {c}", 0), 5)
    row = lambda r: cell(r) | Function(lambda *s: Stream(compare.paste([x.df for x in s])), 5, 1, "paste")
    return (parallel(row, 5) | cat())()[0].df.select("channel", "value")


def channel_numbers(spark: SparkSession, d: str) -> DataFrame:
    return cat().run(enumerate_channels(spark, 6), 1)[0].df.select("channel", "value")


def scattered_totals(spark: SparkSession, d: str) -> DataFrame:
    """Orders scattered to four channels, counted in each by status, and the partial counts merged."""
    counted = lambda s, *channel: Stream(s.df.groupBy(*channel, "o_orderstatus").agg(F.count("*").alias("value")), ("o_orderstatus",))
    count = Function(counted, 1, 1, "count", each=counted)
    graph = spread(4, ["o_orderkey"]) | parallel(count, 4) | cat() | _named(lambda s: Stream(totals.merge_sum(s.df, "o_orderstatus"), ("o_orderstatus",)), "merge")
    return graph(Stream(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), ("o_orderkey",)))[0].df


def contribution_report(spark: SparkSession, d: str) -> DataFrame:
    """Two reports of one input: authors, and days of the week, each by number of documents."""
    docs = table(spark, d, "documents")
    by_author = totals.frequencies(docs.where("author_id IS NOT NULL"), F.col("author_id").cast("string"))
    by_day = totals.frequencies(docs.where("created IS NOT NULL"), F.date_format("created", "EEE"))
    return by_author.select(F.lit("author").alias("report"), "item", "count").unionAll(by_day.select(F.lit("day"), "item", "count"))


def contribution_plot(spark: SparkSession, d: str) -> DataFrame:
    """(day, place): on which days each user was active, users with many events placed toward the middle.

    Users take places from both sides by their number of events, so the table of places has one row per user.
    """
    events = table(spark, d, "events").where("ts IS NOT NULL")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    counts = events.groupBy("user_id").agg(F.count("*").alias("n"))
    placed = ordered.two_sided_places(counts, "user_id", "n").select("user_id", "place")
    days = events.select("user_id", scalar.day_number(seconds).alias("day")).distinct()
    first = events.agg(F.min(scalar.day_number(seconds)).alias("d")).scalar()
    return days.join(placed, "user_id").select((F.col("day") - first).alias("day"), "place")


def venue_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two selections of one input: how many documents each has, and how many authors only one or both of them have."""
    docs = table(spark, d, "documents").where("author_id IS NOT NULL")
    pick = lambda kind: docs.where(F.col("post_type") == kind).select("author_id")
    papers = docs.agg(F.count_if(F.col("post_type") == "question").alias("questions"), F.count_if(F.col("post_type") == "answer").alias("answers"))
    return compare.lookup(papers, compare.compare_counts(pick("question"), pick("answer")))


def bibliography_comparison(lines: DataFrame, first: str, second: str, order: str = "line_no", value: str = "value") -> DataFrame:
    """One row (first_records, second_records, only_first, only_second, both) for two kinds of records in the lines of a bibliography.

    A record runs from a line `<... key="KIND...` to the next line with <title>; its authors are on lines of their own.
    Authors are compared as multisets, one for each time a record names them.
    """
    v = F.col(value)
    # How a bibliography's records begin, and the line at which their authors end.
    record, title = "^<.* mdate=.* key=", "<title>"
    authors, counts = [], []
    for kind in (first, second):
        begins = v.startswith("<") & F.contains(v, F.lit(f'key="{kind}'))
        kept = ordered.pattern_range(lines.select(order, value), order, begins, F.contains(v, F.lit(title)))
        authors.append(kept.select(scalar.tag_text(v, "author").alias("author")).where("author IS NOT NULL"))
        counts.append(kept.agg(F.count_if(match.matches(v, record)).alias("n")).scalar())
    both = compare.compare_counts(*authors)
    return both.select(counts[0].alias("first_records"), counts[1].alias("second_records"), F.col("only_left").alias("only_first"), F.col("only_right").alias("only_second"), "both")


def moved_files(spark: SparkSession, d: str) -> DataFrame:
    """(name, from_folder, to_folder): files of the first hierarchy with a line in common with a file of that name in the second.

    A plan of copies; nothing is copied. The text files stand in for both hierarchies, the second with its folder renamed.
    """
    text = table(spark, d, "text_lines").where("value RLIKE '[a-z]'").select(scalar.base_name(F.col("path")).alias("name"), scalar.dir_name(F.col("path")).alias("folder"), "value").distinct()
    other = text.select("name", F.concat(F.lit("new/"), "folder").alias("to_folder"), "value")
    return text.join(other, ["name", "value"]).select("name", F.col("folder").alias("from_folder"), "to_folder").distinct()


def unused_exports(spark: SparkSession, d: str) -> DataFrame:
    """Defined symbols that none of the undefined ones names; customers and their orders stand in for symbol lines of 3 and 2 fields."""
    lines = table(spark, d, "customer").select(F.concat_ws(" ", F.lit("0000"), F.lit("T"), "c_custkey").alias("value")).unionAll(table(spark, d, "orders").select(F.concat_ws(" ", F.lit("U"), "o_custkey")))
    f = project.blank_fields(F.col("value"))
    exported = lines.where((F.size(f) == 3) & project.field(f, 2).rlike("[A-Z]")).select(project.field(f, 3).alias("symbol"))
    imported = lines.where(project.field(f, 1) == "U").select(project.field(f, 2).alias("symbol"))
    return compare.compare_sets(exported, imported)[0]


def listing_totals(spark: SparkSession, d: str) -> DataFrame:
    """Listing lines reordered, with the number and bytes of files; text files stand in for a folder."""
    files = table(spark, d, "text_lines").select("path", "line_no", "value").distinct().groupBy("path").agg(totals.byte_size(F.col("value")).alias("length"))
    lines = files.select(F.concat_ws(" ", F.format_string("%8d", F.col("length")), scalar.base_name(F.col("path"))).alias("value"))
    summary = files.agg(F.concat(F.count("*").cast("string"), F.lit(" File(s) "), F.sum("length").cast("string"), F.lit(" bytes")).alias("value"))
    return lines.unionAll(summary)


def code_metrics(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(place, name, value): the figures of a report on C files (.c) and headers (.h), as text, in the report's order.

    All lines are counted in one pass over the files, whatever the number of figures: as they stand, and without strings,
    characters and comments, as a preprocessor would leave them. Names of files and identifiers go through one aggregation
    each. Other files take no part, and a null content is an empty one.
    """
    is_c = F.col("path").endswith(".c")
    code = files.select(F.col(path).alias("path"), F.coalesce(content, F.lit("")).alias("text")).where(is_c | F.col("path").endswith(".h"))
    bare = scalar.strip_comments(F.translate("text", "#", "@"))
    each = code.select("path", F.explode(F.array(F.struct(F.lit(False).alias("bare"), F.col("text").alias("t")), F.struct(F.lit(True).alias("bare"), bare.alias("t")))).alias("x"))
    lines = each.select("path", "x.bare", F.explode(F.split("x.t", "\n")).alias("v")).where(F.col("bare") | (F.col("v") != ""))
    v, m, raw = F.col("v"), match.matches, ~F.col("bare")
    n = lambda c: F.count_if(c).cast("string")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.octet_length(v) + 1)), F.lit(0)).cast("string")
    of_bare = lambda pattern, where=F.lit(True), **o: n(F.col("bare") & where & m(v, pattern, **o))
    constants = F.sum(F.when(F.col("bare") & is_c, F.size(F.regexp_extract_all(v, F.lit(match.expression("[0-9][x0-9][0-9a-f]*", whole_word=True)), F.lit(0)))))
    # The names of the report's figures, with the patterns that they count.
    of_lines = [
        (2, "NSTRUCT", of_bare(r"struct[ \t]*\{|struct[ \t]*[a-zA-Z_][a-zA-Z0-9_]*[ \t]*\{")),
        (3, "NTYPEDEF", of_bare("typedef", whole_word=True)),
        (4, "NVOID", of_bare("void", whole_word=True)),
        (5, "NGETS", of_bare("gets", whole_word=True)),
        (7, "CHLINESCHAR", F.concat(n(raw), F.lit(":"), size(raw))),
        (9, "NCOMMENT", n(raw & m(v, r"/\*|//"))),
        (10, "NCOPYRIGHT", n(raw & m(v, "copyright", ignore_case=True))),
        (13, "CLINESCHAR", F.concat(n(raw & is_c), F.lit(":"), size(raw & is_c))),
        (14, "NFUNCTION", of_bare(r"^\{", is_c)),
        (15, "NGOTO", of_bare("goto", is_c, whole_word=True)),
        (16, "NREGISTER", of_bare("register", is_c, whole_word=True)),
        (17, "NMACRO", of_bare(r"@[ \t]*define[ \t][ \t]*[a-zA-Z_][a-zA-Z0-9_]*\(", is_c)),
        (18, "NINCLUDE", of_bare(r"@[ \t]*include", is_c)),
        (19, "NCONST", F.coalesce(constants, F.lit(0)).cast("string")),
    ]
    folder = scalar.base_name(scalar.dir_name(F.col("path")))
    uncommented = F.coalesce(F.sum(F.octet_length(F.regexp_replace("text", r"(?s)/\*.*?\*/", ""))), F.lit(0))
    average = lambda c: F.round(totals.guarded_average(c), 6).cast("string")
    of_files = [
        (1, "FNAMELEN", average(F.length(scalar.base_name(F.col("path"))))),
        (8, "NCCHAR", F.round(uncommented / 1000).cast("bigint").cast("string")),
        (11, "NCFILE", n(is_c)),
        (12, "NCDIR", F.count_distinct(F.when(is_c, folder)).cast("string")),
        (20, "NHFILE", n(~is_c)),
    ]
    ids = code.select(F.explode(F.array_distinct(F.regexp_extract_all(bare, F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("w")).where("w RLIKE '^[A-Za-z]'").distinct()

    def rows(df: DataFrame, figures: list) -> DataFrame:
        one = df.agg(*[c.alias(f"f{k}") for k, _, c in figures])
        return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(name).alias("name"), F.col(f"f{k}").alias("value")) for k, name, _ in figures])))

    return rows(lines, of_lines).unionAll(rows(code, of_files)).unionAll(rows(ids, [(6, "IDLEN", average(F.length("w")))]))


def code_report(spark: SparkSession, d: str) -> DataFrame:
    """The report on code, over documents: questions stand in for C files, answers for headers, sources for folders."""
    suffix = F.when(F.col("post_type") == "question", ".c").otherwise(".h")
    path = F.concat(F.lit("code/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), suffix)
    return code_metrics(table(spark, d, "documents").where("post_type IS NOT NULL").select(path.alias("path"), F.col("text").alias("content")))


def code_line_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all lines of documents as they stand, fused into one pass."""
    lines = table(spark, d, "documents").where("text IS NOT NULL").select(F.explode(F.split("text", "\n")).alias("v"))
    v, m = F.col("v"), match.matches
    return lines.agg(
        F.count_if(m(v, "return", whole_word=True)).alias("n_return"),
        F.count_if(m(v, r"/\*|//")).alias("n_comment"),
        F.count_if(v.startswith("{")).alias("n_function"),
        F.count("*").alias("n_lines"),
        totals.byte_size(v).alias("n_bytes"),
    )


def identifier_length(spark: SparkSession, d: str) -> DataFrame:
    """The average length of distinct identifiers that begin with a letter."""
    ids = project.exploded(table(spark, d, "documents"), F.regexp_extract_all("text", F.lit("[A-Za-z0-9_]+"), F.lit(0)), "w").where("w RLIKE '^[A-Za-z]'").distinct()
    return ids.agg(F.round(totals.guarded_average(F.length("w")), 6).alias("average_length"))


QUERIES = {
    f.__name__: f
    for f in (labelled_tables, copied_and_placed, numbered_matrix, channel_numbers, scattered_totals, contribution_report, contribution_plot, venue_comparison, moved_files, unused_exports, listing_totals, code_report, code_line_metrics, identifier_length)
}

_LINES = "WITH lines AS (SELECT DISTINCT path, line_no, value FROM text_lines)"
ORACLE = {
    "labelled_tables": "SELECT 1 AS channel, 1::BIGINT AS line_no, 'Regions' AS value UNION ALL SELECT 2, r_regionkey, r_name FROM region UNION ALL SELECT 3, 1, 'Nations' UNION ALL SELECT 4, n_nationkey, n_name FROM nation",
    "copied_and_placed": """WITH six AS (SELECT p, CASE WHEN p % 2 = 1 THEN 'r' ELSE 'n' END AS t, 2 - p % 2 AS second FROM generate_series(1, 6) AS g(p))
SELECT CASE WHEN p % 2 = 1 THEN 1 ELSE 2 END AS channel, p || ':' || v AS value, count(*) AS n
FROM six JOIN (SELECT 'n' AS t, n_name AS v FROM nation UNION ALL SELECT 'r', r_name FROM region) USING (t) GROUP BY 1, 2""",
    "numbered_matrix": "SELECT r::INTEGER AS channel, string_agg(r || '.' || c, chr(9) ORDER BY c) AS value FROM generate_series(1, 5) AS a(r), generate_series(1, 5) AS b(c) GROUP BY r",
    "channel_numbers": "SELECT (i + 1)::INTEGER AS channel, i::VARCHAR AS value FROM generate_series(0, 5) AS g(i)",
    "scattered_totals": "SELECT o_orderstatus, count(*) AS value FROM orders GROUP BY 1",
    "contribution_report": "SELECT 'author' AS report, author_id::VARCHAR AS item, count(*) AS count FROM documents WHERE author_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'day', strftime(created, '%a'), count(*) FROM documents WHERE created IS NOT NULL GROUP BY 2",
    "contribution_plot": """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT user_id, row_number() OVER (ORDER BY n, user_id) AS r, count(*) OVER () AS m FROM c)
SELECT DISTINCT (ts::DATE - (SELECT min(ts)::DATE FROM events))::BIGINT AS day, CASE WHEN r % 2 = 1 THEN (r - 1) // 2 ELSE m - r // 2 END AS place FROM events JOIN r USING (user_id)""",
    "venue_comparison": """WITH n AS (SELECT author_id, count(*) FILTER (WHERE post_type = 'question') AS q, count(*) FILTER (WHERE post_type = 'answer') AS a FROM documents WHERE author_id IS NOT NULL GROUP BY 1)
SELECT sum(q)::BIGINT AS questions, sum(a)::BIGINT AS answers, sum(greatest(q - a, 0))::BIGINT AS only_left, sum(greatest(a - q, 0))::BIGINT AS only_right, sum(least(a, q))::BIGINT AS both FROM n""",
    "moved_files": """WITH t AS (SELECT DISTINCT list_extract(string_split(path, '/'), -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, value FROM text_lines WHERE regexp_matches(value, '[a-z]'))
SELECT DISTINCT name, a.folder AS from_folder, 'new/' || b.folder AS to_folder FROM t a JOIN t b USING (name, value)""",
    "unused_exports": "SELECT c_custkey::VARCHAR AS symbol FROM customer EXCEPT ALL SELECT o_custkey::VARCHAR FROM orders",
    "listing_totals": f"""{_LINES}, f AS (SELECT path, sum(strlen(coalesce(value, '')) + 1)::BIGINT AS length FROM lines GROUP BY path)
SELECT printf('%8d', length) || ' ' || list_extract(string_split(path, '/'), -1) AS value FROM f UNION ALL SELECT count(*) || ' File(s) ' || sum(length)::BIGINT || ' bytes' FROM f""",
    "code_report": r"""WITH files AS (SELECT coalesce(text, '') AS t, post_type = 'question' AS c, coalesce(source, 'none') AS folder, doc_id FROM documents WHERE post_type IS NOT NULL),
 escaped AS (SELECT *, regexp_replace(translate(t, '#', '@'), '\\[\\"'']', '@', 'g') AS e FROM files),
 emptied AS (SELECT *, regexp_replace(regexp_replace(e, '"[^"\n]*"', '""', 'g'), '''[^''\n]*''', '''''', 'g') AS s FROM escaped),
 bare AS (SELECT *, regexp_replace(s, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g') AS b FROM emptied),
 raw AS (SELECT c, v FROM (SELECT c, unnest(string_split(t, chr(10))) AS v FROM files) WHERE v <> ''), l AS (SELECT c, unnest(string_split(b, chr(10))) AS v FROM bare),
 ids AS (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(b, '[A-Za-z0-9_]+')) AS w FROM bare) WHERE regexp_matches(w, '^[A-Za-z]')),
 words AS (SELECT c, v, list_distinct(regexp_extract_all(v, '[A-Za-z0-9_]+')) AS w FROM l)
SELECT 1 AS place, 'FNAMELEN' AS name, round(avg(length(doc_id::VARCHAR) + 2), 6)::DOUBLE::VARCHAR AS value FROM files
UNION ALL SELECT 2, 'NSTRUCT', count(*)::VARCHAR FROM l WHERE regexp_matches(v, 'struct[ \t]*\{|struct[ \t]*[a-zA-Z_][a-zA-Z0-9_]*[ \t]*\{')
UNION ALL SELECT 3, 'NTYPEDEF', count(*)::VARCHAR FROM words WHERE list_contains(w, 'typedef')
UNION ALL SELECT 4, 'NVOID', count(*)::VARCHAR FROM words WHERE list_contains(w, 'void')
UNION ALL SELECT 5, 'NGETS', count(*)::VARCHAR FROM words WHERE list_contains(w, 'gets')
UNION ALL SELECT 6, 'IDLEN', round(coalesce(avg(length(w)), 0), 6)::DOUBLE::VARCHAR FROM ids
UNION ALL SELECT 7, 'CHLINESCHAR', count(*) || ':' || coalesce(sum(strlen(v) + 1), 0)::BIGINT FROM raw
UNION ALL SELECT 8, 'NCCHAR', round(coalesce(sum(strlen(regexp_replace(t, '(?s)/\*.*?\*/', '', 'g'))), 0) / 1000)::BIGINT::VARCHAR FROM files
UNION ALL SELECT 9, 'NCOMMENT', count(*)::VARCHAR FROM raw WHERE regexp_matches(v, '/\*|//')
UNION ALL SELECT 10, 'NCOPYRIGHT', count(*)::VARCHAR FROM raw WHERE contains(lower(v), 'copyright')
UNION ALL SELECT 11, 'NCFILE', count(*)::VARCHAR FROM files WHERE c
UNION ALL SELECT 12, 'NCDIR', count(DISTINCT folder)::VARCHAR FROM files WHERE c
UNION ALL SELECT 13, 'CLINESCHAR', count(*) || ':' || coalesce(sum(strlen(v) + 1), 0)::BIGINT FROM raw WHERE c
UNION ALL SELECT 14, 'NFUNCTION', count(*)::VARCHAR FROM l WHERE c AND starts_with(v, '{')
UNION ALL SELECT 15, 'NGOTO', count(*)::VARCHAR FROM words WHERE c AND list_contains(w, 'goto')
UNION ALL SELECT 16, 'NREGISTER', count(*)::VARCHAR FROM words WHERE c AND list_contains(w, 'register')
UNION ALL SELECT 17, 'NMACRO', count(*)::VARCHAR FROM l WHERE c AND regexp_matches(v, '@[ \t]*define[ \t][ \t]*[a-zA-Z_][a-zA-Z0-9_]*\(')
UNION ALL SELECT 18, 'NINCLUDE', count(*)::VARCHAR FROM l WHERE c AND regexp_matches(v, '@[ \t]*include')
UNION ALL SELECT 19, 'NCONST', coalesce(sum(len(regexp_extract_all(v, '\b[0-9][x0-9][0-9a-f]*\b'))), 0)::BIGINT::VARCHAR FROM l WHERE c
UNION ALL SELECT 20, 'NHFILE', count(*)::VARCHAR FROM files WHERE NOT c""",
    "code_line_metrics": r"""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents WHERE text IS NOT NULL)
SELECT count(*) FILTER (WHERE regexp_matches(v, '\breturn\b')) AS n_return, count(*) FILTER (WHERE regexp_matches(v, '/\*|//')) AS n_comment, count(*) FILTER (WHERE starts_with(v, '{')) AS n_function,
 count(*) AS n_lines, sum(strlen(v) + 1)::BIGINT AS n_bytes FROM l""",
    "identifier_length": "SELECT round(avg(length(w)), 6) AS average_length FROM (SELECT DISTINCT w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents) WHERE regexp_matches(w, '^[A-Za-z]'))",
}

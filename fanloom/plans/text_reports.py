"""Text reports: words, n-grams, characters, word properties, duplicates, spelling, sizes, over lines and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.functions import scalar
from fanloom.functions.scalar import ascii_lower
from fanloom.fuse import fuse_columns
from fanloom.graph import Function, cat, parallel, spread
from fanloom.operators import match, ordered, project, totals
from fanloom.operators.compare import compare_counts, compare_sets
from fanloom.operators.monitor import as_json
from fanloom.session import table
from fanloom.stream import Stream, gather


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the text files; a line delivered twice counts once."""
    return table(spark, d, "text_lines").select("path", "line_no", "value").distinct()


def _words(df: DataFrame, text: str = "value") -> DataFrame:
    return project.exploded(df, project.letter_words(F.col(text)), "word")


def word_frequency(spark: SparkSession, d: str) -> DataFrame:
    return totals.frequencies(_words(lines(spark, d)), F.col("word"), "word")


def digrams(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of letters within words. Words are counted first, so each distinct word is cut up once."""
    return _ngrams(spark, d, 2)


def trigrams(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d, 3)


def _ngrams(spark: SparkSession, d: str, n: int) -> DataFrame:
    counted = word_frequency(spark, d)
    return counted.select("count", F.explode(project.ngrams(F.col("word"), n)).alias("ngram")).groupBy("ngram").agg(F.sum("count").alias("count"))


def character_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Characters with their percentage of all bytes, line ends included; blanks and line ends are one key, ''."""
    text = lines(spark, d)
    value = F.coalesce("value", F.lit(""))
    chars = text.select(F.explode(F.concat(project.characters(value), F.array(F.lit("\n")))).alias("c"))
    key = F.when(F.col("c").isin(" ", "\t", "\n", "\r"), "").otherwise(F.col("c"))
    size = text.agg(totals.byte_size(F.col("value"))).scalar()
    return totals.with_percentage(totals.frequencies(chars, key, "character"), size).withColumn("percent", F.round("percent", 6))


def document_words(spark: SparkSession, d: str) -> DataFrame:
    """Words between blanks over all documents, whole texts."""
    return totals.frequencies(project.exploded(table(spark, d, "documents"), project.blank_words(F.col("text")), "word"), F.col("word"), "word")


def scattered_word_count(spark: SparkSession, d: str) -> DataFrame:
    """The words counted in eight channels and merged; the channels are one plan, which reads the lines once."""

    def counted(s: Stream, *channel: str) -> Stream:
        return Stream(project.exploded(s.df, project.blank_words(F.col("value")), "key", channel).groupBy(*channel, "key").agg(F.count("*").alias("value")), ("key",))

    graph = spread(8, ["path", "line_no"]) | parallel(Function(counted, name="count", each=counted), 8) | cat()
    return totals.merge_sum(graph(Stream(lines(spark, d), ("path", "line_no")))[0].df).select(F.col("key").alias("word"), F.col("value").alias("count"))


def word_properties(spark: SparkSession, d: str) -> DataFrame:
    """Distinct words with their notes side by side, those with at least one; one projection instead of four channels and a paste."""
    w = F.col("word")
    notes = fuse_columns(_words(lines(spark, d)).distinct(), {"palindrome": project.palindrome_note(w), "consonants": project.consonant_note(w), "long": project.length_note(w)}, ("word",))
    return notes.where(F.contains(F.concat("palindrome", "consonants", "long"), F.lit(":")))


def duplicate_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of equal text on one line."""
    docs = table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("id"), "text")
    return totals.same_content(docs, "id", "text", shown=lambda i: F.format_string("%012d", i))


def duplicate_members(spark: SparkSession, d: str) -> DataFrame:
    """The same as one row for each document, with its text's digest and how many documents have it."""
    return totals.members(table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")), "digest")


def spelling_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of the lines, in lower case, that no document holds: a set difference."""
    known = _words(table(spark, d, "documents"), "text").select(ascii_lower(F.col("word")).alias("word"))
    return compare_sets(_words(lines(spark, d)).select(ascii_lower(F.col("word")).alias("word")), known, distinct=True)[0]


def spelling_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that hold a rare word, with two lines around each."""
    text = lines(spark, d)
    rare = totals.frequencies(_words(text).select(ascii_lower(F.col("word")).alias("word")), F.col("word"), "word").where("count = 1").select("word")
    hits = match.match_pattern_table(text, "value", rare, "word", word=True, ids=["path", "line_no"]).select("path", "line_no", F.lit(True).alias("hit"))
    marked = text.join(hits, ["path", "line_no"], "left")
    return ordered.context(marked, "line_no", F.coalesce("hit", F.lit(False)), 2, 2, ("path",)).select("path", "line_no", "matched")


def matching_context(spark: SparkSession, d: str) -> DataFrame:
    text = lines(spark, d)
    return ordered.context(text, "line_no", F.coalesce(match.matches(F.col("value"), "[0-9]"), F.lit(False)), 2, 2, ("path",)).select("path", "line_no", "matched")


def match_outputs(spark: SparkSession, d: str) -> DataFrame:
    """Four outputs of one match, gathered: matching lines, counts, files with and files without a match."""
    text = lines(spark, d)
    made = match.multi_match(text, "path", match.matches(F.col("value"), "[0-9][0-9]"), ["matching_lines", "count", "files", "other_files"])
    shaped = [made[0].select("path", F.col("line_no").alias("n")), made[1].select("path", F.col("matched_lines").alias("n")), made[2].select("path", F.lit(None).cast("bigint").alias("n")), made[3].select("path", F.lit(None).cast("bigint").alias("n"))]
    return gather(_bundle(shaped)).df


def _bundle(dfs):
    from fanloom.stream import Bundle

    return Bundle(tuple(Stream(x, ("path",)) for x in dfs))


def match_forms(spark: SparkSession, d: str) -> DataFrame:
    """Counts of lines by each form of matching, in one pass."""
    v, m = F.col("value"), match.matches
    forms = {"pattern": m(v, "g[aeiou]+l"), "fixed": m(v, "tai", fixed=True), "inverted": m(v, "tai", fixed=True, inverted=True), "word": m(v, "lenu", whole_word=True), "any_case": m(v, "GABRA|GREA", ignore_case=True), "fixed_word": m(v, "NORGRI", fixed=True, whole_word=True, ignore_case=True)}
    return lines(spark, d).agg(*[F.count_if(c).alias(n) for n, c in forms.items()])


def only_matches(spark: SparkSession, d: str) -> DataFrame:
    found = match.only_matching(lines(spark, d), "value", "[0-9]+(?:[.-][0-9]+)*")
    return totals.frequencies(found, F.col("value"), "text")


def match_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold any of a table of strings, here the names of regions and order priorities, as they are."""
    phrases = table(spark, d, "region").select(F.lower("r_name").alias("p")).unionAll(spark.createDataFrame([("http",), ("```",), ("error",)], "p string"))
    return match.match_pattern_table(table(spark, d, "documents").select("doc_id", "text"), "text", phrases, "p").select("doc_id")


def file_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Line, byte and word metrics of each file, fused into one aggregation."""
    v = F.coalesce("value", F.lit(""))
    words = F.size(project.blank_words(v)).cast("bigint")
    return lines(spark, d).groupBy("path").agg(
        F.count("*").alias("n_lines"),
        totals.byte_size(F.col("value")).alias("n_bytes"),
        F.sum(words).alias("n_words"),
        F.count_if(v == "").alias("n_empty"),
        F.count_if(match.matches(v, "[.!?][ \t]*\\z")).alias("n_ends"),
        F.round(totals.guarded_average(F.length(v)), 6).alias("average_length"),
    )


def compressed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of every document, and whether the compressed ones are within what each method can give: its frame at least, and little more than the text."""
    sizes = totals.compressed_sizes(table(spark, d, "documents"), "text", ("doc_id",))
    most = F.col("bytes") * 1.01 + 700
    held = (F.col("gzip") >= 20) & (F.col("bzip2") >= 14) & (F.col("xz") >= 32) & (F.greatest("gzip", "bzip2", "xz") <= most)
    return sizes.select("doc_id", "bytes", held.alias("held"))


def content_kinds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(totals.text_kind(F.col("text").cast("binary")).alias("kind")).agg(F.count("*").alias("n"))


def stripped_documents(spark: SparkSession, d: str) -> DataFrame:
    """Digests of every document without strings and comments, and of it with only letters, digits and single blanks; and its length without vowels."""
    bare = scalar.strip_comments(F.col("text"))
    kept = scalar.squeeze_characters(scalar.keep_characters(F.col("text"), "A-Za-z0-9", " "), " ")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.md5(bare.cast("binary")).alias("stripped"), F.md5(kept.cast("binary")).alias("kept"), F.length(scalar.delete_characters(F.col("text"), "aeiou")).alias("n_without_vowels"))


def decoded_urls(spark: SparkSession, d: str) -> DataFrame:
    """Urls with their %xx decoded, null where they cannot be."""
    urls = table(spark, d, "web_log_report").where("url IS NOT NULL").select("url").distinct()
    return urls.select("url", scalar.percent_decode(F.col("url")).alias("decoded"))


def lines_as_json(spark: SparkSession, d: str) -> DataFrame:
    """Records as JSON, and what is read from it again."""
    made = as_json(lines(spark, d).where("path IS NOT NULL AND line_no IS NOT NULL AND value IS NOT NULL"), "path", "line_no", "value")
    return made.select(*[F.get_json_object("value", f"$.{c}").alias(c) for c in ("path", "line_no", "value")])


def source_vocabularies(spark: SparkSession, d: str) -> DataFrame:
    """Words only in questions, only in answers, and in both, as multisets: counts from one aggregation."""
    docs = table(spark, d, "documents")
    by = lambda kind: _words(docs.where(F.col("post_type") == kind), "text")
    return compare_counts(by("question"), by("answer"))


def merged_counts(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the partial counts of all channels, repeated deliveries left out."""
    parts = table(spark, d, "merge_sum").where("key IS NOT NULL").select("channel", "seq", "value", "key").distinct()
    return totals.merge_sum(parts)


def partial_count_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same from lines `count key`, blanks in front skipped and blanks in keys kept; other lines take no part."""
    parts = table(spark, d, "merge_sum").select("channel", "seq", F.concat_ws(" ", F.lit(" "), F.col("value").cast("string"), F.btrim("key")).alias("line")).distinct()
    count, key = totals.parse_partial(F.col("line"))
    return totals.merge_sum(parts.select(count.alias("value"), key.alias("key")).where("value IS NOT NULL")).withColumn("value", F.col("value").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (word_frequency, digrams, trigrams, character_frequency, document_words, scattered_word_count, word_properties, duplicate_documents, duplicate_members, spelling_words, spelling_context, matching_context, match_outputs, match_forms, only_matches, match_phrases, file_metrics, compressed_documents, content_kinds, stripped_documents, decoded_urls, lines_as_json, source_vocabularies, merged_counts, partial_count_lines)
}

_LINES = "WITH lines AS (SELECT DISTINCT path, line_no, value FROM text_lines)"
_WORDS = f"{_LINES}, words AS (SELECT unnest(regexp_extract_all(value, '[A-Za-z]+')) AS word FROM lines)"
_PARTS = "WITH parts AS (SELECT DISTINCT channel, seq, value, key FROM merge_sum)"


def _ngram_sql(n: int) -> str:
    return f"{_WORDS}, counted AS (SELECT word, count(*) AS c FROM words GROUP BY word), cut AS (SELECT c, unnest([substr(word, i::BIGINT, {n}) FOR i IN generate_series(1, length(word) - {n - 1})]) AS ngram FROM counted WHERE length(word) >= {n}) SELECT ngram, sum(c)::BIGINT AS count FROM cut GROUP BY ngram"


def _context_sql(hits: str) -> str:
    return f"""hits AS ({hits}), near AS (SELECT DISTINCT path, line_no + d AS line_no FROM hits, (VALUES (-2), (-1), (0), (1), (2)) AS o(d))
SELECT path, line_no, EXISTS (SELECT 1 FROM hits h WHERE h.path = lines.path AND h.line_no = lines.line_no) AS matched FROM lines JOIN near USING (path, line_no)"""


ORACLE = {
    "word_frequency": f"{_WORDS} SELECT word, count(*) AS count FROM words GROUP BY word",
    "digrams": _ngram_sql(2),
    "trigrams": _ngram_sql(3),
    "character_frequency": f"""{_LINES}, chars AS (SELECT unnest(regexp_extract_all(coalesce(value, '') || chr(10), '(?s).')) AS c FROM lines)
SELECT CASE WHEN c IN (' ', chr(9), chr(10), chr(13)) THEN '' ELSE c END AS character, count(*) AS count,
 round(count(*) / (SELECT sum(strlen(coalesce(value, '')) + 1) FROM lines) * 100, 6) AS percent FROM chars GROUP BY 1""",
    "document_words": "SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(text, '[ \\t\\n\\r\\f]+')) AS word FROM documents) WHERE word <> '' GROUP BY word",
    "scattered_word_count": f"{_LINES} SELECT word, count(*) AS count FROM (SELECT unnest(string_split_regex(value, '[ \\t\\n\\r\\f]+')) AS word FROM lines) WHERE word <> '' GROUP BY word",
    "duplicate_documents": "SELECT md5(text) AS digest, string_agg(printf('%012d', doc_id), ' ' ORDER BY doc_id) AS items, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "duplicate_members": "SELECT doc_id, digest, n FROM (SELECT doc_id, md5(text) AS digest, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE text IS NOT NULL) WHERE n > 1",
    "spelling_words": f"{_WORDS} SELECT DISTINCT lower(word) AS word FROM words EXCEPT SELECT DISTINCT lower(word) FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)",
    "matching_context": f"{_LINES}, " + _context_sql("SELECT path, line_no FROM lines WHERE regexp_matches(value, '[0-9]')"),
    "spelling_context": f"{_WORDS}, rare AS (SELECT lower(word) AS word FROM words GROUP BY 1 HAVING count(*) = 1), tokens AS (SELECT path, line_no, unnest(regexp_extract_all(lower(value), '[a-z0-9_]+')) AS word FROM lines), " + _context_sql("SELECT DISTINCT path, line_no FROM tokens WHERE word IN (SELECT word FROM rare)"),
    "match_outputs": f"""{_LINES}, counted AS (SELECT path, count(*) FILTER (WHERE regexp_matches(value, '[0-9][0-9]')) AS n FROM lines GROUP BY path)
SELECT path, line_no AS n, 1 AS channel FROM lines WHERE regexp_matches(value, '[0-9][0-9]') UNION ALL SELECT path, n, 2 FROM counted
UNION ALL SELECT path, NULL, 3 FROM counted WHERE n > 0 UNION ALL SELECT path, NULL, 4 FROM counted WHERE n = 0""",
    "match_forms": f"""{_LINES} SELECT count(*) FILTER (WHERE regexp_matches(value, 'g[aeiou]+l')) AS pattern, count(*) FILTER (WHERE contains(value, 'tai')) AS fixed,
 count(*) FILTER (WHERE NOT contains(value, 'tai')) AS inverted, count(*) FILTER (WHERE regexp_matches(value, '(^|[^A-Za-z0-9_])lenu([^A-Za-z0-9_]|$)')) AS word,
 count(*) FILTER (WHERE regexp_matches(value, '(?i)GABRA|GREA')) AS any_case, count(*) FILTER (WHERE regexp_matches(value, '(?i)(^|[^A-Za-z0-9_])NORGRI([^A-Za-z0-9_]|$)')) AS fixed_word FROM lines""",
    "only_matches": f"{_LINES} SELECT text, count(*) AS count FROM (SELECT unnest(regexp_extract_all(value, '[0-9]+(?:[.-][0-9]+)*')) AS text FROM lines) GROUP BY text",
    "match_phrases": "SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM (SELECT lower(r_name) AS p FROM region UNION ALL VALUES ('http'), ('```'), ('error')) q WHERE contains(text, q.p))",
    "file_metrics": f"""{_LINES} SELECT path, count(*) AS n_lines, sum(strlen(coalesce(value, '')) + 1)::BIGINT AS n_bytes,
 sum(len(list_filter(string_split_regex(coalesce(value, ''), '[ \\t\\n\\r\\f]+'), lambda x: x <> '')))::BIGINT AS n_words, count(*) FILTER (WHERE coalesce(value, '') = '') AS n_empty,
 count(*) FILTER (WHERE regexp_matches(value, '[.!?][ \\t]*\\z')) AS n_ends, round(avg(length(coalesce(value, ''))), 6) AS average_length FROM lines GROUP BY path""",
    "word_properties": f"""{_WORDS}, d AS (SELECT DISTINCT word FROM words),
 spots AS (SELECT word, unnest(generate_series(1, length(word) - 3)) AS i FROM d WHERE length(word) > 3),
 p AS (SELECT word, max(i) AS i FROM spots WHERE substr(word, i::BIGINT, 1) = substr(word, i::BIGINT + 3, 1) AND substr(word, i::BIGINT + 1, 1) = substr(word, i::BIGINT + 2, 1) GROUP BY word),
 c AS (SELECT word, max(i) AS i FROM spots WHERE regexp_matches(substr(word, i::BIGINT, 4), '^[^aeiouyAEIOUY]*$') GROUP BY word),
 n AS (SELECT word, CASE WHEN p.i IS NULL THEN '' ELSE 'p: ' || substr(word, p.i::BIGINT, 2) || '-' || substr(word, p.i::BIGINT + 2, 2) END AS palindrome, CASE WHEN c.i IS NULL THEN '' ELSE 'c: ' || substr(word, c.i::BIGINT, 4) END AS consonants,
  CASE WHEN length(word) > 12 THEN 'l: ' || length(word) ELSE '' END AS long FROM d LEFT JOIN p USING (word) LEFT JOIN c USING (word))
SELECT * FROM n WHERE palindrome <> '' OR consonants <> '' OR long <> ''""",
    "compressed_documents": "SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS bytes, true AS held FROM documents",
    "content_kinds": """WITH k AS (SELECT CASE WHEN text = '' THEN 'empty' WHEN starts_with(text, 'BZh') THEN 'bzip2' WHEN starts_with(text, '%PDF') THEN 'pdf' WHEN starts_with(text, 'PK' || chr(3) || chr(4)) THEN 'zip' ELSE 'text' END AS kind FROM documents WHERE text IS NOT NULL)
SELECT kind, count(*) AS n FROM k GROUP BY kind""",
    "stripped_documents": r"""WITH e AS (SELECT doc_id, text, regexp_replace(text, '\\[\\"'']', '@', 'g') AS e FROM documents WHERE text IS NOT NULL),
 s AS (SELECT doc_id, text, regexp_replace(regexp_replace(e, '"[^"\n]*"', '""', 'g'), '''[^''\n]*''', '''''', 'g') AS s FROM e)
SELECT doc_id, md5(regexp_replace(s, '(?s)/\*.*?\*/|//[^\n]*', ' ', 'g')) AS stripped, md5(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g')) AS kept, length(regexp_replace(text, '[aeiou]', '', 'g'))::INTEGER AS n_without_vowels FROM s""",
    "decoded_urls": "SELECT DISTINCT url, CASE WHEN NOT regexp_matches(url, '%([^0-9A-Fa-f]|.[^0-9A-Fa-f]|.?$)') THEN url_decode(url) END AS decoded FROM web_log_report WHERE url IS NOT NULL",
    "lines_as_json": "SELECT path, line_no::VARCHAR AS line_no, value FROM (SELECT DISTINCT path, line_no, value FROM text_lines) WHERE path IS NOT NULL AND line_no IS NOT NULL AND value IS NOT NULL",
    "source_vocabularies": """WITH w AS (SELECT post_type, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents),
 n AS (SELECT word, count(*) FILTER (WHERE post_type = 'question') AS q, count(*) FILTER (WHERE post_type = 'answer') AS a FROM w GROUP BY word)
SELECT coalesce(sum(greatest(q - a, 0)), 0)::BIGINT AS only_left, coalesce(sum(greatest(a - q, 0)), 0)::BIGINT AS only_right, coalesce(sum(least(a, q)), 0)::BIGINT AS both FROM n""",
    "merged_counts": f"{_PARTS} SELECT key, sum(value)::BIGINT AS value FROM parts WHERE key IS NOT NULL GROUP BY key",
    "partial_count_lines": """WITH parts AS (SELECT DISTINCT channel, seq, concat_ws(' ', ' ', value::VARCHAR, trim(key, ' ')) AS line FROM merge_sum),
 read AS (SELECT TRY_CAST(regexp_extract(line, '(?s)^\\s*([0-9]+)\\s+(.*)\\z', 1) AS BIGINT) AS value, regexp_extract(line, '(?s)^\\s*([0-9]+)\\s+(.*)\\z', 2) AS key FROM parts WHERE regexp_matches(line, '(?s)^\\s*([0-9]+)\\s+(.*)\\z'))
SELECT key, sum(value)::BIGINT AS value FROM read WHERE value IS NOT NULL GROUP BY key""",
}

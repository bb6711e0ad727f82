"""Matching records by patterns: filters, counts, files, and several of them at once."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.stream import PlanError

#: Characters of patterns in one automaton, automata that a task keeps, and bytes of lines it holds at once.
_BLOCK, _KEPT, _HELD = 1 << 16, 8, 1 << 25


def matches(value: Column, pattern: str, fixed: bool = False, ignore_case: bool = False, whole_word: bool = False, inverted: bool = False) -> Column:
    """Whether a line matches; a null line matches nothing, inverted or not."""
    if fixed and not (ignore_case or whole_word):
        hit = F.contains(value, F.lit(pattern))
    else:
        hit = value.rlike(expression(pattern, fixed, ignore_case, whole_word))
    return ~hit if inverted else hit


def expression(pattern: str, fixed: bool = False, ignore_case: bool = False, whole_word: bool = False) -> str:
    """The regular expression that meets what matches() does."""
    body = re.escape(pattern) if fixed else pattern
    body = rf"(?<![A-Za-z0-9_])(?:{body})(?![A-Za-z0-9_])" if whole_word else body
    return ("(?i)" if ignore_case else "") + body


def only_matching(df: DataFrame, value: str, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One record per match, holding just the matched text."""
    return df.select(*keep, F.explode(F.regexp_extract_all(F.col(value), F.lit(f"({pattern})"), F.lit(1))).alias(value))


def match_counts(df: DataFrame, file: str, hit: Column) -> DataFrame:
    """(file, matched_lines): lines that match in each file, not occurrences."""
    return df.groupBy(file).agg(F.count_if(hit).alias("matched_lines"))


def files_with(df: DataFrame, file: str, hit: Column, matching: bool = True) -> DataFrame:
    """Files with at least one matching line, or those with none."""
    found = F.coalesce(F.bool_or(hit), F.lit(False))
    return df.groupBy(file).agg(found.alias("_found")).where(F.col("_found") if matching else ~F.col("_found")).select(file)


_OUTPUTS = {"matching_lines", "count", "files", "other_files"}


def multi_match(df: DataFrame, file: str, hit: Column, outputs: list[str], value: str = "value") -> list[DataFrame]:
    """Several outputs of one match, in the order asked for; the files' outputs all come from one aggregation."""
    unknown = [o for o in outputs if o not in _OUTPUTS]
    if unknown or len(set(outputs)) != len(outputs):
        raise PlanError(f"match: outputs {outputs} cannot be combined")
    by_file = match_counts(df, file, hit)
    made = {
        "matching_lines": lambda: df.where(hit),
        "count": lambda: by_file,
        "files": lambda: by_file.where("matched_lines > 0").select(file),
        "other_files": lambda: by_file.where("matched_lines = 0").select(file),
    }
    return [made[o]() for o in outputs]


def _in_word(c: str) -> bool:
    return c == "_" or c.isalnum() or unicodedata.category(c)[0] == "M"


def _automaton(strings: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for x in strings:
        made.add_word(x, len(x))
    made.make_automaton()
    return made


def _holds(automaton: ahocorasick.Automaton, text: str, word: bool) -> bool:
    """Whether a text holds one of the automaton's strings; as a word, with no letter, digit or _ of any script beside it."""
    for last, length in automaton.iter(text):
        begun = last + 1 - length
        if not word or not (begun and _in_word(text[begun - 1]) or last + 1 < len(text) and _in_word(text[last + 1])):
            return True
    return False


def _match_in_blocks(df: DataFrame, text: Column, patterns: DataFrame, word: bool) -> DataFrame:
    """Rows whose text holds one of the strings in the one column of patterns, however many there are.

    The strings are a stated set that all lines are held against, in blocks of bounded size: each has an automaton, and a
    task goes through all blocks for the lines it holds. Blocks are sent out one by one.
    """
    context, blocks, block, n = df.sparkSession.sparkContext, [], [], 0
    for r in patterns.select(F.col(patterns.columns[0])).toLocalIterator():
        block.append(r[0])
        n += len(r[0])
        if n >= _BLOCK:
            blocks.append(context.broadcast(block))
            block, n = [], 0
    if block:
        blocks.append(context.broadcast(block))

    def found(batches: list[pa.RecordBatch], kept: dict[int, ahocorasick.Automaton]) -> Iterator[pa.RecordBatch]:
        texts = [x for b in batches for x in b.column(b.num_columns - 1).to_pylist()]
        hit = [False] * len(texts)
        for k, block in enumerate(blocks):
            automaton = kept.get(k) or _automaton(block.value)
            if len(kept) < _KEPT:
                kept[k] = automaton
            for i, x in enumerate(texts):
                hit[i] = hit[i] or (x is not None and _holds(automaton, x, word))
        at = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(pa.array(hit[at : at + b.num_rows], pa.bool_()))
            at += b.num_rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, {}
        for b in batches:
            held.append(b)
            size += b.nbytes
            if size >= _HELD:
                yield from found(held, kept)
                held, size = [], 0
        if held:
            yield from found(held, kept)

    # Bytes that are no text are replaced on both sides, as Python has no strings for them.
    return df.withColumn("_text", F.make_valid_utf8(text)).mapInArrow(run, df.schema)


def match_pattern_table(df: DataFrame, value: str, patterns: DataFrame, pattern: str, word: bool = False, ids: list[str] | None = None) -> DataFrame:
    """Lines that hold at least one of the fixed strings in a table of patterns; lines alike stay apart.

    Whole words meet the patterns in an equi-join, however many there are; ids, all columns by default, tell lines apart,
    and only they come back from it. Other strings, and words that are no single ASCII token, are looked for in each line,
    block by block.
    """
    words = patterns.select(F.lower(F.col(pattern)).alias("_word")).where(F.col("_word") != "").distinct()
    if word:
        ids = ids or df.columns
        held = F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(value)), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("_word")
        named = [F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)]
        hits = df.select(*named, held).join(words, "_word", "left_semi").drop("_word")
        others = words.where(~F.col("_word").rlike(r"\A[a-z0-9_]+\z"))
        if not others.isEmpty():
            hits = hits.unionAll(_match_in_blocks(df.select(*ids, F.col(value).alias("_line")), F.lower("_line"), others, True).select(*named))
        hits = hits.distinct()
        same = F.lit(True)
        for i, c in enumerate(ids):
            same = same & F.col(c).eqNullSafe(F.col(f"_id{i}"))
        return df.join(hits, same, "left_semi")
    strings = patterns.select(F.make_valid_utf8(F.col(pattern)).alias("_string")).where(F.col("_string") != "").distinct()
    return _match_in_blocks(df, F.col(value), strings, False)


def repeated_values(df: DataFrame, key: str) -> DataFrame:
    """Values that occur more than once, once each."""
    return df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key)

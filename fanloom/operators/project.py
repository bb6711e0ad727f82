"""Fields, ranges and terms of text records, as column expressions or narrow maps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank_fields(value: Column) -> Column:
    """Fields between runs of blanks; outer blanks separate nothing, and a line of blanks has none."""
    bare = F.regexp_replace(value, r"^[ \t]+|[ \t]+$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t]+"))


def char_fields(value: Column, delimiter: str) -> Column:
    """Fields between single delimiters, quotes having no meaning."""
    return F.split(value, re.escape(delimiter))


def field(fields: Column, n: int) -> Column:
    """The n-th field counted from 1, or from the end if negative; '' if there is none."""
    return F.coalesce(F.try_element_at(fields, F.lit(n)), F.lit(""))


def number(text: Column) -> Column:
    """The integer a field starts with, 0 if none, as in sums over fields that may hold `-`; null if it has more than 38 digits."""
    digits = F.regexp_extract(text, r"^[ \t]*([+-]?[0-9]+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(digits.try_cast("decimal(38,0)"))


def _within(place: Column, ranges: list[tuple[int, int | None]]) -> Column:
    hit = F.lit(False)
    for a, b in ranges:
        hit = hit | (place.between(a, b) if b is not None else place >= a)
    return hit


def cut(value: Column, delimiter: str, ranges: list[tuple[int, int | None]], only_delimited: bool = False) -> Column:
    """The fields in the ranges (from, to; counted from 1, None for the last), in the order of the input, joined by the delimiter.

    A line without a delimiter stays as it is, or is null with only_delimited.
    """
    kept = F.filter(char_fields(value, delimiter), lambda x, i: _within(i + 1, ranges))
    return F.when(F.contains(value, F.lit(delimiter)), F.array_join(kept, delimiter)).otherwise(F.lit(None) if only_delimited else value)


def cut_characters(value: Column, ranges: list[tuple[int, int | None]]) -> Column:
    """The characters in the ranges, in the order of the input."""
    return F.array_join(F.filter(characters(value), lambda x, i: _within(i + 1, ranges)), "")


def cut_streams(df: DataFrame, value: str, delimiter: str, ranges: list[tuple[int, int]]) -> list[DataFrame]:
    """One output per range, all from one scan's columns."""
    return [df.withColumn(value, cut(F.col(value), delimiter, [r])) for r in ranges]


def reorder(value: Column, delimiter: str, ranges: list[tuple[int, int]]) -> Column:
    """Ranges of fields in the order given, as one projection and not as a join of cut channels."""
    return F.array_join(F.array(*[cut(value, delimiter, [r]) for r in ranges]), delimiter)


def letter_words(value: Column) -> Column:
    """Runs of ASCII letters, in order."""
    return F.regexp_extract_all(value, F.lit("[A-Za-z]+"), F.lit(0))


def blank_words(value: Column) -> Column:
    """Pieces between runs of blank, tab, newline, carriage return and form feed, without empty ones."""
    return F.filter(F.split(value, "[ \t\n\r\f]+"), lambda x: x != "")


def characters(value: Column) -> Column:
    """Single characters, in order."""
    return F.filter(F.split(value, ""), lambda x: x != "")


def ngrams(word: Column, n: int) -> Column:
    """All runs of n characters within a word."""
    return F.when(F.length(word) >= n, F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def exploded(df: DataFrame, items: Column, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, F.explode(items).alias(name))


def labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def palindrome_note(word: Column) -> Column:
    """`p: ab-ba` for the last place where two characters are followed by the same two reversed; '' if none."""
    hit = r"^.*(.)(.)\2\1"
    return F.when(word.rlike(hit), F.concat(F.lit("p: "), F.regexp_extract(word, hit, 1), F.regexp_extract(word, hit, 2), F.lit("-"), F.regexp_extract(word, hit, 2), F.regexp_extract(word, hit, 1))).otherwise("")


def consonant_note(word: Column) -> Column:
    """`c: wxyz` for the last four characters in a row that are no vowels; '' if none."""
    hit = "^.*([^aeiouyAEIOUY]{4})"
    return F.when(word.rlike(hit), F.concat(F.lit("c: "), F.regexp_extract(word, hit, 1))).otherwise("")


def length_note(word: Column, over: int = 12) -> Column:
    return F.when(F.length(word) > over, F.concat(F.lit("l: "), F.length(word).cast("string"))).otherwise("")

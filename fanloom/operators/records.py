"""Parsing of web-log lines that keeps going after bad ones: typed rows, and located errors for the rest.

One recursive-descent parser walks over a text with a single cursor: a record is fields between blanks, a field is a
bracketed, a quoted or a plain run, a request is method, url and protocol, and so on. A quoted run is read up to its closing
quote wherever that stands, so a broken quote runs into what follows. The parser notices that at the next anchor, a position
where a record is known to start, reports the record's error with its place, and resumes at the first anchor after the
record's start. Every line is therefore in exactly one record or one error.

What is an anchor depends on the text. In a batch of rows of a table, put together to one text, it is the start of every
row, so no record ever takes in another row. In the text of a whole file it is the start of a line, unless a quote is open
there and the line does not read as the start of a record (host, ident, user and an opening bracket). Lines are joined that
way only if what they make up loads; else the first of them is an error of its own, and the parser resumes at the second.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanloom.session import free_name

_BLANKS = re.compile(r"[ \t]*")
_RETURNS = re.compile(r"\r*")
# A field that needs no closer look, with the blanks after it or at a line end: a plain, bracketed or quoted run.
_TOKEN = re.compile(r'''([^ \t\r\n"\\[][^ \t\r\n"\\]*|\[[^]"\\\r\n]*\]|"[^"\\\n]*")(?:([ \t]+)|(?=\n))''')
# Runs without anything a rule has to look at; an escaped quote or backslash is passed over as a pair.
_PLAIN = re.compile(r'(?:[^ \t\r\n"\\]+|\\["\\]?)+')
_QUOTED = re.compile(r'(?:[^"\\\n]+|\\[^\n]?)*')
_BRACKETED = re.compile(r'(?:[^]"\\\r\n]+|\\["\\]?)*')
_NAME = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?")
_NUMERIC = re.compile(r"[0-9.]+")
_IPV4 = re.compile(r"(?:[0-9]+\.){3}[0-9]+\.?")
_IPV6 = re.compile(r"[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*")
_URL = re.compile(r"(?:/|http://)(?:[!-$&-~]|%[0-9A-Fa-f]{2})*")
_DIGITS = re.compile(r"[0-9]+")
_START = re.compile(r"[^ \t\n\"\[]+[ \t]+[^ \t\n\"\[]+[ \t]+[^ \t\n\"\[]+[ \t]+\[")
_TIME = re.compile(r"\[(\d\d)/([A-Z][a-z]{2})/(\d{4}):(\d\d):(\d\d):(\d\d)(?: ([+-]\d{4}))?\]")
_MONTHS = {m: i for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split(), 1)}
_MOST = 9223372036854775807

#: What a line gives: typed values, the names of those whose text could not be typed, or the reason and place of an error.
RECORD = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("host", "ident", "auth_user")]
    + [T.StructField("ts", T.TimestampNTZType()), T.StructField("tz", T.StringType())]
    + [T.StructField(n, T.StringType()) for n in ("method", "url", "protocol")]
    + [T.StructField("status", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("untyped", T.StringType())]
    + [T.StructField("reason", T.StringType()), T.StructField("error_at", T.IntegerType())]
)
#: The same for the text of a file, with the number of the record's first line, from 1, and how many lines it takes.
FILE_RECORD = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("lines", T.IntegerType()), *RECORD.fields])
_ARROW_TYPES = {"string": pa.string(), "timestamp_ntz": pa.timestamp("us"), "int": pa.int32(), "bigint": pa.int64()}


class Bad(Exception):
    """A record that cannot be read: the reason, and the position of the error."""

    def __init__(self, reason: str, at: int):
        super().__init__(reason)
        self.reason, self.at = reason, at


class Parser:
    """Reads records of the common log format from a text; one method per rule, each from the cursor on.

    rows: the positions where rows of a table start, in order; None for the text of a file.
    """

    def __init__(self, text: str, rows: list[int] | None = None):
        self.text, self.end, self.rows = text, len(text), rows
        self.at = 0
        self.anchor = 0  # the first anchor after the record's start that is known without looking at quotes
        self.crossed = -1  # where a quote was opened that runs over a line end
        self.seen = 0  # unescaped quotes of the record so far

    def records(self) -> Iterator[tuple[int, int, tuple]]:
        """(start, stop, values of RECORD) of every record and error; error_at counts from the record's start."""
        starts = iter([*self.rows[1:], self.end + 1] if self.rows else []) if self.rows is not None else None
        while starts is not None or self.at < self.end:
            begun = self.at
            if starts is None:
                found = self.text.find("\n", begun)
                self.anchor = found + 1 if found >= 0 else self.end + 1
            elif (anchor := next(starts, None)) is None:
                return
            else:
                self.anchor = anchor
            try:
                values = *self.record(), None, None
            except Bad as bad:
                reason, at = (bad.reason, bad.at) if self.crossed < 0 else ("quoting", self.crossed)
                values = *[None] * (len(RECORD) - 2), reason, at - begun
                self.at = self.anchor
            yield begun, self.at, values

    # Rules of the record.

    def record(self) -> tuple:
        self.crossed, self.seen, begun = -1, 0, self.at
        fields, text, end = [], self.text, self.end
        while self.at < end:
            at = self.at
            # Most fields are one token, blanks included; all others are read rule by rule.
            m = _TOKEN.match(text, at)
            if m and (m[2] or self.line_ends(m.end())) and (text[at] != '"' or self.seen == 0 and at > begun):
                if text[at] == '"':
                    self.seen, self.opened = 2, at
                fields.append((m[1], at))
                self.at = m.end()
                continue
            if self.closed():
                break
            fields.append(self.field(begun))
            self.at = _BLANKS.match(text, self.at).end()
        stop = self.at
        if self.seen not in (0, 2):
            raise Bad("quoting", self.opened)
        if len(fields) != 7 or self.text[begun] in " \t":
            raise Bad("columns", begun if fields and self.text[begun] in " \t" else fields[7][1] if len(fields) > 7 else stop)
        (host, at), (ident, _), (user, _), (time, _), (request, request_at), (status, _), (size, size_at) = fields
        if not self.is_host(host):
            raise Bad("host", at)
        method, url, protocol = self.request(request, request_at)
        size = self.size(size, size_at)
        ts, tz = self.time(time)
        code = int(status) if _DIGITS.fullmatch(status) and len(status.lstrip("0")) < 19 else None
        untyped = ([] if ts else ["ts"]) + ([] if code is not None else ["status"])
        self.at = min(_RETURNS.match(self.text, stop).end() + 1, self.end + 1)
        return host, ident, user, ts, tz, method, url, protocol, code, size, ",".join(untyped) or None

    def closed(self) -> bool:
        """Whether the record ends here: nothing but carriage returns up to an anchor or the end of the text."""
        at = self.at
        if at < self.end and self.text[at] == "\r":
            at = _RETURNS.match(self.text, at).end()
        return at == self.end or self.line_ends(at)

    def line_ends(self, at: int) -> bool:
        """Whether a line end stands here behind which the next record starts; no quote is open."""
        return self.text[at] == "\n" and (self.rows is None or at + 1 == self.anchor)

    def field(self, begun: int) -> tuple[str, int]:
        """A bracketed or quoted run that blanks or the record's end follow, else a plain run, with its position."""
        start, text = self.at, self.text
        c = text[start]
        if c == '"' and start > begun:
            self.quoted()
        elif not (c == "[" and self.bracketed()):
            self.plain()
        return text[start : self.at], start

    def quoted(self) -> None:
        """From an opening quote to the next one that is not escaped, over line ends if need be, but over no anchor."""
        start = self.opened = self.at
        self.seen += 1
        if self.seen > 2:
            raise Bad("quoting", start)
        if self.seen == 2:  # the first one stood within brackets
            if self.text[start + 1 : start + 2] not in (" ", "\t"):
                self.after_quote(start)
            self.at += 1
            return
        at = start + 1
        while True:
            at = _QUOTED.match(self.text, at).end()
            if at >= self.end:
                raise Bad("quoting", start)
            if self.text[at] == '"':
                break
            if at + 1 == self.anchor and self.rows is not None or self.rows is None and (at + 1 >= self.end or _START.match(self.text, at + 1)):
                raise Bad("quoting", start)
            if self.crossed < 0 and self.rows is None:
                self.crossed = start
            at += 1
        self.seen = 2
        self.after_quote(at)
        self.at = at + 1

    def after_quote(self, at: int) -> None:
        """What follows the second quote of a record: a blank, or the record's end."""
        self.at = at + 1
        if not (self.closed() or self.text[self.at] in " \t"):
            raise Bad("quoting", at)

    def bracketed(self) -> bool:
        """A run up to the next closing bracket, if blanks or the record's end follow that; else the cursor stays."""
        text, at, inner = self.text, self.at, []
        while True:
            at = _BRACKETED.match(text, at).end()
            if at >= self.end or self.line_ends(at):
                return False
            if text[at] == "]":
                break
            if text[at] == "\r":
                back, self.at = self.at, at
                over = self.closed()
                self.at = back
                if over:
                    return False
            elif text[at] == '"':
                inner.append(at)
            at += 1
        back, self.at = self.at, at + 1
        if not (self.closed() or text[self.at] in " \t"):
            self.at = back
            return False
        for quote in inner:
            self.stray(quote)
        self.at = at + 1
        return True

    def plain(self) -> None:
        """A run without blanks, up to the record's end at most."""
        text = self.text
        while True:
            if m := _PLAIN.match(text, self.at):
                self.at = m.end()
            if self.at >= self.end or text[self.at] in " \t" or self.closed():
                return
            if text[self.at] == '"':
                self.stray(self.at)
            self.at += 1

    def stray(self, at: int) -> None:
        """An unescaped quote within a bracketed or plain run counts as any other."""
        self.seen += 1
        here = self.at
        if self.seen == 1:
            self.opened = at
            if at == 0 or self.text[at - 1] not in " \t":
                raise Bad("quoting", at)
        elif self.seen == 2:
            self.after_quote(at)
            self.at = here
        else:
            raise Bad("quoting", at)

    @staticmethod
    def is_host(s: str) -> bool:
        if _NUMERIC.fullmatch(s):
            return _IPV4.fullmatch(s) is not None and all(len(x) < 19 and int(x) < 256 for x in s.rstrip(".").split("."))
        return (s != "-" and _NAME.fullmatch(s) is not None) or _IPV6.fullmatch(s) is not None

    @staticmethod
    def request(s: str, at: int) -> tuple[str, str, str | None]:
        inner = s[1:-1] if len(s) > 1 and s[0] == s[-1] == '"' else s
        parts = [x for x in inner.split(" ") if x]
        if not 2 <= len(parts) <= 3 or not _URL.fullmatch(parts[1]):
            raise Bad("url", at)
        return parts[0], parts[1], parts[2] if len(parts) == 3 else None

    @staticmethod
    def size(s: str, at: int) -> int | None:
        if s == "-":
            return None
        if not _DIGITS.fullmatch(s) or len(s.lstrip("0")) > 19 or int(s) > _MOST:
            raise Bad("bytes", at)
        return int(s)

    @staticmethod
    def time(s: str) -> tuple[datetime | None, str | None]:
        """Local time and zone; a time that is none is null and does not make the record bad."""
        m = _TIME.fullmatch(s)
        try:
            return (datetime(int(m[3]), _MONTHS[m[2]], int(m[1]), int(m[4]), int(m[5]), int(m[6])), m[7]) if m else (None, None)
        except (KeyError, ValueError):
            return None, None


def _columns(rows: list[tuple], schema: T.StructType) -> pa.Array:
    kinds = [pa.field(f.name, _ARROW_TYPES[f.dataType.simpleString()]) for f in schema]
    return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], fields=kinds)


def read_rows(lines: list[str | None]) -> list[tuple]:
    """The values of RECORD for each row of a table of lines, which are parsed as one text; a null line is an empty one."""
    starts, at = [], 0
    for s in lines:
        starts.append(at)
        at += len(s or "") + 1
    return [values for _, _, values in Parser("\n".join(s or "" for s in lines), starts).records()]


def read_file(text: str) -> list[tuple]:
    """The values of FILE_RECORD for each record and error in the text of a file; every line is in one of them."""
    found, line_no = [], 1
    for start, stop, values in Parser(text).records():
        lines = text.count("\n", start, min(stop, len(text))) or 1
        lines += stop > len(text) and text.count("\n", start, len(text)) > 0
        found.append((line_no, lines, *values))
        line_no += lines
    return found


def parse_line(value: Column) -> Column:
    """A struct as RECORD for a column of log lines, one record each: `reason` is null for a line that loads.

    The first reason that applies is given: quoting, columns, host, url, bytes. A null or empty line has no fields, so its
    reason is `columns`. error_at is the position of the error in the line. A time or status that has no typed form is null,
    and named in `untyped`.
    """

    @F.arrow_udf(RECORD)
    def parsed(lines: pa.Array) -> pa.Array:
        return _columns(read_rows(lines.to_pylist()), RECORD)

    # Marked so that a filter on the result is not planned as a second evaluation.
    return parsed.asNondeterministic()(value)


def parse_file(text: Column) -> Column:
    """An array of structs as FILE_RECORD for a column with texts of whole files; null for a null text, empty for an empty one."""

    @F.arrow_udf(T.ArrayType(FILE_RECORD))
    def parsed(texts: pa.Array) -> pa.Array:
        offsets, rows = [0], []
        for s in texts.to_pylist():
            rows += read_file(s or "")
            offsets.append(len(rows))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _columns(rows, FILE_RECORD), mask=texts.is_null())

    return parsed.asNondeterministic()(text)


def parsed_lines(lines: DataFrame, line: str = "value") -> tuple[DataFrame, str]:
    """lines with one more column, a struct as RECORD, and that column's name: `record`, numbered if the name is taken."""
    name = free_name("record", lines.columns)
    return lines.withColumn(name, parse_line(F.col(line))), name


def rejected(lines: DataFrame, line: str = "value", ids: list[str] | None = None) -> DataFrame:
    """The lines that cannot be loaded: (ids or all columns of lines, reason, error_at).

    With ids, a row that was delivered again in full, with the same ids and text, counts once; null ids are ids like any
    other. Lines are read where they lie, and only the bad ones are compared, so lines that load never move.
    """
    keep = ids or lines.columns
    df, name = parsed_lines(lines.select(*ids, line) if ids else lines, line)
    reason, error_at = (F.col(f"{name}.{c}").alias(free_name(c, lines.columns)) for c in ("reason", "error_at"))
    bad = df.where(F.col(f"{name}.reason").isNotNull()).select(*df.columns[:-1], reason, error_at)
    out = bad.distinct() if ids else bad
    return out.select(*[F.col(c) for c in keep], *[F.col(c).alias(free_name(n, keep)) for c, n in zip(bad.columns[-2:], ("reason", "error_at"))])


def loaded(lines: DataFrame, line: str = "value", ids: list[str] | None = None) -> DataFrame:
    """The lines that load, as typed rows: (ids, host, ident, auth_user, ts, tz, method, url, protocol, status, bytes).

    With ids, rows delivered again in full count once. Names of ids that clash with a typed column keep theirs; the typed
    column is numbered.
    """
    raw = lines.select(*(ids or []), line)
    df, name = parsed_lines(raw.distinct() if ids else raw, line)
    typed = [F.col(f"{name}.{f.name}").alias(free_name(f.name, ids or [])) for f in RECORD[:-2]]
    return df.where(F.col(f"{name}.reason").isNull()).select(*(ids or []), *typed)


def text_records(lines: DataFrame, path: str = "path", line_no: str = "line_no", line: str = "value", block: int = 4096) -> DataFrame:
    """(path, line_no, lines, columns of RECORD): the records and errors of texts given by their numbered lines.

    Lines are put together to texts of `block` line numbers, so a file of any length is read by many tasks; a text's end is
    an anchor like any other. line_no is that of a record's first line, and `lines` how many it takes. Numbers may have
    gaps, must not repeat, and their lines hold no line end; null lines are empty ones, a null path is a path like any other.
    """
    place = F.struct(F.col(line_no).cast("bigint").alias("n"), F.coalesce(line, F.lit("")).alias("v"))
    blocks = lines.select(F.col(path).alias("path"), F.floor(F.col(line_no) / block).alias("block"), place.alias("p")).where(F.col("p.n").isNotNull()).groupBy("path", "block").agg(F.array_sort(F.collect_list("p")).alias("l"))
    # The last line gets its end as well, so that it counts if it is empty.
    text = F.concat(F.array_join(F.transform("l", lambda x: x["v"]), "\n"), F.lit("\n"))
    found = blocks.select("path", F.transform("l", lambda x: x["n"]).alias("n"), F.explode(parse_file(text)).alias("r"))
    return found.select("path", F.element_at("n", F.col("r.line_no").cast("int")).alias("line_no"), *[f"r.{f.name}" for f in FILE_RECORD.fields[1:]])

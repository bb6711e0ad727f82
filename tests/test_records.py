import datetime
import random

import pytest
from pyspark.sql import functions as F

from fanloom.operators.records import Parser, loaded, parse_file, parse_line, read_file, read_rows, rejected, text_records

GOOD = 'h.example - - [05/Mar/2021:23:42:26 -0400] "GET /a%20b?x=1 HTTP/1.0" 200 42'


def judged(line):
    return read_rows([line])[0][-2]


@pytest.mark.parametrize("change, reason", [
    ((), None), ((GOOD, GOOD + "\r\r"), None), ((GOOD, GOOD + " \t\r"), None), ((" - - ", " \t-\t - "), None), (("h.example", "1.2.3.255."), None),
    (("h.example", "2001:db8::A5"), None), (("h.example", "a_b-c."), None), ((" 42", " -"), None), ((" 42", " 9223372036854775807"), None),
    (("/a%20b?x=1", "http://x/y"), None), ((" HTTP/1.0", ""), None), (("/a%20b", '/a\\"b'), None), (("GET /", "GET   /"), None),
    (("h.example", ""), "columns"), ((" 42", " 42 43"), "columns"), ((" 42", ""), "columns"), ((GOOD, ""), "columns"), ((GOOD, "\r"), "columns"), ((GOOD, "   "), "columns"), ((GOOD, " " + GOOD), "columns"),
    ((' "GET', ' ""GET'), "quoting"), (('1.0" ', "1.0 "), "quoting"), (('1.0" 200', '1.0"200'), "quoting"), ((' "GET', '"GET'), "quoting"), (('/a%20b', '/a"b'), "quoting"), (('1.0" 200 42', '1.0" 200 "42"'), "quoting"), (("/a%20b", '/a\\\\"b'), "quoting"),
    (("h.example", "-"), "host"), (("h.example", "1.2.3.256"), "host"), (("h.example", "1.2.3"), "host"), (("h.example", "1.2.3.4.."), "host"), (("h.example", "a..b"), "host"), (("h.example", ".a"), "host"), (("h.example", "höst"), "host"), (("h.example", "a:b"), "host"), (("h.example", "a,b"), "host"),
    (('"GET /a%20b?x=1 HTTP/1.0"', '"-"'), "url"), (("/a%20b", "a"), "url"), (("/a%20b", "/a%2gb"), "url"), (("/a%20b", "/é"), "url"), (("HTTP/1.0", "HTTP/1.0 x"), "url"), (("/a%20b", "/a\tb"), "url"), (('"GET /a%20b?x=1 HTTP/1.0"', "GET"), "url"),
    ((" 42", " -1"), "bytes"), ((" 42", " --"), "bytes"), ((" 42", " 9223372036854775808"), "bytes"), ((" 42", " 4²"), "bytes"),
])
def test_reasons(change, reason):
    assert judged(GOOD.replace(*change) if change else GOOD) == reason


def test_first_reason_applies():
    assert judged(GOOD.replace("h.example", "-").replace("42", "x")) == "host"
    assert judged(GOOD.replace('"GET', 'GET').replace("h.example", "-")) == "quoting"


def test_typed_values_and_position(spark):
    df = spark.createDataFrame([(1, GOOD), (2, GOOD.replace(" 42", " x")), (3, None)], "id long, value string").select("id", parse_line(F.col("value")).alias("r"))
    a, b, c = [r.r for r in df.orderBy("id").collect()]
    assert (a.host, a.method, a.url, a.protocol, a.status, a.bytes, a.tz) == ("h.example", "GET", "/a%20b?x=1", "HTTP/1.0", 200, 42, "-0400")
    assert a.ts == datetime.datetime(2021, 3, 5, 23, 42, 26) and a.reason is None
    assert (b.reason, b.error_at) == ("bytes", len(GOOD) - 2) and b.host is None
    assert c.reason == "columns"


def test_split_keeps_every_line_once(spark):
    rows = [(i, GOOD if i % 3 else "bad line") for i in range(50)] + [(3, "bad line"), (None, "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "line_id long, value string, reason string, record string")
    bad, good = rejected(df, ids=["line_id"]), loaded(df, ids=["line_id"])
    assert bad.count() + good.count() == 51 and bad.count() == 18
    assert rejected(df).columns == ["line_id", "value", "reason", "record", "reason_1", "error_at"]
    assert loaded(df.withColumnRenamed("line_id", "host"), ids=["host"]).columns[:2] == ["host", "host_1"]
    assert rejected(df.limit(0), ids=["line_id"]).count() == 0


def test_long_line(spark):
    line = GOOD.replace("/a%20b", "/" + "a" * 300_000)
    assert judged(line) is None and judged(line.replace("/a", '/"a', 1)) == "quoting"


def test_file_resumes_after_a_broken_quote(spark):
    broken = GOOD.replace('1.0" ', "1.0 ")
    wrapped = GOOD.replace("HTTP/1.0", "HTTP/1.0\nx")  # a quoted line end belongs to its record
    text = "\n".join([GOOD, broken, GOOD, "junk", wrapped, GOOD]) + "\n"
    df = spark.createDataFrame([(text,), (None,), ("",)], "value string").select(parse_file(F.col("value")).alias("r"))
    rows = df.collect()
    assert [x.reason for x in rows[0].r] == [None, "quoting", None, "columns", None, None]
    assert [(x.line_no, x.lines) for x in rows[0].r] == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 2), (7, 1)]
    assert rows[1].r is None and rows[2].r == []


def test_every_line_is_in_one_record_or_error():
    broken = GOOD.replace('1.0" ', "1.0 ")
    reasons = lambda *xs: [(r[0], r[1], r[-2]) for r in read_file("\n".join(xs))]
    assert reasons(broken, "xx yy zz", GOOD) == [(1, 1, "quoting"), (2, 1, "columns"), (3, 1, None)]
    assert reasons(broken, 'xx" 1 2', GOOD) == [(1, 1, "quoting"), (2, 1, "quoting"), (3, 1, None)]  # joined, it is no record
    assert reasons(broken, "", "", broken) == [(1, 1, "quoting"), (2, 1, "columns"), (3, 1, "columns"), (4, 1, "quoting")]
    rng = random.Random(6)
    for _ in range(300):
        lines = [rng.choice([GOOD, broken, "", "a b", '" 200 1', 'x "', GOOD.replace("HTTP/1.0", "HTTP/1.0\nx"), "\r"]) for _ in range(rng.randrange(1, 12))]
        found = read_file("\n".join(lines) + "\n")
        assert [r[0] for r in found] == [1 + sum(r[1] for r in found[:i]) for i in range(len(found))] and sum(r[1] for r in found) == sum(s.count("\n") + 1 for s in lines)


def test_rows_of_one_text_are_read_as_if_each_stood_alone():
    rng = random.Random(7)
    parts = ['"', " ", '\\"', "\\", "[", "]", "\r", "\n", "\t", "x", '"GET /a HTTP/1.0"', "[a b]", "1.2.3.4", " 200", " 42", GOOD]
    lines = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(4000)] + [None, ""]
    together = read_rows(lines)
    assert len(together) == len(lines) and together == [read_rows([s])[0] for s in lines]
    assert read_rows([]) == [] and list(Parser("").records()) == []


def test_values_that_cannot_be_typed_are_named(spark):
    lines = [GOOD, GOOD.replace(" 200 ", " 4000000000 "), GOOD.replace(" 200 ", " " + "9" * 30 + " "), GOOD.replace("/Mar/", "/Foo/").replace(" 200 ", " - ")]
    rows = [r.r for r in spark.createDataFrame(list(enumerate(lines)), "id int, v string").orderBy("id").select(parse_line(F.col("v")).alias("r")).collect()]
    assert [(r.status, r.untyped, r.reason) for r in rows] == [(200, None, None), (4000000000, None, None), (None, "status", None), (None, "ts,status", None)]


def test_texts_of_numbered_lines(spark):
    broken = GOOD.replace('1.0" ', "1.0 ")
    rows = [("a", i, GOOD if i % 3 else broken) for i in range(0, 60, 2)] + [("b", 7, None), (None, 1, "x"), (None, None, "lost")]
    df = spark.createDataFrame(rows, "path string, line_no long, value string")
    for block in (4, 4096):
        got = {(r.path, r.line_no): (r.lines, r.reason) for r in text_records(df, block=block).collect()}
        assert got == {(p, n): (1, "columns" if p != "a" else None if n % 3 else "quoting") for p, n, _ in rows if n is not None}
    assert text_records(df.limit(0)).count() == 0

from pyspark.sql import functions as F

from fanloom.functions.weblog import area, host_key, minute_text, request_minute, url_key
from fanloom.operators.hot_keys import distinct_records, hot_keys, totals_by_key, weblog_totals, with_share

LOG = "line_no long, host string, url string, bytes long, item long, field string"


def test_keys(spark):
    hosts = ["a.B.", " \tX\t ", "-", "", ".", "a..", None, "-.", "É"]
    df = spark.createDataFrame([(h,) for h in hosts], "h string").select(host_key(F.col("h")))
    assert [r[0] for r in df.collect()] == ["a.b", "x", None, None, None, "a.", None, None, "é"]
    urls = ["/a/b?x#y", "/a#b?c", "a/b", "", None, "/", "?x", "//x/y"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").withColumn("k", url_key(F.col("u")))
    assert [r[0] for r in df.select("k").collect()] == ["/a/b", "/a", None, None, None, "/", None, "//x/y"]
    assert [r[0] for r in df.select(area(F.col("k"))).collect()] == ["a", "a", None, None, None, "", None, ""]


def test_minutes(spark):
    df = spark.sql("SELECT DATE '1969-12-31' AS d, 23 AS h, 59 AS m UNION ALL SELECT DATE '2021-03-01', 24, 0 UNION ALL SELECT DATE '2021-03-01', 0, -1 UNION ALL SELECT DATE '2021-03-01', 7, 5 UNION ALL SELECT NULL, 1, 1")
    m = request_minute(F.col("d"), F.col("h"), F.col("m"))
    assert [r[0] for r in df.select(minute_text(m)).collect()] == ["1969-12-31 23:59", None, None, "2021-03-01 07:05", None]


def test_totals_with_repeats_nulls_and_skew(spark):
    rows = [(i, "HOT", "/x", 1, 7, "f") for i in range(900)] + [(i, "hot.", "/x", 5, 7, "f") for i in range(50)]
    rows += [(1000 + i, f"h{i}", None if i % 2 else "/y?q", None, 7, "f") for i in range(100)]
    rows += [(None, "n", "/n", -4, 7, "f"), (None, "n", "/n", -4, 7, "f"), (2000, None, None, 3, 7, "f")]
    df = spark.createDataFrame(rows, LOG)
    got = {(r.field, r["item"]): (r.requests, r.bytes, r.field_requests) for r in weblog_totals(df).collect()}
    assert got["host", "hot"] == (900, 850 + 250, 1001)
    assert got["url", "/y"] == (50, 0, 951)
    assert got["host", "n"] == (1, 0, 1001)  # rows alike in a null id count once
    assert len(got) == 1 + 100 + 1 + 3
    assert {tuple(r) for r in hot_keys(df, 0.05).collect()} == {("host", "hot"), ("url", "/x"), ("url", "/y")}


def test_empty(spark):
    df = spark.createDataFrame([], LOG)
    assert weblog_totals(df).count() == 0 and hot_keys(df).count() == 0


def test_generic_totals(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (1, "a", 3.0), (2, "a", None), (3, None, 9.0)], "id long, k string, v double")
    records = distinct_records(df, [F.col("id")], {"k": F.col("k")}, {"v": F.col("v")})
    out = with_share(totals_by_key(records, ["k"], ["v"])).collect()
    assert [(r["item"], r.requests, r.v, r.share) for r in out] == [("a", 2, 3.0, 1.0)]

"""Queries held against small tables made here, in which a cut of the input or of the result would show."""

import random

import pytest
from pyspark.sql import functions as F

from fanloom.operators import match
from fanloom.plans import programs, relational, text_reports
from fanloom.stream import PlanError, Stream, literal
from fanloom.tools import grep_listed, pipeline, sort, uniq, values


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables given as name=(schema, rows), and gives their folder."""

    def made(**tables):
        for name, (schema, rows) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return made


def test_unused_parts_subtracts_every_line(spark, folder):
    lines = [(2, 50), (3, 1), (3, 50)]
    d = folder(part=("p_partkey bigint", [(1,), (2,), (3,), (4,)]), lineitem=("l_partkey bigint, l_quantity int", lines))
    assert sorted(r.partkey for r in relational.unused_parts(spark, d).collect()) == [1, 4]


def test_unused_exports_subtracts_every_order(spark, folder):
    orders = [(1, "O"), (2, "F"), (2, "P")]
    d = folder(customer=("c_custkey bigint", [(1,), (2,), (3,)]), orders=("o_custkey bigint, o_orderstatus string", orders))
    assert [r.symbol for r in programs.unused_exports(spark, d).collect()] == ["3"]


def test_rows_of_repeated_keys_of_any_quantity(spark, folder):
    lines = [(1, 9, 1, 1, 1.0), (1, 9, 2, 1, 30.0), (2, 9, 3, 1, 1.0), (3, 8, 4, 1, 40.0), (3, 8, 4, 1, 40.0), (4, 8, 5, 1, 7.0)]
    d = folder(lineitem=("l_partkey bigint, l_suppkey bigint, l_orderkey bigint, l_linenumber int, l_quantity double", lines))
    keys = [x[0] for x in lines]
    assert sorted(map(tuple, relational.rows_of_repeated_keys(spark, d).collect())) == sorted(x[:4] for x in lines if keys.count(x[0]) > 1)


def test_join_repeated_keys_gives_every_pair(spark, folder):
    left, right = [(1, 11, -5.0), (1, 12, 9500.0), (2, 13, 20.0), (3, 14, 9900.0)], [(1, 21), (1, 22), (2, 23), (2, 24), (4, 25)]
    d = folder(customer=("c_nationkey int, c_custkey bigint, c_acctbal double", left), supplier=("s_nationkey int, s_suppkey bigint", right))
    assert sorted(map(tuple, relational.join_repeated_keys(spark, d).collect())) == sorted((n, c, s) for n, c, _ in left for m, s in right if m == n)


def test_presence_by_day_of_all_events(spark, folder):
    events = [("2024-01-01 10:00:00", 1, "purchase", 200.0), ("2024-01-01 11:00:00", 2, "click", 1.0), ("2024-01-01 12:00:00", 2, "error", None), ("2024-01-03 09:00:00", 1, "purchase", 3.0)]
    d = folder(days=("ts string, user_id bigint, event_type string, value double", events))
    spark.read.parquet(f"{d}/days.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{d}/events.parquet")
    got = {(str(r.day), r.user_id) for r in relational.presence_by_day(spark, d).collect()}
    assert got == {("2024-01-01", 1), ("2024-01-01", 2), ("2024-01-02", None), ("2024-01-03", 1)}


def test_moved_files_takes_every_file_of_the_second_hierarchy(spark, folder):
    lines = [("a/f1.txt", 1, "x"), ("a/f2.txt", 1, "x"), ("b/f2.txt", 1, "x"), ("b/f2.txt", 2, "y"), ("c/f2.txt", 1, "z"), ("a/f3.txt", 1, "12")]
    d = folder(text_lines=("path string, line_no bigint, value string", lines))
    want = [("f1.txt", "a", "new/a")] + [("f2.txt", p, f"new/{q}") for p in "ab" for q in "ab"] + [("f2.txt", "c", "new/c")]
    assert sorted(map(tuple, programs.moved_files(spark, d).collect())) == want


def test_sorts_place_every_line(spark, folder):
    parts = [(i, f"name {i * 7 % 10}", f"Brand#{i % 4}", f"TYPE {i % 3}", i * 13 % 50 % 11) for i in range(1, 61)]
    d = folder(part=("p_partkey bigint, p_name string, p_brand string, p_type string, p_size int", parts))
    placed = lambda df: [tuple(r) for r in df.orderBy("line_no").collect()]
    by_number = sorted((f"{x[4]} {x[1]}" for x in parts), key=lambda v: (int(v.split()[0]), v), reverse=True)
    assert placed(relational.numeric_order(spark, d)) == list(enumerate(by_number, 1))
    by_field = sorted((" ".join(map(str, x[:1] + x[2:4])) for x in parts), key=lambda v: (v[v.index(" ") :], v))
    assert placed(relational.order_from_field(spark, d)) == list(enumerate(by_field, 1))


def test_uniq_shows_long_counts_in_full(spark):
    many = Stream(spark.range(12_345_678).select(F.when(F.col("id") < 12_345_670, "a").otherwise("b").alias("value")), ("value",))
    assert values((uniq(count=True) | sort(reverse=True, numeric=True))(many)) == [["12345670 a", "      8 b"]]


def test_listing_shows_long_sizes_in_full(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("a/long.txt").alias("path"), F.col("id").alias("line_no"), F.repeat(F.lit("x"), 123_456).alias("value"))
    rows.unionAll(spark.sql("SELECT 'a/short.txt', 1L, 'abc'")).write.parquet(f"{tmp_path}/text_lines.parquet")
    assert sorted(r.value for r in programs.listing_totals(spark, str(tmp_path)).collect()) == ["       4 short.txt", "123457000 long.txt", "2 File(s) 123457004 bytes"]


def test_duplicate_documents_shows_long_ids_in_full(spark, folder):
    ids = [1234567890124, 7, 1234567890123, 999999999999, (1 << 63) - 1]
    d = folder(documents=("doc_id bigint, text string", [(i, "same") for i in ids] + [(8, "other")]))
    assert [(r["items"], r.n) for r in text_reports.duplicate_documents(spark, d).collect()] == [(" ".join(f"{i:012d}" for i in sorted(ids)), 5)]


def test_sort_combines_field_number_and_direction(spark):
    run = lambda p, *xs: values(pipeline(spark, p)(literal(spark, *xs)))[0]
    text = ["x 10 a", "y 9 b", "5 9 a", "z 100"]
    for p in ("sort -k 2n", "sort -n -k 2", "sort -k2n", "sort -nk 2"):
        assert run(p, *text) == ["5 9 a", "y 9 b", "x 10 a", "z 100"]
    assert run("sort -r -k 2", *text) == ["y 9 b", "5 9 a", "z 100", "x 10 a"] and run("sort -k 2r", *text) == ["y 9 b", "5 9 a", "z 100", "x 10 a"]
    assert run("sort -rn -k 2", *text) == ["z 100", "x 10 a", "y 9 b", "5 9 a"] and run("sort -k 2nr", *text) == ["z 100", "x 10 a", "5 9 a", "y 9 b"]
    assert run("sort -r -k 2n", *text) == ["y 9 b", "5 9 a", "x 10 a", "z 100"]
    assert run("sort -t , -k 2n", "a,10", "b,9", "c") == ["c", "b,9", "a,10"] and run("sort -k 2n | head -n 1", *text) == ["5 9 a"]


@pytest.mark.parametrize("words", ["-k 2,1", "-k 2.1", "-k x", "-k 0", "-k", "-k 2b", "-k 1 -k 2n", "-f", "+1n", "-t ab -k 2", "-u -k 2", "-un"])
def test_sort_refuses_other_keys(spark, words):
    with pytest.raises(PlanError):
        pipeline(spark, f"sort {words}")


def test_long_lists_of_strings_are_looked_for(spark, monkeypatch):
    monkeypatch.setattr(match, "_BLOCK", 500, raising=False)  # more blocks than a task keeps
    draw = random.Random(7)
    made = lambda n: "".join(draw.choice("abü -") for _ in range(n))
    strings = sorted({made(draw.randint(5, 8)) for _ in range(1500)})
    texts = [made(draw.randint(0, 60)) for _ in range(300)] + ["", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, value string")
    out = match.match_pattern_table(df, "value", spark.createDataFrame([(x,) for x in strings], "p string"), "p")
    want = [i for i, t in enumerate(texts) if t is not None and any(x in t for x in strings)]
    assert len(strings) > 1000 and 0 < len(want) < 300 and sorted(r.line_no for r in out.collect()) == want


def test_words_of_any_script_and_phrases_are_matched(spark):
    text = literal(spark, "Sie ist Über uns", "darüber", "a New York minute", "a new yorker", "a well-known b", "нет слова", "b", "word", "b", None)
    found = values(grep_listed()(literal(spark, "über", "new york", "well-known", "СЛОВА", "b"), text))[0]
    assert found == ["Sie ist Über uns", "a New York minute", "a well-known b", "нет слова", "b", "b"]
    assert values(grep_listed()(literal(spark, "x y z", "y-"), literal(spark, "x y zz", "x y- z", "ax y z")))[0] == ["x y- z"]

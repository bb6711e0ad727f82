import gzip

import pytest
from pyspark.sql import functions as F

from fanloom.sources import files
from fanloom.stream import PlanError
from fanloom.streaming import live
from tests import oracle
from tests.test_records import GOOD


def test_lines_are_numbered_across_splits(spark, tmp_path):
    text = tmp_path / "a.txt"
    text.write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"x\ny"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        s = files.read_lines(spark, str(text), str(tmp_path / "b.txt.gz"))
        rows = s.df.orderBy(*s.order).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.line_no, r.value) for r in rows[:5000]] == [(i + 1, f"line {i}") for i in range(5000)]
    assert [(r.file_no, r.line_no, r.value) for r in rows[5000:]] == [(2, 1, "x"), (2, 2, "y")]
    assert [r.value for r in files.read_lines(spark, str(text), terminator="9\n").df.orderBy("line_no").limit(1).collect()][0].startswith("line 0\nline 1")


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.c").write_bytes(b"abcdefgh")
    (tmp_path / "d" / "b.c").write_bytes(b"abc")
    (tmp_path / "n.txt").write_text("1.5\nx\n-2\n")
    assert files.list_files(spark, str(tmp_path), "*.c").count() == 2
    cut = files.fixed_width(files.read_files(spark, str(tmp_path), "*.c"), 3)
    assert sorted((r.line_no, bytes(r.value)) for r in cut.collect()) == [(1, b"abc"), (1, b"abc"), (2, b"def")]
    assert [(r.i, r.x) for r in files.read_numbers(spark, str(tmp_path / "n.txt")).orderBy("i").collect()] == [(0, 1.5), (1, None), (2, -2.0)]


def test_logs(spark, tmp_path):
    (tmp_path / "x.log").write_text(f"{GOOD}\n{GOOD.replace('1.0', '1.0 x')}\n{GOOD}\n")
    assert [r.reason for r in files.read_log(spark, str(tmp_path / "x.log")).orderBy("line_no").collect()] == [None, "url", None]
    assert [(r.line_no, r.lines, r.reason) for r in files.read_log_files(spark, str(tmp_path / "x.log")).orderBy("line_no").collect()] == [(1, 1, None), (2, 1, "url"), (3, 1, None)]


def test_delimited_and_xml(spark, tmp_path):
    (tmp_path / "x.csv").write_text('1,"a,b",\\N\n2,c,d\n')
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "x.csv"), schema="a int, b string, c string").collect()] == [(1, "a,b", None), (2, "c", "d")]
    (tmp_path / "x.xml").write_text("<all><row><a>1</a></row><row><a>2</a></row></all>")
    assert sorted(r.a for r in files.read_xml_rows(spark, str(tmp_path / "x.xml"), "row", "a int").collect()) == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "value string")
    files.write_to_all(df, [str(tmp_path / "1"), str(tmp_path / "2")])
    files.write_lines(df, str(tmp_path / "1"), append=True)
    assert spark.read.text(str(tmp_path / "1")).count() == 4 and spark.read.text(str(tmp_path / "2")).count() == 2


@pytest.fixture
def feed(spark, tmp_path):
    folder = tmp_path / "feed"
    events = spark.read.parquet(f"{oracle.DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(4).write.parquet(str(folder))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_live_store(spark, feed):
    events, stream = feed
    store = live.LiveStore("latest_type", live.latest(stream, "event_id", "event_type"))
    try:
        assert store.last().collect()[0].event_type == events.orderBy(F.desc("event_id")).first().event_type
        assert store.current_or_empty("event_type").count() == 1
    finally:
        store.stop()


def test_live_windows_match_batch(spark, feed):
    events, stream = feed
    store = live.LiveStore("hours", live.tumbling(stream, "ts", "6 hours", ["event_type"], {"v": F.col("event_id")}))
    try:
        got = {tuple(r) for r in store.last().collect()}
    finally:
        store.stop()
    assert got == {tuple(r) for r in live.tumbling(events, "ts", "6 hours", ["event_type"], {"v": F.col("event_id")}).collect()}


def test_live_last_records(spark, feed):
    events, stream = feed
    store = live.LiveStore("last3", live.last_records(stream, "event_type", "event_id", "user_id", 3, 1), output="update")
    try:
        got = {tuple(r["values"]) for r in store.last().where("event_type = 'click'").collect()}
    finally:
        store.stop()
    want = [str(r.user_id) for r in events.where("event_type = 'click'").orderBy(F.desc("event_id")).limit(3).collect()][::-1][:2]
    assert tuple(want) in got


def test_live_last_span(spark, feed):
    events, stream = feed
    store = live.LiveStore("span", live.last_span(stream, "event_type", "ts", "event_id", 48, 12, "h"), output="update")
    try:
        got = {r.event_type: tuple(r["values"]) for r in store.last().collect()}  # the last state of each type comes last
    finally:
        store.stop()
    for kind, found in got.items():
        rows = [(r.ts, str(r.event_id)) for r in events.where(F.col("event_type") == kind).collect()]
        last = max(t for t, _ in rows)
        hours = lambda t: (last - t).total_seconds() / 3600
        assert found == tuple(v for t, v in sorted(rows) if 12 <= hours(t) < 48), kind
    with pytest.raises(PlanError):
        live.last_span(stream, "event_type", "ts", "event_id", 1, 2)


def test_live_store_in_a_folder(spark, feed, tmp_path):
    events, stream = feed
    folder = str(tmp_path / "values")
    store = live.LiveStore("kept", live.last_records(stream, "event_type", "event_id", "user_id", 1), output="update", folder=folder, keys=("event_type",))
    try:
        assert store.current_or_empty("event_type").count() == 1
        assert store.first(column="event_type").count() > 0
        got = {r.event_type: r["values"] for r in store.last().collect()}
    finally:
        store.stop()
    assert got == {r.event_type: [str(r.u)] for r in events.groupBy("event_type").agg(F.max_by("user_id", "event_id").alias("u")).collect()}
    with pytest.raises(PlanError):
        live.LiveStore("none", live.latest(stream, "event_id", "event_type"), output="update", folder=folder)


def test_first_value_is_waited_for(spark, tmp_path):
    (tmp_path / "empty").mkdir()
    stream = spark.readStream.schema("event_id long, value string").parquet(str(tmp_path / "empty"))
    store = live.LiveStore("never", live.latest(stream, "event_id", "value"))
    try:
        with pytest.raises(TimeoutError):
            store.first(0.3)
        assert store.current_or_empty().collect()[0].value == ""
    finally:
        store.stop()


def test_once_per_id(spark, feed):
    events, stream = feed
    q = live.once_per_id(stream.unionAll(stream), ["event_id"], "ts", "60 days").writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == events.count()
    assert live.once_per_id(events.unionAll(events), ["event_id"], "ts", "1 day").count() == events.count()


def test_observed_counters(spark):
    df, seen = live.monitored(spark.createDataFrame([("ab",), ("c",)], "value string"), "seen")
    df.count()
    assert seen.get == {"nlines": 2, "nbytes": 5}

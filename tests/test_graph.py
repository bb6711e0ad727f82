import pytest
from pyspark.sql import functions as F

from fanloom.arity import ANY, Node, solve
from fanloom.fuse import made_once
from fanloom.graph import Function, block, cat, from_text, order, parallel, perm, run_graph, spread, stage, tee, to_dot
from fanloom.operators.compare import compare_sets
from fanloom.session import SPREAD, spread as spread_rows
from fanloom.store import Stores, last_record, record_window
from fanloom.stream import Bundle, PlanError, Stream, enumerate_channels, gather, group_copy, group_gather, literal, number_lines, permute, repeated, scatter


def values(bundle):
    return [[r.value for r in s.df.orderBy(*s.order).collect()] for s in bundle.streams]


def diamond(takes=2, gives=1):
    """Two inner nodes between one source and one sink, and an edge between the two."""
    return {"s": Node("s", 0, 2), "a": Node("a", 1, gives), "b": Node("b", 2, 1), "t": Node("t", takes, 0)}, [("s", "a"), ("s", "b"), ("a", "b"), ("b", "t")]


def test_solver():
    nodes, edges = diamond(takes=1)
    assert solve(nodes, edges) == [1, 1, 1, 1]
    with pytest.raises(PlanError, match="b"):
        solve(*diamond(takes=2))
    assert solve(*diamond(takes=ANY)) == [1, 1, 1, 1]
    assert solve(*diamond(takes=ANY, gives=ANY)) == [1, 1, 1, 1]
    assert solve({"a": Node("a", 0, 3), "b": Node("b", ANY, 0)}, [("a", "b")]) == [3]
    assert solve({"a": Node("a", 0, ANY), "b": Node("b", 2, 0), "c": Node("c", 3, 0)}, [("a", "b"), ("a", "c")]) == [2, 3]
    assert sorted(solve({"a": Node("a", 0, 4), "b": Node("b", ANY, 0), "c": Node("c", 3, 0)}, [("a", "b"), ("a", "c")])) == [1, 3]
    assert solve({"a": Node("a", 0, 0), "b": Node("b", ANY, 0)}, [("a", "b")]) == [0]
    with pytest.raises(PlanError):
        solve({"a": Node("a", 0, 1), "b": Node("b", 1, 0), "c": Node("c", 1, 0)}, [("a", "b"), ("a", "c")])
    with pytest.raises(PlanError):
        solve({"a": Node("a", 0, 1)}, [])


def test_solver_moves_channels_to_where_they_fit():
    nodes = {"a": Node("a", 0, 3), "b": Node("b", 0, 2), "x": Node("x", 2, 0), "y": Node("y", 3, 0)}
    edges = [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]
    got = solve(nodes, edges)
    assert got[0] + got[1] == 3 and got[2] + got[3] == 2 and got[0] + got[2] == 2 and min(got) >= 1


def test_copies_gathers_and_places(spark):
    b = enumerate_channels(spark, 2)
    assert values(group_copy(b, 6)) == [["0"], ["1"]] * 3
    assert values(group_gather(enumerate_channels(spark, 6), 2)) == [["0", "2", "4"], ["1", "3", "5"]]
    assert values(permute(enumerate_channels(spark, 3), [2, 3, 1])) == [["2"], ["0"], ["1"]]
    assert values(Bundle((gather(b),))) == [["0", "1"]]
    for bad in (lambda: group_copy(b, 3), lambda: group_gather(b, 3), lambda: permute(b, [1, 1]), lambda: gather(Bundle(()))):
        with pytest.raises(PlanError):
            bad()


def test_scatter_gives_each_record_once(spark):
    parts = scatter(Stream(spark.range(1000).withColumnRenamed("id", "line_no").withColumn("value", F.lit("x"))), 7)
    assert sum(s.df.count() for s in parts.streams) == 1000
    assert sorted(r[0] for s in parts.streams for r in s.df.select("line_no").collect()) == list(range(1000))


def test_graph_of_stages(spark):
    upper = Function(lambda s: s.map(lambda df: df.withColumn("value", F.upper("value"))), name="upper")
    label = stage(0, 1, "label")(lambda: literal(spark, "label"))
    g = tee() | block(label, upper, upper | upper) | cat()
    assert values(g(literal(spark, "a", "b"))) == [["label", "A", "B", "A", "B"]]
    assert values(tee()(literal(spark, "x"), n_out=3)) == [["x"]] * 3
    halves = spread(2, ["value"]) | parallel(lambda i: upper, 2) | cat()
    assert sorted(values(halves(literal(spark, *"abcdef")))[0]) == list("ABCDEF")
    assert values((block(label, label) | perm(2, 1) | cat())())[0] == ["label", "label"]
    with pytest.raises(PlanError):
        block(label, label) | perm(1, 2, 3)
    with pytest.raises(PlanError):
        (tee() | block(upper, upper)).run(Bundle(()), 2)


def test_text_graph(spark, tmp_path):
    def compare(args):
        def fn(a, b):
            return [Stream(x, ("value",)) for x in compare_sets(a.df.select("value"), b.df.select("value"))]

        return Function(fn, 2, 3, "comm")

    stages = {"lines": lambda args: stage(0, 1, "lines")(lambda: literal(spark, *args)), "comm": compare, "cat": lambda args: cat()}
    nodes, edges = from_text("1 lines a b b c\n2 lines b c d\n3 comm\n4 cat\n%\npipe 1 3\npipe 2 3\npipe 3 4\n", stages)
    out = run_graph(nodes, edges)["4"][0].df
    assert sorted((r.channel, r.value) for r in out.collect()) == [(1, "a"), (1, "b"), (2, "d"), (3, "b"), (3, "c")]
    assert run_graph(nodes, edges, draw=str(tmp_path / "g.dot")) == {} and '"3" -> "4" [label="3"]' in (tmp_path / "g.dot").read_text()
    dot = to_dot({k: Node(s.name, s.takes, ANY) for k, s in nodes.items()} | {"3": Node("comm", 2, 3)}, edges)
    assert '"3" -> "4" [label="3"]' in dot
    with pytest.raises(PlanError, match="cycle"):
        order(["a", "b"], [("a", "b"), ("b", "a")])
    with pytest.raises(PlanError):
        from_text("1 nothing\n", stages)


def test_stores(spark):
    s = Stores()
    s.write("ratio", lambda: spark.range(1).select((s.value("a") / s.value("b")).alias("value")))
    s.write("a", spark.range(6).agg(F.count("*").alias("value")))
    s.write("b", spark.range(4).agg(F.count("*").alias("value")))
    assert s.read("ratio").collect()[0].value == 1.5
    with pytest.raises(PlanError, match="twice"):
        s.write("a", spark.range(1))
    with pytest.raises(PlanError, match="never"):
        s.read("c")
    s.write("x", lambda: s.read("y"))
    s.write("y", lambda: s.read("x"))
    with pytest.raises(PlanError, match="x -> y -> x"):
        s.read("x")
    assert last_record(literal(spark, "a", "z", "m")).collect()[0].value == "m"
    assert last_record(literal(spark, "a").map(lambda df: df.limit(0))).collect()[0].value == ""


def test_record_windows(spark):
    df = spark.range(1, 11)
    ids = lambda *w: sorted(r.id for r in record_window(df, "id", *w).collect())
    assert ids() == [10] and ids(3, 0) == [8, 9, 10] and ids(5, 3) == [6, 7] and ids(10, 9) == [1] and ids(11, 0) == []
    with pytest.raises(PlanError):
        record_window(df, "id", 2, 2)


def test_scattered_channels_are_one_plan(spark):
    lines = Stream(spark.range(1000).select(F.col("id").alias("line_no"), (F.col("id") % 7).cast("string").alias("value")))
    counted = lambda s, *channel: Stream(s.df.groupBy(*channel, "value").agg(F.count("*").alias("n")), ("value",))
    fused = (spread(4, ["line_no"]) | parallel(Function(counted, name="count", each=counted), 4) | cat())(lines)[0].df
    apart = (spread(4, ["line_no"]) | parallel(lambda i: Function(counted, name=f"count {i}"), 4) | cat())(lines)[0].df
    rows = lambda df: sorted((r.channel, r.value, r.n) for r in df.collect())
    assert rows(fused) == rows(apart) and sum(r[2] for r in rows(fused)) == 1000
    scans = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Range (")
    assert (scans(fused), scans(apart)) == (1, 4)
    clash = Stream(spark.range(20).select(F.col("id").alias("line_no"), F.lit("x").alias("value"), F.lit(1).alias("channel"), F.lit(2).alias("channel_no")))
    assert sorted(set((r.channel, r.channel_no) for r in gather(scatter(clash, 3, ["line_no"])).df.collect())) == [(1, 2), (2, 2), (3, 2)]


def test_numbered_lines(spark):
    many = spark.createDataFrame([("b", 3), ("a", 40_000), ("c", 1), ("z", 0)], "v string, n int")
    out = number_lines(many, [F.desc("v")], copies="n")
    assert out.columns == ["v", "line_no"] and [tuple(r) for r in out.groupBy("v").agg(F.min("line_no"), F.max("line_no"), F.count_distinct("line_no")).orderBy("v").collect()] == [("a", 5, 40_004, 40_000), ("b", 2, 4, 3), ("c", 1, 1, 1)]
    assert number_lines(many.limit(0), ["v"]).count() == 0 and number_lines(many.withColumn("_at", F.lit(1)), ["v"]).columns == ["v", "n", "_at", "line_no"]
    nulls = number_lines(spark.createDataFrame([(None, "x"), ("b", None), (None, "y"), ("a", "z")], "v string, w string"), ["v", F.desc("w")])
    assert [tuple(r) for r in nulls.orderBy("line_no").collect()] == [(None, "y", 1), (None, "x", 2), ("a", "z", 3), ("b", None, 4)]
    one = number_lines(spark.range(500).select(F.lit(1).alias("v")), ["v"])
    assert sorted(r.line_no for r in one.collect()) == list(range(1, 501))
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"), F.lit("x").alias("line"))
    out = number_lines(df, ["v"]).orderBy("line_no").collect()
    assert [r.line_no for r in out] == list(range(1, 1001)) and [r.v for r in out] == sorted(r.v for r in out)


def test_rows_are_spread_where_the_session_asks(spark):
    shuffles = lambda: spread_rows(spark.range(10, numPartitions=1))._jdf.queryExecution().optimizedPlan().toString().count("Repartition")
    assert shuffles() == 1
    spark.conf.set(SPREAD, "false")
    try:
        assert shuffles() == 0
    finally:
        spark.conf.set(SPREAD, "true")


def test_readers_share_what_is_made_once(spark):
    df = made_once(spark.range(100).select("id", (F.col("id") % 7).alias("k"), F.rand().alias("r")), "id")
    both = df.join(df.groupBy("k").agg(F.sum("r").alias("s")), "k").groupBy("k").agg(F.sum("r").alias("r"), F.first("s").alias("s"))
    assert all(abs(x.r - x.s) < 1e-9 for x in both.collect())
    plan = both._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Range (") == 1


def test_rows_are_repeated_in_blocks(spark):
    df = spark.createDataFrame([("a", 5), ("b", 0), ("c", None), (None, 3)], "v string, n int")
    assert sorted(((r.v or "") for r in repeated(df, "n", block=2).collect())) == ["", "", ""] + ["a"] * 5
    assert [r.at for r in repeated(df.where("v = 'a'").withColumn("at", F.lit(10)), "n", "at", 2).orderBy("at").collect()] == [10, 11, 12, 13, 14]

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fanloom.operators.sessions import NO_GAP, activity, cartesian_tree, gap_tree, sessions, sessions_at


def brute(rows, allowed):
    """Sessions by one walk over each entity's sorted events."""
    found, by = set(), {}
    for entity, tick, ident in {r for r in rows if r[0] is not None and r[1] is not None}:
        by.setdefault(entity, []).append(tick)
    for entity, ticks in by.items():
        ticks.sort()
        begun, last, n = ticks[0], ticks[0], 0
        for t in ticks:
            if t - last > allowed:
                found.add((entity, begun, last, n))
                begun, n = t, 0
            last, n = t, n + 1
        found.add((entity, begun, last, n))
    return found


def table(spark, rows):
    return spark.createDataFrame(rows, "entity string, tick long, id long")


def found(df):
    return {tuple(r) for r in df.select("entity", "start", "end", "events").collect()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [("hot", rng.randrange(4000), i) for i in range(1500)]
    out += [(f"e{rng.randrange(60)}", rng.randrange(-300, 3000), 10_000 + i) for i in range(800)]
    out += out[:200]  # delivered again
    return out + [(None, 5, 1), ("x", None, 2), ("lone", 7, 3), ("", 1, 4), ("", 2, 5)]


@pytest.mark.parametrize("chunk, span", [(1, 3), (7, 4), (100, 2), (10**6, 1024), (None, 1024)])
@pytest.mark.parametrize("allowed", [0, 1, 5, 40, 10**6])
def test_sessions_match_a_walk(spark, small_batches, rows, chunk, span, allowed):
    df = sessions(table(spark, rows), F.col("entity"), F.col("tick"), allowed, [F.col("id")], chunk, span)
    assert found(df) == brute(rows, allowed)


@pytest.mark.parametrize("chunk, span", [(3, 5), (50, 1024)])
def test_one_tree_serves_all_settings(spark, small_batches, rows, chunk, span):
    nodes = gap_tree(activity(table(spark, rows), F.col("entity"), F.col("tick"), [F.col("id")], chunk), None, chunk, span).persist()
    for allowed in (0, 1, 2, 3, 8, 25, 200, 10**7):
        assert found(sessions_at(nodes, allowed)) == brute(rows, allowed), allowed
    n = nodes.groupBy("entity", "start", "end").count()
    assert n.where("count > 1").count() == 0


def test_a_burst_of_one_entity_is_spread(spark):
    """A third of all rows in one minute of one entity: no task counts more than its share of them."""
    log = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("e"), F.col("id").cast("string"))).alias("e"), (F.col("id") % 1 + 7).alias("t"), "id")
    once = activity(log, F.col("e"), F.col("t"), [F.col("id")])
    shuffles = [x for x in once._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]
    assert len(shuffles) == 2 and "xxhash64(id0#" in shuffles[1]
    by_part = log.where("e = 'hot'").groupBy(F.pmod(F.xxhash64("id"), F.lit(4))).count().collect()
    assert len(by_part) == 4 and max(r["count"] for r in by_part) < 3000
    assert [tuple(r) for r in sessions(log, F.col("e"), F.col("t"), 30, [F.col("id")]).where("entity = 'hot'").collect()] == [("hot", 7, 7, 10_000, 0)]


def test_duration_and_missing_ids(spark):
    df = sessions(spark.createDataFrame([("a", 1), ("a", 1), ("a", 4), ("a", 99)], "entity string, tick long"), F.col("entity"), F.col("tick"), 3)
    assert {tuple(r) for r in df.select("start", "end", "duration", "events").collect()} == {(1, 4, 3, 3), (99, 99, 0, 1)}


def test_empty_and_clashing_columns(spark):
    empty = table(spark, [])
    assert sessions(empty, F.col("entity"), F.col("tick"), 3, [F.col("id")]).count() == 0
    assert gap_tree(activity(empty, F.col("entity"), F.col("tick"), [F.col("id")])).count() == 0
    clash = spark.createDataFrame([("a", 1, 1, 9, 9, 9)], "who string, at long, id0 long, entity long, tick long, chunk long")
    assert found(sessions(clash, F.col("who"), F.col("at"), 3, [F.col("id0")])) == {("a", 1, 1, 1)}


def test_tree_of_equal_gaps_is_one_node():
    at, left, right, tied = cartesian_tree(np.array([NO_GAP, 5, 3, 5, NO_GAP]))
    nodes = {(int(a), int(b), int(c)) for a, b, c in zip(at, left, right)}
    assert nodes == {(2, 1, 3), (1, 0, 4)} and tied.tolist() == [[3, 1]]

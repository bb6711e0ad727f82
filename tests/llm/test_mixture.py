import pytest
from pyspark.sql import functions as F

from fanloom.llm.bpe import encoder
from fanloom.llm.mixture import copies, measured, mixture, rates, reached
from fanloom.llm.queries import QUERIES
from tests import oracle


@pytest.fixture(scope="module")
def made(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "big").when(F.col("id") % 10 < 9, "mid").otherwise("small").alias("source"), (F.col("id") % 5 + 1).alias("tokens"))
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.2, 4), ("small", 0.1, 2), ("none", 0.0, 2), (None, 0.5, 9), ("gone", 0.1, None)], "source string, target_share double, max_repeats int")
    return docs, targets


def test_rates(made):
    docs, targets = made
    plan = {r.source: r for r in rates(docs, targets).collect()}
    assert set(plan) == {"big", "mid", "small", "none", "gone"}
    size = sum(i % 5 + 1 for i in range(20000))
    assert all(r["size"] == size for r in plan.values())
    assert abs(plan["mid"].rate - 0.3 * size / plan["mid"].tokens) < 1e-12 and plan["small"].max_repeats == 4
    assert [plan[s].falls_short for s in ("big", "mid", "small", "none", "gone")] == [False, False, False, False, True]


def test_shares_are_reached_and_caps_kept(spark, made):
    docs, targets = made
    plan = rates(docs, targets)
    for r in reached(docs, plan).collect():
        if not r.falls_short and r.target_share:
            assert abs(r.mixed_share / r.target_share - 1) < 0.15
    uses = mixture(docs, plan)
    per = uses.groupBy("source", "doc_id").agg(F.count("*").alias("n"), F.max("use").alias("u"))
    caps = per.join(plan, "source")
    assert caps.where("n > max_repeats OR n <> u").count() == 0
    assert uses.exceptAll(mixture(docs, plan)).count() == 0  # the same again
    assert copies(docs, plan, 1).exceptAll(copies(docs, plan, 2)).count() > 0  # another seed


def test_capped_source(spark):
    docs = spark.createDataFrame([(i, "a", 10) for i in range(90)] + [(100 + i, "b", 10) for i in range(10)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3)], "source string, target_share double, max_repeats int")
    plan = {r.source: r for r in reached(docs, rates(docs, targets)).collect()}
    assert plan["b"].falls_short and plan["b"].mixed_tokens == 300 and plan["b"].rate == 3.0
    assert not plan["a"].falls_short


def test_empty_tables_and_clashing_names(spark, made):
    docs, targets = made
    assert [(r.rate, r.falls_short) for r in rates(docs.limit(0), targets.where("source = 'big'")).collect()] == [(0.0, False)]
    assert rates(docs, targets.limit(0)).count() == 0
    assert mixture(docs, rates(docs, targets.limit(0))).count() == 0
    assert {r.mixed_share for r in reached(docs.limit(0), rates(docs.limit(0), targets)).collect()} == {0.0}
    odd = spark.createDataFrame([(None, "big", "text", 5, 5), (1, None, None, 5, 5)], "doc_id long, source string, text string, tokens long, rate long")
    clash = docs.withColumns({c: F.lit(0) for c in ("rate", "copies", "use")})
    assert mixture(clash, rates(docs, targets)).columns[-1] == "use_1" and mixture(clash, rates(docs, targets)).count() == mixture(docs, rates(docs, targets)).count()
    assert [tuple(r) for r in measured(odd).collect()] == [(None, "big", 1), (1, None, 0)]


def test_query(spark):
    bpe, held = encoder(), {}
    targets = spark.read.parquet(f"{oracle.DATA}/mix_targets.parquet").collect()
    wanted = {t.source for t in targets}
    for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect():
        if r.source in wanted:
            held[r.source] = held.get(r.source, 0) + bpe.count(r.text)
    size = sum(held.values())
    want = {t.source for t in targets if t.max_repeats * held.get(t.source, 0) < t.target_share * size}
    assert {r.source for r in QUERIES["p8_found"](spark, oracle.DATA).collect()} == want and want
    assert QUERIES["p8_shares"](spark, oracle.DATA).count() == len(targets)
    plan = {r.source: r for r in QUERIES["p8_shares"](spark, oracle.DATA).collect()}
    uses = {(r.source, r.doc_id): r["count"] for r in QUERIES["p8_mixture"](spark, oracle.DATA).groupBy("source", "doc_id").count().collect()}
    docs = [r for r in spark.read.parquet(f"{oracle.DATA}/documents.parquet").collect() if r.source in wanted]
    for r in docs:
        assert uses.get((r.source, r.doc_id), 0) - int(plan[r.source].rate) in (0, 1) and uses.get((r.source, r.doc_id), 0) <= plan[r.source].max_repeats
    for source, p in plan.items():
        assert p.mixed_tokens == sum(bpe.count(r.text) * uses.get((source, r.doc_id), 0) for r in docs if r.source == source)
    assert set(uses) <= {(r.source, r.doc_id) for r in docs} and all(r.reached for r in QUERIES["p8_reached"](spark, oracle.DATA).collect())


def test_one_source_is_spread(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("only").alias("source"), F.lit(2).cast("long").alias("tokens"))
    targets = spark.createDataFrame([("only", 0.5, 1)], "source string, target_share double, max_repeats int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = copies(docs, rates(docs, targets)).withColumn("at", F.spark_partition_id())
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        sizes = [r["count"] for r in made.groupBy("at").count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 5000 and len(sizes) == 4 and max(sizes) < 2500

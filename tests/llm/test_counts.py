import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fanloom.llm import distinct, frequency, heavy, queries
from tests import oracle


@pytest.fixture(scope="module")
def con():
    return oracle.connection()


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_matches_sql(spark, con, name):
    oracle.same(queries.QUERIES[name](spark, oracle.DATA), con, queries.ORACLE[name])


def test_word_frequencies(spark, small_batches):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "The", "a b", "x\u000by", "é", "é", f"w{rng.randrange(200)}"]) for _ in range(rng.randrange(9))) for _ in range(150)]
    texts += [None, "", " \t\r\n\f ", "a", "the\tthe\r\fthe"]
    rows = [("p", i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:40] + [(None, None, "nul nul", "x")] * 2, "path string, line_no long, value string, term string")
    out, n = frequency.word_frequencies(df, "value", ["path", "line_no"])
    got = {r.term: (r.occurrences, r.records) for r in out.collect()}
    import re

    split = [[w for w in re.split("[ \t\n\r\f]+", t or "") if w] for t in [*texts, "nul nul"]]
    occurrences, records = Counter(w for ws in split for w in ws), Counter(w for ws in split for w in set(ws))
    assert got == {w: (occurrences[w], records[w]) for w in occurrences}
    assert out.agg(F.count_distinct("term_id")).collect()[0][0] == len(got)
    marks = {r.term: r.mark for r in frequency.marked(out, n, F.col("records") <= 2, 0.2).collect()}
    assert marks == {w: "rare" if records[w] <= 2 else "common" if records[w] > 0.2 * len(split) else None for w in occurrences}
    empty, n = frequency.word_frequencies(df.limit(0), "value", ["path", "line_no"])
    assert frequency.marked(empty, n, F.col("records") <= 2, 0.2).count() == 0


def test_blocks_are_bounded_and_add_up(spark, small_batches):
    df = spark.createDataFrame([(f"a{i % 37} hot b{i}",) for i in range(400)], "t string").coalesce(1)
    blocks = frequency.words_by_block(df, "t", most_terms=20)
    assert blocks.where("term = 'hot'").count() > 5
    for places in (1 << 16, 1):
        total = frequency.sum_by_range(frequency.encoded(blocks), places)
        assert {r.term: r.occurrences for r in total.collect()}["hot"] == 400 and total.count() == 37 + 400 + 1


def test_ranges_of_many_terms_are_summed_in_bounded_arrays(spark, small_batches, monkeypatch):
    """All terms in two ranges, with arrays of 16 places."""
    monkeypatch.setattr(frequency, "RANGES", 2)
    df = spark.createDataFrame([(f"a{i % 37} hot b{i % 300}",) for i in range(900)], "t string").repartition(3)
    got = frequency.sum_by_range(frequency.encoded(frequency.words_by_block(df, "t", most_terms=20)), 16).collect()
    want = Counter(w for i in range(900) for w in (f"a{i % 37}", "hot", f"b{i % 300}"))
    assert {r.term: (r.occurrences, r.records) for r in got} == {w: (c, c) for w, c in want.items()} and len({r.term_id for r in got}) == len(want)


def test_identifiers_last(spark, small_batches):
    """The same whatever the number of partitions and blocks; terms of an earlier dictionary keep theirs."""
    texts = [f"t{i} t{i % 7} é" for i in range(200)]
    blocks = lambda xs, n: frequency.words_by_block(spark.createDataFrame([(x,) for x in xs], "t string").repartition(n), "t", 20)
    ids = lambda df: {r.term: r.term_id for r in df.collect()}
    first = ids(frequency.dictionary(blocks(texts, 3)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert ids(frequency.dictionary(blocks(texts, 1))) == first and len(set(first.values())) == len(first) == 201
        known = spark.createDataFrame(list(first.items()), "term string, term_id long")
        more = [f"n{i} t{i}" for i in range(5000)] + ["a"]
        extended = ids(frequency.dictionary(blocks(more, 2), known))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {t: extended[t] for t in first} == first and len(set(extended.values())) == len(extended) == len({*first, *" ".join(more).split()})
    again = frequency.sum_by_range(frequency.encoded(blocks(["t1 t1 new"], 1), known)).where("occurrences > 0")
    assert {r.term: (r.occurrences, r.term_id == first.get(r.term)) for r in again.collect()} == {"t1": (2, True), "new": (1, False)}


def test_key_frequencies(spark):
    rows = [(1, 1, 5, " k\t"), (1, 1, 5, " k\t"), (1, 2, 1, "k\r"), (2, 1, 2, "k"), (3, 1, None, "k"), (3, 2, 0, "k"), (3, 3, -1, "k"), (4, 1, 9, None), (5, 1, 9, "  "), (6, 1, 1, "a b"), (None, None, 2, "K")]
    df = spark.createDataFrame(rows, "channel int, seq long, value long, key string")
    clash = df.select("channel", F.col("seq").alias("weight"), "value", "key", F.lit(1).alias("term"))
    again, _ = frequency.key_frequencies(clash, F.btrim("key", F.lit(" \t\r")), F.col("value"), "channel", ["channel", "weight"])
    got = {r.term: (r.occurrences, r.records, r.mark) for r in frequency.merged_keys(df).collect()}
    assert {r.term: (r.occurrences, r.records) for r in again.collect()} == {k: v[:2] for k, v in got.items()}
    assert got == {"k": (8, 2, None), "a b": (1, 1, "rare"), "K": (2, 1, "rare")}


def test_sketch_bounds_hold(spark, small_batches):
    rng = random.Random(2)
    items = ["hot"] * 3000 + [f"w{int(rng.paretovariate(0.7))}" for _ in range(6000)] + [None] * 50
    rng.shuffle(items)
    df = spark.createDataFrame([(x, x, 1) for x in items], "f string, field string, total long").repartition(5)
    counts = Counter(x for x in items if x)
    cells = heavy.sketch(df, ["f"])
    assert cells.where("row = 0").agg(F.sum("total")).collect()[0][0] == 9000
    rows = heavy.candidates(cells).collect()
    assert all(r.at_least <= counts[r["item"]] <= r.at_most and r.n == 9000 for r in rows)
    for share in (0.2, 0.01, 0.003):
        want = {x for x, c in counts.items() if c >= share * 9000}
        found = heavy.frequent(df, ["f"], share)
        assert want <= {r["item"] for r in found.collect()}
        exact = {r["item"]: r["count"] for r in heavy.frequent_exactly(df, ["f"], share).collect()}
        assert exact == {x: counts[x] for x in want}


def test_items_hidden_by_others_are_found(spark):
    """Two cells a row for ten items of a tenth each."""
    df = spark.createDataFrame([(f"w{i % 10}", f"v{i % 7}" if i % 2 else None) for i in range(1000)], "f string, g string")
    assert heavy.frequent(df, ["f"], 0.1, bits=1).count() < 10
    exact = heavy.frequent_exactly(df, ["f", "g"], 0.1, bits=1).collect()
    assert sorted((r.field, r["item"], r["count"]) for r in exact) == sorted([("f", f"w{i}", 100) for i in range(10)] + [("g", f"v{i}", sum(1 for k in range(1, 1000, 2) if k % 7 == i)) for i in range(7)])
    assert heavy.frequent_exactly(df.limit(0), ["f"], 0.1).count() == 0


def test_sketches_of_parts_merge(spark):
    df = spark.createDataFrame([(f"w{i % 50 if i % 3 else 0}",) for i in range(3000)], "f string")
    whole = heavy.candidates(heavy.sketch(df, ["f"]))
    parts = heavy.candidates(heavy.merge(heavy.sketch(df.where("hash(f) % 2 = 0"), ["f"]).unionByName(heavy.sketch(df.where("hash(f) % 2 <> 0"), ["f"]))))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()}
    assert heavy.frequent(df.limit(0), ["f"], 0.1).count() == 0
    assert heavy.frequent(spark.createDataFrame([(None,)], "f string"), ["f"], 0.1).count() == 0


def test_cells_need_bits_of_one_hash(spark):
    for bits in (0, 17):
        with pytest.raises(ValueError):
            heavy.sketch(spark.createDataFrame([("a",)], "f string"), ["f"], bits)


def test_distinct_counts(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"u{rng.randrange(40)}", rng.choice(["d1", "d2", None]), rng.choice("abc"), 1) for i in range(2000)] + [(None, "d1", "a", 1)]
    df = spark.createDataFrame(rows, "u string, d string, a string, bucket int")
    sets = [(), ("d",), ("d", "a")]
    got = {(r.in_set, r.d, r.a): r.n for r in distinct.distinct_counts(df, F.col("u"), {"d": F.col("d"), "a": F.col("a")}, sets).collect()}
    real = [r for r in rows if r[0]]
    want = {(0, None, None): len({r[0] for r in real})}
    want |= {(1, d, None): len({r[0] for r in real if r[1] == d}) for d in ("d1", "d2", None)}
    want |= {(2, d, a): len({r[0] for r in real if r[1:3] == (d, a)}) for d in ("d1", "d2", None) for a in "abc"}
    assert got == want
    assert distinct.distinct_counts(df.limit(0), F.col("u"), {"d": F.col("d")}, [("d",)]).count() == 0


def test_bucket_counts_of_other_buckets_add_up(spark):
    df = spark.range(500).select((F.col("id") % 97).cast("string").alias("u"))
    counts = distinct.bucket_counts(df, F.col("u"), {}, [()], buckets=8)
    assert counts.count() > 4
    halves = counts.where("bucket < 4").unionByName(counts.where("bucket >= 4"))
    assert distinct.add_buckets(halves, []).collect()[0].n == 97
    odd = distinct.distinct_counts(df, F.col("u"), {"n": F.col("u"), "bucket": F.lit(1)}, [("n",), ("bucket",)])
    assert odd.columns == ["in_set", "n", "bucket", "n_1"] and odd.where("in_set = 1").collect()[0].n_1 == 97

import difflib
import random

import pytest
from pyspark.sql import functions as F

from fanloom.functions import scalar
from fanloom.fuse import keeping, shared
from fanloom.graph import Function, block, tee
from fanloom.operators import compare, match, ordered, project, totals
from fanloom.operators.monitor import as_json, monitor
from fanloom.stream import PlanError, Stream


def text(spark, *lines):
    return spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, value string")


def test_multiset_comparison(spark):
    a, b = [None, "", "x", "x", "x", "y"], [None, None, "x", "z"]
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    got = [sorted((r.v or repr(r.v)) for r in df.collect()) for df in compare.compare_sets(one(a), one(b))]
    assert got == [sorted(["''", "x", "x", "y"]), ["None", "z"], ["None", "x"]]
    assert compare.compare_sets(one(["x"] * 20_000 + ["y"] * 16_384), one(["x"] * 2 + ["z"]))[0].groupBy("v").count().orderBy("v").collect() == [("x", 19_998), ("y", 16_384)]
    assert tuple(compare.compare_counts(one(a), one(b)).collect()[0]) == (4, 2, 2)
    assert tuple(compare.compare_counts(one([]), one([])).collect()[0]) == (0, 0, 0)
    assert [df.count() for df in compare.compare_sets(one(a), one(b), distinct=True)] == [2, 1, 2]
    with pytest.raises(PlanError):
        compare.compare_sets(one(a), one(b).withColumnRenamed("v", "w"))
    assert [r.value for r in compare.with_tabs((text(spark, "a"),) * 3)[2].collect()] == ["\t\ta"]


def test_join_multiplies_and_renames(spark):
    l = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "k long, v string")
    r = spark.createDataFrame([(1, "x"), (1, "y"), (None, "m")], "k2 long, V string")
    out = compare.join_fields(l, r, "k", "k2")
    assert out.columns == ["key", "v", "V_2"] and out.count() == 4


def test_paste_pads(spark):
    out = compare.paste([text(spark, "a", "b", "c"), text(spark, "1"), text(spark, "x", None)])
    assert [r.value for r in out.orderBy("line_no").collect()] == ["a\t1\tx", "b\t\t", "c\t\t"]


def test_first_difference(spark):
    a = text(spark, "a", None, "c")
    assert tuple(compare.first_difference(a, a).collect()[0]) == (True, None)
    assert tuple(compare.first_difference(a, text(spark, "a", "", "c")).collect()[0]) == (False, 2)
    assert tuple(compare.first_difference(a, text(spark, "a", None, "c", "d")).collect()[0]) == (False, 4)


def test_edit_scripts(spark):
    old, new = ["", "1", "2", "x"], ["1", "2", "3", "x", "y"]
    assert list(compare.edit_script(["a"], ["a", "b"])) == ["1a2", "> b"]
    assert list(compare.edit_script(["0"], [])) == ["1d0", "< 0"]
    assert list(compare.edit_script(["", "1"], ["\t", "1 3"])) == ["1,2c1,2", "< ", "< 1", "---", "> \t", "> 1 3"]
    got = [r.value for r in compare.diff(text(spark, *old), text(spark, *new)).orderBy("line_no").collect()]
    assert got == ["1d0", "< ", "3a3", "> 3", "4a5", "> y"]
    assert compare.diff(text(spark, "a"), text(spark, "a")).count() == 0
    assert len(compare.diff_from(text(spark, "a"), [text(spark, "a"), text(spark, "b")])) == 2
    assert list(compare.merge_script(["a", "c"], ["b"], ["c"]))[:4] == ["====", "1:1,2c", "  a", "  c"]
    assert list(compare.merge_script(["a", "x"], ["a", "b"], ["a", "b"])) == ["====1", "1:2c", "  x", "2:2c", "3:2c", "  b"]


def test_edit_scripts_of_pieces_rebuild(spark):
    """Cut at anchors, at every few lines where there are none, and within groups: the script always gives the right side back."""
    rng = random.Random(9)
    alike = ["x"] * 40
    pairs = [([f"l{i}" for i in range(60)], [f"l{i}" for i in range(60) if i % 7] + ["new"]), (alike, alike[:25] + ["y"]), ([], ["a", "b"]), (["a", "b"], []), ([f"l{i}" for i in range(30)], [f"l{i}" for i in range(29, -1, -1)])]
    pairs += [([rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(50)], [rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(45)])]
    rows = lambda k: spark.createDataFrame([(g, n, v) for g, p in enumerate(pairs) for n, v in enumerate(p[k], 1)], "g int, line_no long, value string")
    scripts = compare.diff_by_group(rows(0), rows(1), "g", most=8, spacing=4, chunk=16)
    found = {}
    for r in scripts.orderBy("g", "line_no").collect():
        found.setdefault(r.g, []).append((r.line_no, r.value))
    for g, (a, b) in enumerate(pairs):
        got = found.get(g, [])
        assert [n for n, _ in got] == list(range(1, len(got) + 1))
        out, at = [], 0
        for v in [v for _, v in got]:
            if v[0] in "<>-":
                if v[0] == ">":
                    out.append(v[2:])
                continue
            left, op, _ = v.partition(next(c for c in v if c in "acd"))
            lo, _, hi = left.partition(",")
            stop = int(lo) if op == "a" else int(lo) - 1
            out += a[at:stop]
            at = stop if op == "a" else int(hi or lo)
        assert out + a[at:] == b, g
    for g in (0, 3):
        side = lambda k: rows(k).where(F.col("g") == g).drop("g")
        script = compare.diff(side(0), side(1), most=8, spacing=4, chunk=16)
        assert [r.value for r in compare.patched(side(0), script).orderBy("line_no").collect()] == pairs[g][1]
    merged = compare.diff3(*[rows(0).where("g = 0").drop("g") if i == 1 else rows(1).where("g = 0").drop("g") for i in range(3)], most=8, spacing=4, chunk=16)
    assert {r.value[:5] for r in merged.where("value LIKE '===%'").collect()} == {"====2"}


def test_edit_script_rebuilds(spark):
    rng = random.Random(2)
    for _ in range(50):
        a, b = [rng.choice("abc") for _ in range(rng.randrange(12))], [rng.choice("abc") for _ in range(rng.randrange(12))]
        out = list(compare.edit_script(a, b))
        assert sum(s.startswith("<") for s in out) - sum(s.startswith(">") for s in out) == len(a) - len(b)
        assert bool(out) == (a != b)
    assert difflib


def test_order_dependent_operators_across_chunks(spark):
    rng = random.Random(3)
    rows = [(i * 3, rng.choice("ab") if rng.random() < 0.8 else None, rng.choice("xy")) for i in range(400)]
    df = spark.createDataFrame(rows, "n long, v string, k string")
    for chunk in (1, 17, 1 << 20):
        prev = {r.n: (r.p, r.has_p) for r in ordered.previous(df, "n", "v", (), "p", chunk).collect()}
        assert prev == {rows[i][0]: (rows[i - 1][1] if i else None, i > 0) for i in range(400)}
        by = {r.n: r.p for r in ordered.previous(df, "n", "v", ("k",), "p", chunk).collect()}
        last = {}
        for n, v, k in rows:
            assert by[n] == last.get(k)
            last[k] = v
        runs = [(r.v, r.length, r.first) for r in ordered.run_lengths(df, "n", "v", chunk=chunk).orderBy("run").collect()]
        want = []
        for n, v, _ in rows:
            if want and want[-1][0] == v:
                want[-1] = (v, want[-1][1] + 1, want[-1][2])
            else:
                want.append((v, 1, n))
        assert runs == want and ordered.squeeze(df, "n", "v", chunk=chunk).count() == len(want)
        sums = {r.n: r.s for r in ordered.running(df, "n", {"s": F.col("n")}, (), False, chunk).collect()}
        assert sums == {rows[i][0]: sum(x[0] for x in rows[:i]) for i in range(400)}
    assert ordered.run_lengths(df.limit(0), "n", "v").count() == 0


def test_pattern_range(spark):
    rng = random.Random(8)
    marks = [rng.choice("se.....") for _ in range(300)]
    df = spark.createDataFrame([(i * 2, m, "k") for i, m in enumerate(marks)], "n long, v string, k string")
    want, inside = [], False
    for i, m in enumerate(marks):
        if not inside and m == "s":
            inside = True
            want.append(i * 2)
        elif inside:
            want.append(i * 2)
            inside = m != "e"
    for chunk in (1, 13, 1 << 20):
        for by in ((), ("k",)):
            assert sorted(r.n for r in ordered.pattern_range(df, "n", F.col("v") == "s", F.col("v") == "e", by, chunk).collect()) == want
    assert ordered.pattern_range(df.limit(0), "n", F.col("v") == "s", F.col("v") == "e").count() == 0


def test_context(spark):
    df = text(spark, *["x" if i in (1, 10, 11) else "-" for i in range(1, 16)])
    for chunk in (2, 5, 1 << 20):
        out = ordered.context(df, "line_no", F.col("value") == "x", 1, 2, chunk=chunk)
        assert sorted((r.line_no, r.matched) for r in out.collect()) == [(1, True), (2, False), (3, False), (9, False), (10, True), (11, True), (12, False), (13, False)]


def test_sorts_and_tops(spark):
    df = text(spark, "10 b", "9 a", "x", "10 a", " 2", "-1")
    assert [r.value for r in df.orderBy(*ordered.sort_numeric("value")).collect()] == ["-1", "x", " 2", "9 a", "10 a", "10 b"]
    assert [r.value for r in df.orderBy(*ordered.sort_numeric("value", True)).limit(2).collect()] == ["10 b", "10 a"]
    keyed = text(spark, "z 1 b", "a 1 a", "m 0")
    assert [r.value for r in keyed.orderBy(*ordered.sort_from_field("value", 2)).collect()] == ["m 0", "a 1 a", "z 1 b"]
    assert [r.value for r in text(spark, "b,2", "a,1").orderBy(*ordered.sort_from_field("value", 2, ",")).collect()] == ["a,1", "b,2"]
    tops = ordered.top_k(text(spark, *"abbcc"), F.col("value"), 2)
    assert [tuple(r) for r in tops.collect()] == [("c", 2), ("b", 2)]
    assert [r.line_no for r in ordered.tail(df, ["line_no"], 2).collect()] == [6, 5]


def test_matching(spark):
    df = spark.createDataFrame([("f", "a cat"), ("f", "concat"), ("g", "Cat."), ("h", None), ("h", "a.c")], "file string, value string")
    n = lambda *a, **k: df.where(match.matches(F.col("value"), *a, **k)).count()
    assert (n("cat"), n("cat", whole_word=True), n("CAT", ignore_case=True), n("a.c", fixed=True), n("cat", inverted=True), n("a.c", fixed=True, whole_word=True)) == (2, 1, 3, 1, 2, 1)
    hit = match.matches(F.col("value"), "cat")
    out = match.multi_match(df, "file", hit, ["other_files", "count", "matching_lines", "files"])
    assert sorted(r.file for r in out[0].collect()) == ["g", "h"] and {tuple(r) for r in out[1].collect()} == {("f", 2), ("g", 0), ("h", 0)} and out[2].count() == 2 and [r.file for r in out[3].collect()] == ["f"]
    for bad in (["count", "count"], ["only"]):
        with pytest.raises(PlanError):
            match.multi_match(df, "file", hit, bad)
    patterns = spark.createDataFrame([("CAT",), ("",), (None,)], "p string")
    assert match.match_pattern_table(df, "value", patterns, "p", word=True).count() == 2
    twice = df.unionAll(df)
    assert match.match_pattern_table(twice, "value", patterns.unionAll(spark.createDataFrame([("a",)], "p string")), "p", word=True).count() == 6
    assert match.match_pattern_table(df, "value", patterns.select(F.lower("p").alias("p")), "p").count() == 2
    assert [r.value for r in match.only_matching(text(spark, "a1b22", None), "value", "[0-9]+").collect()] == ["1", "22"]
    assert {r.file for r in match.files_with(df, "file", hit, matching=False).collect()} == {"g", "h"}


def test_projections(spark):
    df = text(spark, "  a b\tc ", "", None, "x,\"y,z\",w")
    rows = df.select(project.blank_fields(F.col("value")).alias("f"), project.cut(F.col("value"), ",", [(2, 3)]).alias("c"), project.reorder(F.col("value"), ",", [(3, 3), (1, 1)]).alias("r")).collect()
    assert rows[0].f == ["a", "b", "c"] and rows[1].f == [] and rows[2].f is None
    assert rows[3].c == '"y,z"' and rows[3].r == 'z",x' and rows[0].c == "  a b\tc "
    one = lambda c: text(spark, "abba").select(c).collect()[0][0]
    v = F.col("value")
    assert one(project.ngrams(v, 3)) == ["abb", "bba"] and one(project.ngrams(v, 5)) == [] and one(project.characters(v)) == list("abba")
    assert one(project.palindrome_note(v)) == "p: ab-ba" and one(project.palindrome_note(F.lit("abc"))) == ""
    assert one(project.consonant_note(F.lit("abcdfgha"))) == "c: dfgh" and one(project.length_note(F.lit("a" * 13))) == "l: 13"
    assert one(project.number(F.lit("-"))) == 0 and one(project.number(F.lit(" 12x"))) == 12
    assert one(project.blank_words(F.lit("a b\f c"))) == ["a b", "c"]


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(scalar.base_name(F.lit("a/b/c.x"))) == "c.x" and one(scalar.dir_name(F.lit("a/b/c"))) == "a/b" and one(scalar.dir_name(F.lit("c"))) == ""
    assert one(scalar.replace_first(F.lit("a.b.c"), "[.]", "-")) == "a-b.c" and one(scalar.replace_first(F.lit("abc"), "x", "-")) == "abc"
    assert one(scalar.parent_domain(F.lit("a.b.c"))) == ".b.c" and one(scalar.parent_domain(F.lit("a"))) == "" and one(scalar.top_level(F.lit("a.b"))) == "b"
    assert one(scalar.ascii_lower(F.lit("ÀB"))) == "Àb" and one(scalar.percent_decode(F.lit("a%20+b"))) == "a +b" and one(scalar.day_number(F.lit(-1))) == -1
    assert one(scalar.strip_comments(F.lit('a = "/*x*/"; /* b\n */ c // d'))).split() == ["a", "=", '"";', "c"]
    xs = [complex(i * i % 5, i) for i in range(8)]
    ys = spark.range(1).select(*scalar.inverse_transform([scalar.complex_number(F.lit(x.real), F.lit(x.imag)) for x in xs])).collect()[0]
    import cmath

    for k, y in enumerate(ys):
        want = sum(x * cmath.exp(2j * cmath.pi * i * k / 8) for i, x in enumerate(xs))
        assert abs(complex(y.re, y.im) - want) < 1e-9
    with pytest.raises(ValueError):
        scalar.inverse_transform([F.lit(1)] * 3)


@pytest.mark.parametrize("channels, want", [
    ([["1 a", "2 d"], ["4 c", "8 z"]], {"a": 1, "c": 4, "d": 2, "z": 8}),
    ([["1 a", "5 b", "2 d"], ["5 b", "4 c"], []], {"a": 1, "b": 10, "c": 4, "d": 2}),
    ([[" 1 a d f", "2\td"], ["\t4 c", "nothing", "x y"]], {"a d f": 1, "c": 4, "d": 2}),
])
def test_merge_sum(spark, channels, want):
    df = spark.createDataFrame([(s,) for c in channels for s in c], "line string")
    n, key = totals.parse_partial(F.col("line"))
    assert {r.key: r.value for r in totals.merge_sum(df.select(key.alias("key"), n.alias("value")).where("key IS NOT NULL")).collect()} == want


def test_totals(spark):
    df = text(spark, "ab", None, "é")
    assert tuple(df.agg(totals.byte_size(F.col("value")), totals.guarded_average(F.length("value"))).collect()[0]) == (7, 1.5)
    assert tuple(df.limit(0).agg(totals.byte_size(F.col("value")), totals.guarded_average(F.length("value"))).collect()[0]) == (0, 0.0)
    same = totals.same_content(spark.createDataFrame([("a", "x"), ("c", "x"), ("b", "y")], "path string, content string"), "path", "content")
    assert [r["items"] for r in same.collect()] == ["a c"]
    sizes = totals.compressed_sizes(text(spark, "a" * 1000, None), "value", ("line_no",)).orderBy("line_no").collect()
    assert sizes[0].bytes == 1000 and sizes[0].gzip < 100 and sizes[1].bytes == 0
    days = spark.sql("SELECT DATE '2021-03-01' AS d, 1 AS u UNION ALL SELECT DATE '2021-03-03', 2")
    assert [(str(r.d), r.u) for r in totals.presence(days.unionAll(days), "d", "u").orderBy("d").collect()] == [("2021-03-01", 1), ("2021-03-02", None), ("2021-03-03", 2)]
    rows = spark.range(50_000).select(F.when(F.col("id") % 5 > 0, "k").alias("k"), F.col("id").alias("v"))
    many = totals.listed(rows, "k", "v").collect()
    assert [(r.k, r.n, [int(x) for x in r["items"].split()]) for r in many] == [("k", 40_000, [i for i in range(50_000) if i % 5])]
    assert totals.listed(rows, "k", "v", least=40_001).count() == 0 and totals.members(rows, "k").count() == 40_000 and totals.members(rows.limit(0), "k").count() == 0
    big = totals.parse_partial(F.lit("99999999999999999999 k"))
    assert [str(r.value) for r in totals.merge_sum(spark.range(2).select(big[0].alias("value"), big[1].alias("key"))).collect()] == ["199999999999999999998"]
    assert [str(x) for x in spark.range(1).select(*[project.number(F.lit(v)) for v in ("9223372036854775808x", "-", "+7", "")]).first()] == ["9223372036854775808", "0", "7", "0"]
    assert totals.presence(days.limit(0), "d", "u").count() == 0


def test_monitor(spark):
    out = monitor(text(spark, "ab", None, "é"), "line_no", "value").orderBy("line_no").collect()
    assert [(r.nlines, r.nbytes, r.data) for r in out] == [(0, 0, "ab"), (1, 3, None), (2, 4, "é")]
    timed = spark.sql("SELECT 1L AS n, TIMESTAMP '2021-03-01 00:00:01.5' AS t, 'x' AS v UNION ALL SELECT 2L, TIMESTAMP '2021-03-01 00:00:03', 'y'")
    assert [r.rtime for r in monitor(timed, "n", "v", time="t").orderBy("n").collect()] == [0.0, 1.5]
    assert as_json(text(spark, 'a"/'), "line_no", "value").collect()[0].value == '{"line_no":1,"value":"a\\"/"}'


def test_character_functions(spark):
    one = lambda c: spark.range(1).select(c).collect()[0][0]
    assert one(scalar.tag_text(F.lit("<a>x</a> <b>y</b>"), "b")) == "y" and one(scalar.tag_text(F.lit("<b>"), "b")) is None
    assert one(scalar.delete_characters(F.lit("a-b-c"), "-c")) == "ab" and one(scalar.squeeze_characters(F.lit("aa  bb]]--"), " ]-")) == "aa bb]-"
    assert one(scalar.keep_characters(F.lit("a1, b"), "A-Za-z", "_")) == "a_b"


def test_bibliography(spark):
    from fanloom.plans.programs import bibliography_comparison

    record = lambda key, *names: [f'<article mdate="2002" key="{key}/1">', *[f"<author>{n}</author>" for n in names], "<title>t</title>", "<author>not this</author>", "</article>"]
    df = text(spark, *record("x/a", "A", "B"), *record("y/b", "B", "C"), *record("z", "D"), *record("x/a", "A"), *record("y/b", "A"))
    assert tuple(bibliography_comparison(df, "x/a", "y/b").collect()[0]) == (2, 2, 1, 1, 2)
    assert tuple(bibliography_comparison(df.limit(0), "x", "y").collect()[0]) == (0, 0, 0, 0, 0)


def test_shared(spark):
    df, same = spark.range(3), Function(lambda s: s, name="same")
    assert not shared(df, 2).is_cached
    with keeping():
        assert shared(df, 2).is_cached and not shared(spark.range(4), 1).is_cached
        a, b = (tee() | block(same, same))(Stream(spark.range(5).withColumnRenamed("id", "line_no"))).streams
        assert a.df.is_cached and a.df is b.df and a.df.count() == 5
    assert not df.is_cached and not a.df.is_cached

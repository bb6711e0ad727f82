import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from fanloom.graph import block, cat, from_text, run_graph, tee
from fanloom.serve import StoreServer
from fanloom.stream import PlanError, literal
from fanloom.store import Stores
from fanloom.tools import comm, count, cut, diff, echo, grep, grep_listed, join, paste, pipeline, registry, sort, sql, store_read, store_write, values, write

A = ["", "1", "2", "3", "4", "5", "6"]
B = ["", "3", "3", "4", "4", "5"]
P = ["4", "", "2", "8", "10", "3", "2", "9"]
Q = ["5", "1", "6", "12", "4", "8", "4", "9"]


def lines(spark, xs):
    return literal(spark, *xs)


def test_comparison_and_paste_of_its_outputs(spark):
    g = comm() | paste()
    assert values(g(lines(spark, A), lines(spark, B))) == [["1\t\t3\t\t\t", "2\t\t4\t\t\t3", "6\t\t\t\t4", "\t\t\t\t5"]]


def test_sorted_comparison(spark):
    g = block(sort(), sort()) | comm() | cat()
    out = g(lines(spark, P), lines(spark, Q))[0]
    got = [r.value for r in out.df.orderBy("channel", "value").collect()]
    assert got == ["", "10", "2", "2", "3", "\t1", "\t12", "\t4", "\t5", "\t6", "\t\t4", "\t\t8", "\t\t9"]
    assert values((comm("12"))(lines(spark, A), lines(spark, B))) == [["", "3", "4", "5"]]


def test_joins(spark):
    assert values((join() | sort())(lines(spark, A), lines(spark, B))) == [["", "3", "3", "4", "4", "5"]]
    assert values(join()(lines(spark, ["12", " 4", "7"]), lines(spark, ["12\tmatch", "4\tmatch", "9\tno"]))) == [["12 match", "4 match"]]
    assert values(join(2, 1, ",")(lines(spark, ["a,k,b", "c,x"]), lines(spark, ["k,v"]))) == [["k,a,b,v"]]


def test_edit_script_of_a_paste(spark):
    g = block(tee() | paste(), tee()) | diff()
    out = values(g(lines(spark, ["a", "b"]), lines(spark, ["a", "c"])))[0]
    assert out == ["2c2", "< b", "---", "> c"]


def test_pipelines(spark):
    text = lines(spark, ["b a", "a c-b", "B"])
    run = lambda p: values(pipeline(spark, p)(text))[0]
    assert run("words | sort | uniq -c | sort -rn | head -n 2") == ["      2 b", "      2 a"]
    assert run("words | sort -u | wc -l") == ["4"] and run("wc -lc") == ["3 12"] and run("tail -n 1") == ["B"]
    assert run("words | sort | uniq -d") == ["a", "b"] and run("grep -i b | wc") == ["3"] and run("grep -vi b | wc -l") == ["0"]
    assert run("uniq -c")[0] == "      1 b a" and run("cut -d ' ' -f 2") == ["a", "c-b", "B"]
    assert run("sort -k 2") == ["B", "b a", "a c-b"]
    with pytest.raises(PlanError):
        pipeline(spark, "nothing")
    with pytest.raises(PlanError):
        pipeline(spark, "grep --color x")


def test_order_after_words(spark):
    text = lines(spark, ["pear apple", "zoo ant pear", "ant ant b10"])
    run = lambda p, *more: values(pipeline(spark, p)(text, *more))[0]
    assert run("words | head -n 3") == ["pear", "apple", "zoo"] and run("words | tail -n 2") == ["ant", "b"]
    assert run("words | uniq -c") == ["      1 pear", "      1 apple", "      1 zoo", "      1 ant", "      1 pear", "      2 ant", "      1 b"]
    assert run("words | uniq -u") == ["pear", "apple", "zoo", "ant", "pear", "b"] and run("words | uniq -d") == ["ant"]
    assert values((block(pipeline(spark, "grep ant"), pipeline(spark, "words")) | paste())(text, lines(spark, ["x y"]))) == [["zoo ant pear\tx", "ant ant b10\ty"]]
    assert values((block(pipeline(spark, "words"), pipeline(spark, "words")) | pipeline(spark, "cmp"))(lines(spark, ["pear apple"]), lines(spark, ["apple pear"]))) == [["line 1"]]
    assert run("words | words | wc -l") == ["8"] and run("sort | words | head -n 1") == ["ant"]


def test_channels_of_different_order_are_gathered(spark):
    made = block(pipeline(spark, "words"), sort(), pipeline(spark, "sort -r"), pipeline(spark, "grep -on '[a-z]'")) | cat()
    out = made(lines(spark, ["b a", "c"]), lines(spark, ["z", "y"]), lines(spark, ["p", "q"]), lines(spark, ["-", "m-k"]))
    assert values(out) == [["b", "a", "c", "y", "z", "q", "p", "2:m", "2:k"]]
    assert values((block(pipeline(spark, "words"), sort()) | cat() | pipeline(spark, "paste"))(lines(spark, ["b a"]), lines(spark, ["z"]))) == [["b", "a", "z"]]


def test_options_of_grep_and_others(spark):
    text = lines(spark, ["pear apple", "zoo ant pear", "ant ant b10", "x|y", "last"])
    run = lambda p: values(pipeline(spark, p)(text))[0]
    assert run("grep -o a") == ["a"] * 2 + ["a"] * 2 + ["a"] * 2 + ["a"] and run("grep -on 'an*t'") == ["2:ant", "3:ant", "3:ant"]
    assert run("grep -n pear") == ["1:pear apple", "2:zoo ant pear"] and run("grep -ov a") == [] and run("grep -ohw -i ANT") == ["ant"] * 3
    assert run("grep -n -A 1 zoo") == ["2:zoo ant pear", "3-ant ant b10"] and run("grep -C1 'x[|]y'") == ["ant ant b10", "x|y", "last"]
    assert run("grep --context=0 -e b10") == ["ant ant b10"] and run("grep -n -B1 -A0 'apple|last'") == ["1:pear apple", "--", "4-x|y", "5:last"]
    assert run("cut -d '|' -f 2") == ["pear apple", "zoo ant pear", "ant ant b10", "y", "last"] and run("cut -s -d '|' -f -1") == ["x"]
    assert run("cut -c 2-3,5-") == ["ea apple", "ooant pear", "ntant b10", "|y", "as"] and run("cut -d ' ' -f 2-") == ["apple", "ant pear", "ant b10", "x|y", "last"]
    assert run("tr a-c A-C | head -1") == ["peAr Apple"] and run("tr -d aeiou | tail -1") == ["lst"] and run("tr -s p | head -1") == ["pear aple"] and run("tr xy z | tail -n +4") == ["z|z", "last"]
    assert run("sort -k 2,2") == ["last", "x|y", "ant ant b10", "zoo ant pear", "pear apple"] and run("wc -lwm") == ["5 10 45"] and run("wc -c") == ["45"]
    assert run("tee -s | parallel -n 3 grep -v zoo | cat | sort | head -n 2") == ["ant ant b10", "last"]
    assert run("tee | parallel -l a,z grep -c {} | paste") == ["4\t1"]
    for bad in ("grep --color x", "grep -q x", "grep", "grep a b", "sort -z", "uniq -i", "wc -L", "cut -f 1 -c 1", "cut -f 0", "cut -f 2-1x", "tr a", "tr -ds a", "head x", "tail -f", "comm -4", "paste -s", "diff -u", "join -a 1", "tee x", "parallel words", "parallel -n 0 words", "parallel -n 2 nothing", "words -x", "cat -n", "perm 1,x", "cmp -s", "grep -f x", "grep -f - -c", "merge-sum -x"):
        with pytest.raises(PlanError):
            pipeline(spark, bad)


def test_commands(spark):
    many = literal(spark, *[f"line {i}" for i in range(3000)])
    run = lambda p, s: values(pipeline(spark, p)(s))[0]
    assert run("run sed s/line/no/", many) == [f"no {i}" for i in range(3000)]
    assert run("run awk '$2 % 1000 == 7 { print; print $2 }' | paste", many) == ["line 7", "7", "line 1007", "1007", "line 2007", "2007"]
    assert run("run grep nothing | wc -l", many) == ["0"] and run("run cat", lines(spark, ["a", None, "é"])) == ["a", "", "é"] and run("run cat", literal(spark, "x").map(lambda df: df.limit(0))) == []
    with pytest.raises(Exception, match="ended with 2"):
        run("run ls --no-such-option", many)
    with pytest.raises(PlanError):
        pipeline(spark, "run")


def test_several_scripts(spark):
    a, b, c = lines(spark, ["1", "2"]), lines(spark, ["1"]), lines(spark, ["1", "2", "3"])
    assert values(pipeline(spark, "diff --from-file=-")(a, b, c)) == [["2d1", "< 2", "2a3", "> 3"]]
    assert values(pipeline(spark, "diff --to-file=-")(a, b)) == [["1a2", "> 2"]]


def test_several_outputs(spark):
    hi = lines(spark, ["hi"])
    out = pipeline(spark, "grep -L -c -l --matching-lines hi")(hi)
    assert values(out) == [[], ["1"], ["(standard input)"], ["hi"]]
    assert values(pipeline(spark, "grep -c -l -L --matching-lines ho")(hi)) == [["0"], [], ["(standard input)"], []]
    assert values(cut(",", [(1, 1), (2, 3)], several=True)(lines(spark, ["a,b,c"]))) == [["a"], ["b,c"]]
    assert values(grep_listed()(lines(spark, ["B"]), lines(spark, ["a b", "abc"]))) == [["a b"]]
    assert grep("x", ("count", "files")).gives == 2


def test_text_graph_of_tools(spark):
    text = "1 echo 2 a\n2 echo 3 a\n3 merge-sum\n4 enumerate 3\n5 perm 3,1,2\n6 paste\n%\npipe 1 3\npipe 2 3\npipe 4 5\npipe 5 6\n"
    out = run_graph(*from_text(text, registry(spark)))
    assert values(out["3"]) == [["5 a"]] and values(out["6"]) == [["1\t2\t0"]]


def test_store_server(spark):
    spark.range(3).createOrReplaceTempView("served")
    server = StoreServer(spark, {"n": lambda: spark.range(5).agg(F.count("*").alias("n"))}, {"above": "SELECT id FROM served WHERE id > CAST(:least AS INT) ORDER BY id"})
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.port}/{p}", timeout=60).read().decode()
    try:
        assert get("n") == '{"n": 5}\n' and get("above?least=0") == '{"id": 1}\n{"id": 2}\n'
        with pytest.raises(urllib.error.HTTPError):
            get("missing")
    finally:
        server.quit()


def test_server_sends_whole_answers_and_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "page.html").write_text("<p>x</p>")
    (tmp_path / "secret").write_text("s")
    server = StoreServer(spark, {"many": lambda: spark.range(5000)}, folder=str(tmp_path / "in"))
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{server.port}/{p}", timeout=60)
    try:
        assert len(get("many").read().splitlines()) == 5000
        page = get("page.html")
        assert page.read() == b"<p>x</p>" and page.headers["Content-Type"] == "text/html"
        for outside in ("../secret", "%2e%2e/secret", ""):
            with pytest.raises(urllib.error.HTTPError):
                get(outside)
    finally:
        server.quit()


def test_stored_values_in_a_graph(spark):
    stores = Stores()
    g = tee() | block(echo(spark, "lines:"), store_read(spark, stores, "n"), count() | store_write(stores, "n"), tee()) | cat()
    assert values(g(lines(spark, ["a", "b"]))) == [["lines:", "2", "a", "b"]]
    stores = Stores()
    window = block(store_write(stores, "w", 3, 1), store_read(spark, stores, "w"))
    assert sorted(values(window(lines(spark, list("abcd"))))[0]) == ["b", "c"]
    stores = Stores()
    with pytest.raises(PlanError, match="cycle"):
        block(store_read(spark, stores, "x") | store_write(stores, "y"), store_read(spark, stores, "y") | store_write(stores, "x"))()


def test_sql_words_and_files(spark, tmp_path):
    a, b = lines(spark, ["x", "y"]), lines(spark, ["y", "z"])
    assert values(sql(spark, "SELECT value FROM {in1} WHERE value IN (SELECT value FROM {in2})", 2)(a, b)) == [["y"]]
    assert values(pipeline(spark, "pecho done")(a)) == [["x", "y", "done"]] and values(pipeline(spark, "pecho a b")()) == [["a b"]]
    assert len((tee() | block(write(str(tmp_path / "1"), str(tmp_path / "2")), tee()))(a)) == 1
    assert spark.read.text(str(tmp_path / "2")).count() == 2

"""Named stages over streams of text records, for graphs written as text or put together by hand.

A stream has a `value` column and columns that order it. Stages whose result depends on the order number the records
first; those that do not care never sort. A stage's arity is fixed by its settings, so a graph is checked before it runs.
"""

from __future__ import annotations

import re
import shlex
import subprocess
import threading
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fanloom.arity import ANY
from fanloom.functions import scalar
from fanloom.graph import Function, Stage, block, cat, parallel, perm, scattered, tee
from fanloom.operators import compare, match, ordered, project, totals
from fanloom.session import free_name
from fanloom.sources.files import read_lines, write_to_all
from fanloom.store import Stores, last_record, record_window
from fanloom.stream import Bundle, PlanError, Stream, enumerate_channels, gather, literal, number_lines


def _v():
    return F.col("value")


def numbered(stream: Stream) -> Stream:
    """The stream with dense line numbers; one that has them is left as it is."""
    return stream if stream.dense else Stream(number_lines(stream.df, list(stream.order)).select(F.col("line_no"), "value"), dense=True) if "line_no" not in stream.df.columns else _renumbered(stream)


def _renumbered(stream: Stream) -> Stream:
    order = [f"_order_{i}" for i in range(len(stream.order))]
    named = stream.df.select(*[F.col(c).alias(n) for c, n in zip(stream.order, order)], "value")
    return Stream(number_lines(named, order).select("line_no", "value"), dense=True)


def _together(streams: tuple[Stream, ...]) -> DataFrame:
    df = streams[0].df.select("value")
    for s in streams[1:]:
        df = df.unionAll(s.df.select("value"))
    return df


def sort(reverse: bool = False, numeric: bool = False, unique: bool = False, field: int | None = None, delimiter: str | None = None, reverse_ties: bool | None = None, last: int | None = None) -> Stage:
    """All inputs in one order. Plain byte order is only noted, and costs nothing until a stage asks for it.

    The key is the line or its part from a field on, or from one field to another, as text or as a number; ties go by the
    whole line, reversed as the key is unless told. Lines alike are counted first, and sorted as one.
    """

    def run(*inputs: Stream) -> Stream:
        df = _together(inputs).distinct() if unique else _together(inputs)
        if not (reverse or numeric or field):
            return Stream(df, ("value",))
        keys = ordered.sort_keys("value", field, delimiter, numeric, reverse, reverse_ties, last) if numeric or field else [_v().desc()]
        return Stream(number_lines(df.groupBy("value").agg(F.count("*").alias("_n")), keys, copies="_n").select("line_no", "value"), dense=True)

    return Function(run, ANY, 1, "sort")


def uniq(count: bool = False, repeated: bool = False, single: bool = False) -> Stage:
    """Runs of equal records: one of each, with its length, or only those longer than one, or only those of one. In a sorted stream runs are groups."""

    def run(s: Stream) -> Stream:
        if s.order == ("value",):
            runs = s.df.groupBy("value").agg(F.count("*").alias("length"))
        else:
            runs = ordered.run_lengths(numbered(s).df, "line_no", "value")
        runs = runs.where("length > 1") if repeated else runs
        runs = runs.where("length = 1") if single else runs
        # Within a sorted stream the record itself is the order; `key` keeps it beside a count.
        place = _v().alias("key") if s.order == ("value",) else F.col("run").alias("line_no")
        shown = F.concat_ws(" ", F.format_string("%7d", F.col("length")), _v()) if count else _v()
        order = ("line_no",) if s.order != ("value",) else ("key",) if count else ("value",)
        return Stream(runs.select(place, shown.alias("value")), order, s.order != ("value",) and not (repeated or single))

    return Function(run, 1, 1, "uniq")


def count(lines: bool = True, size: bool = False, words: bool = False, characters: bool = False) -> Stage:
    """Numbers of lines, words between blanks, characters and bytes, in this order, line ends included."""
    n_words = F.coalesce(F.sum(F.size(project.blank_words(F.coalesce(_v(), F.lit(""))))), F.lit(0))
    n_characters = F.coalesce(F.sum(F.length(F.coalesce(_v(), F.lit(""))) + 1), F.lit(0))
    parts = [c.cast("string") for c, asked in ((F.count("*"), lines), (n_words, words), (n_characters, characters), (totals.byte_size(_v()), size)) if asked]
    return Function(lambda s: Stream(s.df.agg(F.concat_ws(" ", *parts).alias("value")), ("value",)), 1, 1, "wc")


def head(n: int = 10) -> Stage:
    return Function(lambda s: Stream(ordered.head(s.df, list(s.order), n), s.order, s.dense), 1, 1, "head")


def tail(n: int = 10) -> Stage:
    return Function(lambda s: Stream(ordered.tail(s.df, list(s.order), n), s.order), 1, 1, "tail")


def tail_from(n: int) -> Stage:
    """All records from the n-th on."""
    return Function(lambda s: Stream(numbered(s).df.where(F.col("line_no") >= n)), 1, 1, "tail")


def grep(pattern: str, outputs: tuple[str, ...] = ("matching_lines",), only: bool = False, numbers: bool = False, before: int = 0, after: int = 0, **options) -> Stage:
    """One stream per output asked for; the stream is one file, called (standard input).

    Matching lines may be shown as their matches alone, with line numbers, and with the lines around them, stretches of
    which that do not touch are parted by `--`.
    """
    inverted = options.get("inverted", False)

    def shown(s: Stream, hit: Column) -> Stream:
        if not (only or numbers or before or after):
            return Stream(s.df.where(hit), s.order)
        rows = numbered(s).df if numbers or before or after else s.df
        order = ["line_no"] if numbers or before or after else list(s.order)
        named = [F.col(c).alias(f"_order_{i}") for i, c in enumerate(order)]
        label = lambda mark: F.concat(F.col("line_no").cast("string"), mark) if numbers else F.lit("")
        if only:
            body = match.expression(pattern, **{k: v for k, v in options.items() if k != "inverted"})
            found = F.filter(F.regexp_extract_all("value", F.lit(f"({body})"), F.lit(1)), lambda x: x != "")
            found = F.when(F.lit(not inverted), found).otherwise(F.array().cast("array<string>"))
            each = rows.select(*named, label(F.lit(":")).alias("_label"), F.posexplode(found).alias("_place", "_text"))
            return Stream(each.select(*[f"_order_{i}" for i in range(len(order))], "_place", F.concat("_label", "_text").alias("value")), (*[f"_order_{i}" for i in range(len(order))], "_place"))
        if not (before or after):
            return Stream(rows.where(hit).select("line_no", F.concat(label(F.lit(":")), "value").alias("value")))
        near = ordered.previous(ordered.context(rows, "line_no", hit, before, after), "line_no", "line_no", name="_last")
        parted = F.col("has__last") & (F.col("_last") < F.col("line_no") - 1)
        lines = F.array(F.when(parted, F.struct(F.lit(0).alias("k"), F.lit("--").alias("v"))), F.struct(F.lit(1).alias("k"), F.concat(label(F.when(F.col("matched"), ":").otherwise("-")), "value").alias("v")))
        each = near.select("line_no", F.explode(lines).alias("l")).where("l IS NOT NULL")
        return Stream(each.select("line_no", F.col("l.k").alias("part"), F.col("l.v").alias("value")), ("line_no", "part"))

    def run(s: Stream) -> list[Stream]:
        hit = match.matches(_v(), pattern, **options)
        made = match.multi_match(s.df.withColumn("file", F.lit("(standard input)")), "file", hit, list(outputs))
        shaped = []
        for o, df in zip(outputs, made):
            if o == "matching_lines":
                shaped.append(shown(s, hit))
            else:
                shaped.append(Stream(df.select(F.col("matched_lines" if o == "count" else "file").cast("string").alias("value")), ("value",)))
        return shaped

    def each(s: Stream, channel: str) -> Stream:
        return Stream(s.df.where(match.matches(_v(), pattern, **options)), s.order)

    plain = outputs == ("matching_lines",) and not (only or numbers or before or after)
    return Function(run, 1, len(outputs), "grep", each=each if plain else None)


def grep_listed(whole_word: bool = True, before: int = 0, after: int = 0) -> Stage:
    """Takes a stream of fixed strings and a text; gives the text's lines that hold one of them, and lines around those."""

    def run(patterns: Stream, s: Stream) -> Stream:
        if not (before or after):
            return Stream(match.match_pattern_table(s.df, "value", patterns.df, "value", whole_word), s.order)
        rows = numbered(s).df
        hits = match.match_pattern_table(rows, "value", patterns.df, "value", whole_word, ["line_no"]).select("line_no", F.lit(True).alias("_hit"))
        marked = rows.join(hits, "line_no", "left")
        return Stream(ordered.context(marked, "line_no", F.coalesce("_hit", F.lit(False)), before, after).select("line_no", "value"))

    return Function(run, 2, 1, "grep -f")


def cut(delimiter: str, ranges: list[tuple[int, int | None]], several: bool = False, characters: bool = False, only_delimited: bool = False) -> Stage:
    """The ranges of fields, or of characters, as one stream, or each range as a stream of its own."""

    def one(ranges: list[tuple[int, int | None]]):
        made = project.cut_characters(_v(), ranges) if characters else project.cut(_v(), delimiter, ranges, only_delimited)
        keep = lambda df: df.where(F.contains(_v(), F.lit(delimiter))) if only_delimited and not characters else df
        return lambda s: Stream(keep(s.df).withColumn("value", made), s.order, s.dense and not only_delimited)

    if several:
        return Function(lambda s: [one([r])(s) for r in ranges], 1, len(ranges), "cut")
    return Function(one(ranges), 1, 1, "cut", each=lambda s, channel: one(ranges)(s))


def translate(first: str, second: str = "", delete: bool = False, squeeze: bool = False) -> Stage:
    """Characters of each line replaced, taken out, or runs of them squeezed; ranges such as a-z are written out."""
    a, b = _characters(first), _characters(second)
    if delete:
        made = scalar.delete_characters(_v(), a)
    elif squeeze and not b:
        made = scalar.squeeze_characters(_v(), a)
    else:
        made = F.translate(_v(), a, b + b[-1:] * (len(a) - len(b)))
        made = scalar.squeeze_characters(made, b) if squeeze else made
    row = lambda s: Stream(s.df.withColumn("value", made), s.order, s.dense)
    return Function(row, 1, 1, "tr", each=lambda s, channel: row(s))


def _characters(text: str) -> str:
    return re.sub("(.)-(.)", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), text, flags=re.S)


def words() -> Stage:
    """Runs of ASCII letters, in the order of the records and of their places in them."""

    def run(s: Stream, *channel: str) -> Stream:
        place = free_name("word_no", s.df.columns)
        kept = [c for c in dict.fromkeys([*s.order, *channel]) if c != "value"]
        order = [F.col(c) for c in kept] if "value" not in s.order else [*[F.col(c) for c in kept], _v().alias(free_name("line", [*s.df.columns, place]))]
        rows = s.df.select(*order, F.posexplode(project.letter_words(_v())).alias(place, "value"))
        return Stream(rows, tuple(c for c in rows.columns if c not in ("value", *channel)))

    return Function(run, 1, 1, "words", each=run)


def comm(without: str = "") -> Stage:
    """Multiset comparison of two streams; one output for each of 1, 2, 3 that is not left out, with 0, 1, 2 tabs in front."""
    kept = [i for i in (1, 2, 3) if str(i) not in without]

    def run(a: Stream, b: Stream) -> list[Stream]:
        parts = compare.compare_sets(a.df.select("value"), b.df.select("value"))
        tabs = {i: sum(j < i for j in kept) for i in kept}
        return [Stream(parts[i - 1].select(F.concat(F.lit("\t" * tabs[i]), _v()).alias("value")), ("value",)) for i in kept]

    return Function(run, 2, len(kept), "comm")


def join(field_1: int = 1, field_2: int = 1, delimiter: str | None = None) -> Stage:
    """Equal keys of two streams: the key, the rest of the first, the rest of the second."""

    def split(s: Stream, field: int) -> DataFrame:
        f = project.blank_fields(_v()) if delimiter is None else project.char_fields(_v(), delimiter)
        rest = F.filter(F.transform(f, lambda x, i: F.when(i != field - 1, x)), lambda x: x.isNotNull())
        return s.df.select(project.field(f, field).alias("key"), F.array_join(rest, delimiter or " ").alias("rest"), (F.size(f) > 1).alias("more"))

    def run(a: Stream, b: Stream) -> Stream:
        pairs = split(a, field_1).join(split(b, field_2).select("key", F.col("rest").alias("rest_2"), F.col("more").alias("more_2")), "key")
        line = F.concat_ws(delimiter or " ", "key", F.when(F.col("more"), F.col("rest")), F.when(F.col("more_2"), F.col("rest_2")))
        return Stream(pairs.select(line.alias("value")), ("value",))

    return Function(run, 2, 1, "join")


def paste(delimiter: str = "\t") -> Stage:
    return Function(lambda *s: Stream(compare.paste([numbered(x).df for x in s], delimiter=delimiter), dense=True), ANY, 1, "paste")


def diff() -> Stage:
    return Function(lambda a, b: Stream(compare.diff(numbered(a).df, numbered(b).df), dense=True), 2, 1, "diff")


def diff_many(to_first: bool = False) -> Stage:
    """The edit scripts from the first input to each of the others, or from each of them to it, one after the other."""

    def run(first: Stream, *others: Stream) -> Stream:
        made = compare.diff_from(numbered(first).df, [numbered(x).df for x in others], reverse=to_first)
        return gather(Bundle(tuple(Stream(df) for df in made)))

    return Function(run, ANY, 1, "diff")


def diff3() -> Stage:
    return Function(lambda a, b, c: Stream(compare.diff3(numbered(a).df, numbered(b).df, numbered(c).df), dense=True), 3, 1, "diff3")


def cmp() -> Stage:
    """The first line in which two streams differ; no record if they are the same."""

    def run(a: Stream, b: Stream) -> Stream:
        found = compare.first_difference(numbered(a).df, numbered(b).df)
        return Stream(found.where("NOT identical").select(F.concat(F.lit("line "), F.col("line_no").cast("string")).alias("value")), ("value",))

    return Function(run, 2, 1, "cmp")


def merge_sum() -> Stage:
    """Totals of lines `count key` of any number of streams."""

    def run(*s: Stream) -> Stream:
        n, key = totals.parse_partial(_v())
        summed = totals.merge_sum(_together(s).select(n.alias("n"), key.alias("key")).where("key IS NOT NULL"), "key", "n")
        return Stream(summed.select("key", F.concat_ws(" ", F.col("n").cast("string"), "key").alias("value")), ("key",))

    return Function(run, ANY, 1, "merge-sum")


def echo(spark: SparkSession, *args: str) -> Stage:
    return Function(lambda: literal(spark, " ".join(args)), 0, 1, "echo")


def read(spark: SparkSession, *paths: str) -> Stage:
    """Files as one stream."""
    return Function(lambda: read_lines(spark, *paths), 0, 1, "read")


def enumerate_stage(spark: SparkSession, n: int) -> Stage:
    return Function(lambda: enumerate_channels(spark, n), 0, n, "enumerate")


def pecho(spark: SparkSession, *args: str) -> Stage:
    """Its input, if it has one, and then its words as one record."""

    def run(*s: Stream) -> Stream:
        own = literal(spark, " ".join(args))
        return own if not s else gather(Bundle((numbered(s[0]), own)))

    return Function(run, ANY, 1, "pecho")


def sql(spark: SparkSession, text: str, n_in: int = 1, order: tuple[str, ...] = ("value",)) -> Stage:
    """A query over its inputs, which the text names {in1}, {in2} and so on."""
    return Function(lambda *s: Stream(spark.sql(text, **{f"in{i}": x.df for i, x in enumerate(s, 1)}), order), n_in, 1, "sql")


def command(*argv: str, allowed: tuple[int, ...] = (0, 1)) -> Stage:
    """Records through a program of the executors' machines, as its input and output lines.

    Each partition of the ordered stream has a process of its own, so the program has to treat every line by itself, as
    `sed` and `awk` do with most scripts. It is started with these words, without a shell. Another exit code than those
    allowed is an error.
    """

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(argv, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        ready: deque[bytes] = deque()
        reader = threading.Thread(target=lambda: ready.extend(process.stdout), daemon=True)
        reader.start()
        part, at = 0, 0

        def drained(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal at
            while len(ready) >= 10_000 or whole and ready:
                found = [ready.popleft().decode("utf-8", "replace").removesuffix("\n") for _ in range(min(len(ready), 10_000))]
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array(range(at, at + len(found)), pa.int64()), pa.array(found, pa.string())], ["part_no", "place_no", "value"])
                at += len(found)

        for b in batches:
            if b.num_rows:
                part = b.column(0)[0].as_py()
            try:
                process.stdin.write("".join((v or "") + "\n" for v in b.column(1).to_pylist()).encode("utf-8", "replace"))
            except BrokenPipeError:  # the program has read enough
                pass
            yield from drained(False)
        try:
            process.stdin.close()
        except BrokenPipeError:
            pass
        reader.join()
        if process.wait() not in allowed:
            raise RuntimeError(f"{' '.join(argv)} ended with {process.returncode}")
        yield from drained(True)

    def run(s: Stream) -> Stream:
        ranged = s.df.repartitionByRange(*s.order).sortWithinPartitions(*s.order).select(F.spark_partition_id().alias("part_no"), "value")
        return Stream(ranged.mapInArrow(through, "part_no int, place_no bigint, value string"), ("part_no", "place_no"))

    return Function(run, 1, 1, argv[0])


def write(*paths: str, append: bool = False) -> Stage:
    """Takes a stream to files, and gives none."""
    return Function(lambda s: write_to_all(s.df, list(paths), append=append), 1, 0, "write")


def store_write(stores: Stores, name: str, begin: int = 1, end: int = 0) -> Stage:
    """Keeps the last record of its input, or a window of records counted from the end, under a name; gives no stream."""
    kept = lambda s: last_record(s) if (begin, end) == (1, 0) else record_window(numbered(s).df, "line_no", begin, end)
    return Function(lambda s: stores.write(name, lambda: kept(s)), 1, 0, f"store {name}", writes=frozenset([name]))


def store_read(spark: SparkSession, stores: Stores, name: str, column: str = "value") -> Stage:
    """A stored value as a stream of one record; in a block it may stand before the member that writes it."""
    return Function(lambda: Stream(stores.read(name).select(F.col(column).cast("string").alias("value")), ("value",)), 0, 1, f"read {name}", reads=frozenset([name]))


def _number_list(text: str) -> list[tuple[int, int | None]]:
    """Ranges such as 1,3-4,6-; -2 is 1-2."""
    found = []
    for x in text.split(","):
        m = re.fullmatch("([1-9][0-9]*)?(?:(-)([1-9][0-9]*)?)?", x)
        if not m or not (m[1] or m[3]):
            raise PlanError(f"cut: cannot use the range {x!r}")
        found.append((int(m[1] or 1), int(m[3]) if m[3] else None if m[2] else int(m[1])))
    return found


class Options:
    """The words that follow a command: options it knows, in the order given, and the others. Any other option is an error."""

    def __init__(self, command: str, args: list[str], flags: str = "", valued: str = "", long: tuple[str, ...] = (), once: str = "", numbers: bool = False):
        self.command, self.args, self.found, self.rest = command, args, [], []
        todo = list(args)
        while todo:
            w = todo.pop(0)
            if w == "--":
                self.rest += todo
                break
            if w.startswith("--"):
                name, _, value = w.partition("=")
                self.need(name in long, w)
                self.found.append((name, value))
            elif len(w) < 2 or w[0] != "-":
                self.rest.append(w)
            elif numbers and w[1:].isdigit():
                self.found.append(("n", w[1:]))
            else:
                for k, c in enumerate(w[1:], 1):
                    self.need(c in flags + valued, f"-{c}")
                    self.need(not (c in once and c in self), f"-{c} given twice")
                    if c in valued:
                        self.need(bool(w[k + 1 :] or todo), f"-{c} without a value")
                        self.found.append((c, w[k + 1 :] or todo.pop(0)))
                        break
                    self.found.append((c, ""))

    def need(self, held: bool, what: str) -> None:
        if not held:
            raise PlanError(f"{self.command}: cannot use {what} in {' '.join([self.command, *self.args])!r}")

    def __contains__(self, name: str) -> bool:
        return any(n == name for n, _ in self.found)

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for n, v in reversed(self.found) if n == name), default)

    def number(self, name: str, default: int) -> int:
        value = self.get(name, str(default))
        self.need(value.isdigit(), value)
        return int(value)

    def words(self, least: int, most: int | None = None) -> list[str]:
        self.need(least <= len(self.rest) <= (least if most is None else most), f"{len(self.rest)} words")
        return self.rest


def registry(spark: SparkSession, stores: Stores | None = None) -> dict[str, Callable[[list[str]], Stage]]:
    """Stages by name, each made from the words that follow the name in a text graph.

    A stage takes the options listed in its maker below, and raises PlanError for any other.
    """
    stores = stores or Stores()

    def made_sort(args: list[str]) -> Stage:
        # -m, -S and -T say how to sort, and change nothing here: inputs that are sorted give the same without being told.
        o = Options("sort", args, "nrum", "ktST", once="kt")
        key = re.fullmatch("([1-9][0-9]*)(?:,([1-9][0-9]*))?([nr]*)", o.get("k", "1"))
        o.need(bool(key) and not o.rest and len(o.get("t", " ")) == 1 and not ("u" in o and ("n" in o or "k" in o)), "these")
        o.need(not key[2] or int(key[2]) >= int(key[1]), o.get("k", "1"))
        # As in sort(1), a key with letters of its own takes none of those for all keys, which then only hold for ties.
        letters = key[3] or o
        return sort("r" in letters, "n" in letters, "u" in o, int(key[1]) if "k" in o else None, o.get("t"), "r" in o, int(key[2]) if key[2] else None)

    def made_uniq(args: list[str]) -> Stage:
        o = Options("uniq", args, "cdu")
        o.words(0)
        return uniq("c" in o, "d" in o, "u" in o)

    def made_count(args: list[str]) -> Stage:
        o = Options("wc", args, "lwcm")
        o.words(0)
        return count("l" in o or not o.found, "c" in o, "w" in o, "m" in o)

    def made_grep(args: list[str]) -> Stage:
        # -h, which leaves out names of files, changes nothing: a stream has none. -E is what patterns are anyhow.
        o = Options("grep", args, "FivwclLonhE", "fABCe", ("--matching-lines", "--context", "--before-context", "--after-context"))
        around = o.number("--context", o.number("C", 0))
        before, after = o.number("--before-context", o.number("B", around)), o.number("--after-context", o.number("A", around))
        names = {"--matching-lines": "matching_lines", "c": "count", "l": "files", "L": "other_files"}
        asked = tuple(names[n] for n, _ in o.found if n in names)
        if "f" in o:
            o.need(o.get("f") == "-" and not asked and not ({n for n, _ in o.found} & set("ivonecE")) and not o.rest, "these with -f")
            return grep_listed("w" in o, before, after)
        pattern = o.get("e") if "e" in o else o.words(1)[0]
        o.need("e" not in o or not o.rest, "words beside -e")
        return grep(pattern, asked or ("matching_lines",), "o" in o, "n" in o, before, after, fixed="F" in o, ignore_case="i" in o, whole_word="w" in o, inverted="v" in o)

    def made_join(args: list[str]) -> Stage:
        o = Options("join", args, "", "12jt")
        o.words(0)
        return join(o.number("1", o.number("j", 1)), o.number("2", o.number("j", 1)), o.get("t"))

    def made_cut(args: list[str]) -> Stage:
        o = Options("cut", args, "s", "dfc", ("--multistream",))
        o.words(0)
        o.need(("f" in o) != ("c" in o) and len(o.get("d", "\t")) == 1, "these")
        return cut(o.get("d", "\t"), _number_list(o.get("f") or o.get("c")), "--multistream" in o, "c" in o, "s" in o)

    def made_tr(args: list[str]) -> Stage:
        o = Options("tr", args, "ds")
        sets = o.words(1, 1 if "d" in o else 2)
        o.need("d" in o or "s" in o or len(sets) == 2, "one set")
        o.need(not ("d" in o and "s" in o), "-d with -s")
        return translate(sets[0], sets[1] if len(sets) > 1 else "", "d" in o, "s" in o)

    def made_head(args: list[str]) -> Stage:
        o = Options("head", args, "", "n", numbers=True)
        o.words(0)
        return head(o.number("n", 10))

    def made_tail(args: list[str]) -> Stage:
        o = Options("tail", args, "", "n", numbers=True)
        o.words(0)
        if o.get("n", "").startswith("+"):
            o.need(o.get("n")[1:].isdigit(), o.get("n"))
            return tail_from(int(o.get("n")[1:]))
        return tail(o.number("n", 10))

    def made_comm(args: list[str]) -> Stage:
        o = Options("comm", args, "123")
        o.words(0)
        return comm("".join(n for n, _ in o.found))

    def made_paste(args: list[str]) -> Stage:
        o = Options("paste", args, "", "d")
        o.words(0)
        return paste(o.get("d", "\t"))

    def made_diff(args: list[str]) -> Stage:
        o = Options("diff", args, "", "", ("--from-file", "--to-file"))
        o.words(0)
        o.need(len(o.found) < 2 and all(v in ("", "-") for _, v in o.found), "these")
        return diff_many("--to-file" in o) if o.found else diff()

    def made_tee(args: list[str]) -> Stage:
        o = Options("tee", args, "sa")
        o.words(0)  # -a says how files are written, and a tee here writes none
        return scattered() if "s" in o else tee()

    def made_parallel(args: list[str]) -> Stage:
        cut_at = next((i for i, w in enumerate(args) if not w.startswith("-") and (i == 0 or args[i - 1] not in ("-n", "-l", "-f"))), len(args))
        o, command = Options("parallel", args[:cut_at], "", "nlf"), args[cut_at:]
        o.need(len(o.found) == 1 and bool(command) and command[0] in known, "these")
        if "n" in o:
            items = [str(i) for i in range(1, o.number("n", 1) + 1)]
        elif "l" in o:
            items = o.get("l").split(",")
        else:
            items = [r.value for r in spark.read.text(o.get("f")).toLocalIterator()]  # one stage of the plan for each
        o.need(bool(items), "no items")
        if any("{}" in w for w in command):
            return block(*[known[command[0]]([w.replace("{}", x) for w in command[1:]]) for x in items])
        return parallel(known[command[0]](command[1:]), [None] * len(items))

    def made_store(args: list[str]) -> Stage:
        o = Options("writeval", args, "", "sbe")
        o.words(0)
        o.need("s" in o, "no -s")
        return store_write(stores, o.get("s"), o.number("b", 1), o.number("e", 0))

    def made_read(args: list[str]) -> Stage:
        # -l, -c and -e differ only while a stream still runs.
        o = Options("readval", args, "lce", "s")
        o.words(0)
        o.need("s" in o, "no -s")
        return store_read(spark, stores, o.get("s"))

    def made_write(args: list[str]) -> Stage:
        o = Options("write", args, "a")
        return write(*o.words(1, 99), append="a" in o)

    def made_sql(args: list[str]) -> Stage:
        o = Options("sql", args, "", "n")
        return sql(spark, " ".join(o.words(1, 999)), o.number("n", 1))

    def made_perm(args: list[str]) -> Stage:
        o = Options("perm", args)
        o.need(re.fullmatch("[0-9]+(,[0-9]+)*", o.words(1)[0]) is not None, o.rest[0])
        return perm(*map(int, o.rest[0].split(",")))

    def bare(command: str, made: Callable[[], Stage]) -> Callable[[list[str]], Stage]:
        return lambda args: made() if Options(command, args).words(0) == [] else None

    known = {
        "sort": made_sort, "uniq": made_uniq, "wc": made_count, "grep": made_grep, "join": made_join, "cut": made_cut, "tr": made_tr, "head": made_head, "tail": made_tail, "comm": made_comm, "paste": made_paste,
        "diff": made_diff, "diff3": bare("diff3", diff3), "cmp": bare("cmp", cmp), "cat": bare("cat", cat), "tee": made_tee, "parallel": made_parallel, "words": bare("words", words), "merge-sum": bare("merge-sum", merge_sum),
        "perm": made_perm, "echo": lambda a: echo(spark, *a), "pecho": lambda a: pecho(spark, *a), "read": lambda a: read(spark, *a), "enumerate": lambda a: enumerate_stage(spark, int(Options("enumerate", a).words(1)[0])),
        "run": lambda a: command(*Options("run", ["--", *a]).words(1, 999)), "writeval": made_store, "readval": made_read, "write": made_write, "sql": made_sql,
    }
    return known


def pipeline(spark: SparkSession, text: str, stores: Stores | None = None) -> Stage:
    """Stages joined by `|`, such as `words | sort | uniq -c`, in which quotes keep blanks, and bars, together."""
    made, known = None, registry(spark, stores)
    hidden = re.sub(r"""'[^']*'|"[^"]*"|\\\|""", lambda m: m[0].replace("|", "\0"), text)
    lexer = shlex.shlex(hidden, posix=True, punctuation_chars="|")
    lexer.whitespace_split = True
    lexer.commenters = ""
    parts: list[list[str]] = [[]]
    for w in lexer:
        parts.append([]) if w == "|" else parts[-1].append(w.replace("\0", "|"))
    for p in parts:
        if not p or p[0] not in known:
            raise PlanError(f"pipeline: unknown stage {' '.join(p)!r}")
        made = known[p[0]](p[1:]) if made is None else made | known[p[0]](p[1:])
    return made


def values(bundle: Bundle) -> list[list[str]]:
    """Each channel's records in order, on the driver; for small results."""
    return [[r[0] for r in s.df.orderBy(*s.order).select("value").collect()] for s in bundle.streams]

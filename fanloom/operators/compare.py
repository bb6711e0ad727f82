"""Joins and comparisons of channels."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fanloom.fuse import made_once
from fanloom.operators import ordered
from fanloom.stream import PlanError, number_lines, repeated


def join_fields(left: DataFrame, right: DataFrame, left_key: str, right_key: str, key: str = "key") -> DataFrame:
    """Inner join: the key, the rest of the left, the rest of the right; every pair of equal keys. Clashing names of the right get `_2`."""
    rest_l = [c for c in left.columns if c != left_key]
    rest_r = [c for c in right.columns if c != right_key]
    taken = {c.lower() for c in [key, *rest_l]}
    renamed = [f"{c}_2" if c.lower() in taken else c for c in rest_r]
    r = right.select(F.col(right_key).alias("_key"), *[F.col(c).alias(n) for c, n in zip(rest_r, renamed)])
    return left.join(r, F.col(left_key) == F.col("_key")).select(F.col("_key").alias(key), *rest_l, *renamed)


def keep_repeated(df: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs more than once. The keys are counted ahead of the shuffle, and come back as a semi-join."""
    from fanloom.operators.match import repeated_values

    return df.join(repeated_values(df, key), key, "left_semi")


def compare_sets(left: DataFrame, right: DataFrame, distinct: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Multiset comparison: only in left, only in right, in both; nulls are equal to each other.

    One aggregation of both sides gives all three; with `distinct`, values are compared as sets.
    """
    names = left.columns
    if right.columns != names:
        raise PlanError(f"compare: columns {names} and {right.columns} differ")
    side = lambda df, l, r: df.select("*", F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = side(left, 1, 0).unionAll(side(right, 0, 1)).groupBy(*names).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    if distinct:
        both = both.withColumn("_l", F.least("_l", F.lit(1).cast("bigint"))).withColumn("_r", F.least("_r", F.lit(1).cast("bigint")))

    times = lambda n: repeated(both.select(*names, n.alias("_n")), "_n")
    return times(F.col("_l") - F.col("_r")), times(F.col("_r") - F.col("_l")), times(F.least("_l", "_r"))


def compare_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """(only_left, only_right, both): how many records a multiset comparison gives on each side, from one aggregation."""
    names = left.columns
    both = left.select("*", F.lit(1).alias("_d"), F.lit(1).alias("_l")).unionAll(right.select("*", F.lit(-1).alias("_d"), F.lit(0).alias("_l"))).groupBy(*names).agg(F.sum("_d").alias("_d"), F.sum("_l").alias("_l"))
    return both.agg(
        F.coalesce(F.sum(F.greatest("_d", F.lit(0))), F.lit(0)).alias("only_left"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), F.lit(0))), F.lit(0)).alias("only_right"),
        F.coalesce(F.sum(F.least(F.col("_l"), F.col("_l") - F.col("_d"))), F.lit(0)).alias("both"),
    )


def with_tabs(streams: tuple[DataFrame, ...], value: str = "value") -> list[DataFrame]:
    """The comparison's outputs with 0, 1 and 2 leading tabs, the text form that tells them apart."""
    return [df.withColumn(value, F.concat(F.lit("\t" * i), F.col(value))) for i, df in enumerate(streams)]


def paste(streams: list[DataFrame], line: str = "line_no", value: str = "value", delimiter: str = "\t") -> DataFrame:
    """Records side by side by line number; channels that end early give empty fields.

    Line numbers must be dense. All channels go through one aggregation by line number, not a chain of outer joins.
    Channels that are projections of one parent need no paste: select them together.
    """
    marked = [df.select(line, F.struct(F.lit(i).alias("i"), F.col(value).alias("v")).alias("_c")) for i, df in enumerate(streams)]
    together = marked[0]
    for m in marked[1:]:
        together = together.unionAll(m)
    fields = [F.coalesce(F.max(F.when(F.col("_c.i") == i, F.col("_c.v"))), F.lit("")) for i in range(len(streams))]
    return together.groupBy(line).agg(F.concat_ws(delimiter, *fields).alias(value))


def first_difference(left: DataFrame, right: DataFrame, line: str = "line_no", value: str = "value") -> DataFrame:
    """One row (identical, line_no): whether two channels are the same, and the first line that differs, null if none."""
    l, r = left.select(line, F.struct(value).alias("_l")), right.select(line, F.struct(value).alias("_r"))
    differing = l.join(r, line, "full").where(~F.col("_l").eqNullSafe(F.col("_r")))
    return differing.agg((F.count("*") == 0).alias("identical"), F.min(line).alias(line))


def lookup(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """df with the columns of a stored value of one row, as scalar subqueries; null if the value is missing."""
    return df.select("*", *[one_row.select(F.max(c)).scalar().alias(c) for c in one_row.columns])


def _ranges(a: int, b: int) -> str:
    return f"{a + 1},{b}" if b - a > 1 else f"{b}" if b > a else f"{a}"


def edit_script(old: list[str], new: list[str], at_old: int = 0, at_new: int = 0) -> Iterator[str]:
    """The lines of a normal edit script from old to new, which begin behind the lines at_old and at_new of their texts."""
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        yield _ranges(at_old + a, at_old + b) + {"replace": "c", "delete": "d", "insert": "a"}[op] + _ranges(at_new + c, at_new + d)
        yield from ("< " + s for s in old[a:b])
        if op == "replace":
            yield "---"
        yield from ("> " + s for s in new[c:d])


#: Lines of a text that are compared in one go at most, and lines between anchors at least.
MOST, SPACING = 1 << 13, 1 << 10


def _anchors(sides: list[DataFrame], by: list[str], spacing: int, chunk: int) -> DataFrame:
    """(by, n0, n1, ...): places of lines that occur once in every text, in an order common to all; one in `spacing` lines of the first.

    sides hold (by, n, v). Of the lines that occur once, those are kept that follow all earlier ones and precede all later
    ones in every text, so any number of them can be cut at together.
    """
    marked = None
    for i, df in enumerate(sides):
        rows = df.select(*by, "v", F.lit(i).alias("i"), "n")
        marked = rows if marked is None else marked.unionAll(rows)
    of = lambda i: F.col("i") == i
    places = [F.max(F.when(of(i), F.col("n"))).alias(f"n{i}") for i in range(len(sides))]
    kept = marked.groupBy(*by, "v").agg(*places, *[F.count_if(of(i)).alias(f"c{i}") for i in range(len(sides))])
    for i in range(len(sides)):
        kept = kept.where(F.col(f"c{i}") == 1)
    kept = kept.select(*by, *[f"n{i}" for i in range(len(sides))])
    for i in range(1, len(sides)):
        here = F.col(f"n{i}")
        kept = ordered.extremes(kept, "n0", f"n{i}", tuple(by), chunk).where(F.coalesce(F.col("_before") < here, F.lit(True)) & F.coalesce(F.col("_after") > here, F.lit(True))).drop("_before", "_after")
    return kept.groupBy(*by, F.floor(F.col("n0") / spacing).alias("_g")).agg(F.min(F.struct(*[f"n{i}" for i in range(len(sides))])).alias("p")).select(*by, "p.*")


def _scripts(sides: list[DataFrame], line: str, value: str, script: Callable, group: str | None, most: int, spacing: int, chunk: int) -> DataFrame:
    """(group, line_no, value): what script gives for places and lists of lines, piece by piece.

    The texts are cut at common anchors. A stretch without any, longer than `most` lines, is cut every `most` lines in each
    text alike: what is made of the pieces is right together, if longer than it had to be. So no task holds more than `most`
    lines of a text at once, whatever the texts are.
    """
    by, each = (["_by"] if group else []), range(len(sides))
    # Texts may be the ends of long pipelines, and are read for anchors and for pieces.
    texts = [made_once(df.select(*([F.col(group).alias("_by")] if group else []), F.col(line).cast("bigint").alias("n"), F.coalesce(value, F.lit("")).alias("v")), *by, "n") for df in sides]
    anchors = made_once(_anchors(texts, by, spacing, chunk), *by, "n0")
    rows = None
    for i, df in enumerate(texts):
        hit = df.join(anchors.select(*by, F.col(f"n{i}").alias("n"), F.lit(1).alias("_a")), [*by, "n"], "left")
        cut = ordered.scan(hit, "n", {"segment": F.coalesce("_a", F.lit(0)).cast("bigint")}, {"_begun": F.col("_a").isNotNull()}, tuple(by), chunk=chunk)
        placed = cut.select(*by, "segment", F.floor((F.col("n") - F.coalesce("_begun", F.lit(1))) / most).alias("part"), F.lit(i).alias("i"), "n", "v")
        rows = placed if rows is None else rows.unionAll(placed)
    key = [*by, "segment", "part"]
    lists = [F.transform(F.array_sort(F.collect_list(F.when(F.col("i") == i, F.struct("n", "v")))), lambda x: x["v"]).alias(f"c{i}") for i in each]
    last = [F.max(F.when(F.col("i") == i, F.col("n"))).alias(f"m{i}") for i in each]
    # A piece's lines stand behind the last line of the pieces before it; one row for each piece.
    before = (Window.partitionBy(*by) if by else Window).orderBy("segment", "part").rowsBetween(Window.unboundedPreceding, -1)
    # Both readers of the rows use all their columns, so that they share the shuffle.
    rows = rows.repartition(*key)
    places = rows.groupBy(*key).agg(*last, F.max(F.octet_length("v")).alias("_width")).where("_width >= 0").select(*key, *[F.coalesce(F.max(f"m{i}").over(before), F.lit(0)).alias(f"e{i}") for i in each])
    same = None
    for k in key:
        equal = F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
        same = equal if same is None else same & equal
    pieces = rows.groupBy(*key).agg(*lists).alias("l").join(places.alias("r"), same).select("l.*", *[f"r.e{i}" for i in each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                one = b.slice(at, 1)
                r = one.to_pylist()[0]
                made = list(script([r[f"e{i}"] for i in each], [r[f"c{i}"] for i in each]))
                if made:
                    same_rows = pa.array([0] * len(made))
                    yield pa.RecordBatch.from_arrays([*[one.column(k).take(same_rows) for k in range(len(key))], pa.array(range(len(made)), pa.int32()), pa.array(made, pa.string())], [*key, "k", "value"])

    kinds = "".join(f"{k} {rows.schema[k].dataType.simpleString()}, " for k in key)
    made = pieces.mapInArrow(run, kinds + "k int, value string")
    if not group:
        return number_lines(made, ["segment", "part", "k"]).select("line_no", "value")
    place = F.row_number().over(Window.partitionBy("_by").orderBy("segment", "part", "k")).cast("bigint")
    return made.select(F.col("_by").alias(group), place.alias("line_no"), "value")


def diff(left: DataFrame, right: DataFrame, line: str = "line_no", value: str = "value", most: int = MOST, spacing: int = SPACING, chunk: int = ordered.CHUNK) -> DataFrame:
    """(line_no, value): an edit script from left to right. Line numbers must be dense, from 1; nulls are empty lines.

    Texts of any length: they are compared between lines that both hold once, each stretch on its own.
    """
    return _scripts([left, right], line, value, lambda at, c: edit_script(*c, *at), None, most, spacing, chunk)


def diff_from(base: DataFrame, others: list[DataFrame], line: str = "line_no", value: str = "value", reverse: bool = False) -> list[DataFrame]:
    """Edit scripts from one channel to each of the others, or from each of them to it."""
    return [diff(o, base, line, value) if reverse else diff(base, o, line, value) for o in others]


def patched(left: DataFrame, script: DataFrame, line: str = "line_no", value: str = "value") -> DataFrame:
    """(line_no, value): left with an edit script from it applied, which gives the right side back."""
    header = r"^([0-9]+)(?:,([0-9]+))?([acd])([0-9]+)(?:,([0-9]+))?$"
    part = lambda k: F.nullif(F.regexp_extract(value, header, k), F.lit(""))
    heads = script.select("line_no", part(1).cast("bigint").alias("a"), part(2).cast("bigint").alias("b"), part(3).alias("op"), part(4).cast("bigint").alias("c")).where("op IS NOT NULL")
    gone = heads.where("op <> 'a'").select(F.explode(F.sequence("a", F.coalesce("b", "a"))).alias(line))
    kept = left.join(gone, line, "left_anti").select(F.col(line).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("k"), value)
    # Lines that come in stand behind the left line that their header names; a change's behind those it replaces.
    known = ordered.last_match(script, "line_no", {"_head": F.col(value).rlike(header)})
    added = known.where(F.col(value).startswith("> ")).join(heads.select(F.col("line_no").alias("_head"), F.coalesce("b", "a").alias("a")), "_head").select("a", F.col("line_no").alias("k"), F.substring(value, 3, 1 << 30).alias(value))
    return number_lines(kept.unionAll(added), ["a", "k"]).select("line_no", value)


def diff_by_group(left: DataFrame, right: DataFrame, group: str, line: str = "line_no", value: str = "value", most: int = MOST, spacing: int = SPACING, chunk: int = ordered.CHUNK) -> DataFrame:
    """(group, line_no, value): an edit script per group, such as a file. Line numbers must be dense within it, from 1."""
    return _scripts([left, right], line, value, lambda at, c: edit_script(*c, *at), group, most, spacing, chunk)


def merge_script(mine: list[str], base: list[str], yours: list[str], behind: tuple[int, ...] | list[int] = (0, 0, 0)) -> Iterator[str]:
    """Regions where three texts are not all the same: a header that names the odd one out, then each text's lines."""
    texts = [mine, base, yours]
    same = [{}, {}]
    for k, other in enumerate((mine, yours)):
        for m in difflib.SequenceMatcher(None, base, other, autojunk=False).get_matching_blocks():
            same[k] |= {m.a + i: m.b + i for i in range(m.size)}
    at = [0, 0, 0]
    anchors = [(same[0][i], i, same[1][i]) for i in range(len(base)) if i in same[0] and i in same[1]] + [(len(mine), len(base), len(yours))]
    for stop in anchors:
        parts = [t[a:b] for t, a, b in zip(texts, at, stop)]
        if any(parts):
            odd = [i for i in range(3) if parts[(i + 1) % 3] == parts[(i + 2) % 3]]
            yield "====" + (str(odd[0] + 1) if odd else "")
            for i, (p, a, b) in enumerate(zip(parts, at, stop)):
                yield f"{i + 1}:{_ranges(behind[i] + a, behind[i] + b)}{'c' if p else 'a'}"
                if not (odd and i != odd[0] and i == min(x for x in range(3) if x != odd[0])):
                    yield from ("  " + s for s in p)
        at = [x + 1 for x in stop]


def diff3(mine: DataFrame, base: DataFrame, yours: DataFrame, line: str = "line_no", value: str = "value", most: int = MOST, spacing: int = SPACING, chunk: int = ordered.CHUNK) -> DataFrame:
    """(line_no, value): where three channels differ, found as diff() does. Line numbers must be dense, from 1."""
    return _scripts([mine, base, yours], line, value, lambda at, c: merge_script(*c, at), None, most, spacing, chunk)

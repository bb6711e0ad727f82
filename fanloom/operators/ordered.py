"""Operators that depend on the order of records, without sorting everything into one task.

Order is an integer column. Rows are windowed within chunks of it; what crosses a chunk's edge comes from a summary with
one row per chunk (and key), so the only window without a partition runs over rows/CHUNK rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanloom.stream import number_lines

CHUNK = 1 << 20


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / chunk))


def _same(by: list[str], left: str = "l", right: str = "r") -> Column:
    out = F.col(f"{left}._chunk") == F.col(f"{right}._chunk")
    for b in by:
        out = out & F.col(f"{left}.{b}").eqNullSafe(F.col(f"{right}.{b}"))
    return out


def _with_summary(rows: DataFrame, summary: DataFrame, by: list[str], extra: list[str]) -> DataFrame:
    return rows.alias("l").join(summary.alias("r"), _same(by)).select("l.*", *[f"r.{c}" for c in extra])


def previous(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), name: str = "previous", chunk: int = CHUNK) -> DataFrame:
    """df with the value of the record before (within `by`), and `has_<name>`, false for the first record."""
    by = list(by)
    rows = _chunked(df, order, chunk)
    near = Window.partitionBy(*by, "_chunk").orderBy(order)
    rows = rows.withColumn("_first", F.row_number().over(near) == 1).withColumn("_lag", F.lag(value).over(near))
    ends = rows.groupBy(*by, "_chunk").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    edges = ends.withColumn("_edge", F.lag("_end").over((Window.partitionBy(*by) if by else Window).orderBy("_chunk"))).drop("_end")
    joined = _with_summary(rows, edges, by, ["_edge"])
    return (
        joined.withColumn(name, F.when(F.col("_first"), F.col("_edge.v")).otherwise(F.col("_lag")))
        .withColumn(f"has_{name}", ~F.col("_first") | F.col("_edge").isNotNull())
        .drop("_chunk", "_first", "_lag", "_edge")
    )


def scan(df: DataFrame, order: str, sums: dict[str, Column], lasts: dict[str, Column], by: tuple[str, ...] = (), inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """df with running sums, and for each condition the order of the last record that meets it, in one pass.

    With the record itself, or up to the one before. A sum over nothing is 0, and the last of none is null.
    """
    by = list(by)
    values = [(n, F.sum, c) for n, c in sums.items()] + [(n, F.max, F.when(c, F.col(order))) for n, c in lasts.items()]
    rows = _chunked(df, order, chunk).select("*", *[c.alias(f"_v_{n}") for n, _, c in values])
    near = Window.partitionBy(*by, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    far = (Window.partitionBy(*by) if by else Window).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "_chunk").agg(*[f(f"_v_{n}").alias(f"_t_{n}") for n, f, _ in values])
    before = ends.select(*by, "_chunk", *[f(f"_t_{n}").over(far).alias(f"_s_{n}") for n, f, _ in values])
    within = rows.select("*", *[f(f"_v_{n}").over(near).alias(f"_w_{n}") for n, f, _ in values])
    joined = _with_summary(within, before, by, [f"_s_{n}" for n, *_ in values])
    nought = F.lit(0)
    for n, f, _ in values:
        here, there = F.col(f"_w_{n}"), F.col(f"_s_{n}")
        joined = joined.withColumn(n, F.coalesce(here, nought) + F.coalesce(there, nought) if f is F.sum else F.coalesce(here, there))
    return joined.drop("_chunk", *[f"_{x}_{n}" for n, *_ in values for x in "vws"])


def running(df: DataFrame, order: str, sums: dict[str, Column], by: tuple[str, ...] = (), inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """df with running sums in order, with the record itself or up to the one before."""
    return scan(df, order, sums, {}, by, inclusive, chunk)


def last_match(df: DataFrame, order: str, hits: dict[str, Column], by: tuple[str, ...] = (), inclusive: bool = True, chunk: int = CHUNK) -> DataFrame:
    """df with, for each condition, the order of the last record so far that meets it, with the record itself or before it; null if none."""
    return scan(df, order, {}, hits, by, inclusive, chunk)


def extremes(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """df with `_before`, the largest value of the records before each, and `_after`, the smallest of those behind it; null if none."""
    by, rows = list(by), _chunked(df, order, chunk)
    # What lies behind a record is what lies before it in descending order; frames that begin at a record would be gone through again for each.
    back = lambda keys, c: Window.partitionBy(*keys).orderBy(c).rowsBetween(Window.unboundedPreceding, -1)
    near, far = [*by, "_chunk"], by
    ends = rows.groupBy(*by, "_chunk").agg(F.max(value).alias("_most"), F.min(value).alias("_least"))
    outer = ends.select(*by, "_chunk", F.max("_most").over(back(far, F.asc("_chunk"))).alias("_most"), F.min("_least").over(back(far, F.desc("_chunk"))).alias("_least"))
    inner = rows.select("*", F.max(value).over(back(near, F.asc(order))).alias("_before"), F.min(value).over(back(near, F.desc(order))).alias("_after"))
    joined = _with_summary(inner, outer, by, ["_most", "_least"])
    return joined.withColumn("_before", F.greatest("_before", "_most")).withColumn("_after", F.least("_after", "_least")).drop("_chunk", "_most", "_least")


def pattern_range(df: DataFrame, order: str, begins: Column, ends: Column, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Records from one that begins a range to the next one after it that ends it, both included; ranges may follow each other.

    An open range runs to the last record. A record that meets both conditions begins a range, or continues the one it is in.
    """
    started = last_match(df, order, {"_begun": F.coalesce(begins, F.lit(False))}, by, True, chunk)
    only_ends = F.coalesce(ends, F.lit(False)) & ~F.coalesce(begins, F.lit(False))
    both = last_match(started, order, {"_ended": only_ends}, by, False, chunk)
    return both.where(F.col("_begun").isNotNull() & (F.col("_ended").isNull() | (F.col("_begun") > F.col("_ended")))).drop("_begun", "_ended")


def squeeze(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Records whose value differs from the one before: repeats are dropped only where they follow each other."""
    rows = previous(df, order, value, by, "_previous", chunk)
    return rows.where(~F.col("has__previous") | ~F.col(value).eqNullSafe(F.col("_previous"))).drop("_previous", "has__previous")


def run_lengths(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """(by, run, value, length, first): runs of equal consecutive values, numbered in order; first is the run's first order.

    Rows are windowed once, within chunks, and reduced to the chunk's own runs. A summary with one row per chunk then tells
    how many runs there are before it, and whether its first run goes on with the last one of the chunk before.
    """
    by = list(by)
    near = Window.partitionBy(*by, "_chunk").orderBy("_order")
    rows = _chunked(df.select(*by, F.col(order).alias("_order"), F.struct(F.col(value).alias("v")).alias("_value")), "_order", chunk)
    rows = rows.withColumn("_new", (F.row_number().over(near) > 1) & (F.lag("_value").over(near) != F.col("_value")))
    rows = rows.withColumn("_local", F.count_if("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    local = rows.groupBy(*by, "_chunk", "_local").agg(F.first("_value").alias("_value"), F.count("*").alias("_n"), F.min("_order").alias("_first"))
    ends = local.groupBy(*by, "_chunk").agg(F.min_by("_value", "_local").alias("_head"), F.max_by("_value", "_local").alias("_end"), F.count("*").alias("_runs"))
    far = (Window.partitionBy(*by) if by else Window).orderBy("_chunk")
    joined = ends.withColumn("_opens", F.coalesce(F.lag("_end").over(far) != F.col("_head"), F.lit(True)).cast("bigint"))
    base = F.sum(F.col("_opens") + F.col("_runs") - 1).over(far.rowsBetween(Window.unboundedPreceding, -1))
    shifts = joined.select(*by, "_chunk", (F.coalesce(base, F.lit(0)) + F.col("_opens")).alias("_base"))
    numbered = _with_summary(local, shifts, by, ["_base"]).withColumn("run", F.col("_local") + F.col("_base"))
    runs = numbered.groupBy(*by, "run").agg(F.first("_value").alias("_value"), F.sum("_n").alias("length"), F.min("_first").alias("first"))
    return runs.select(*by, "run", F.col("_value.v").alias(value), "length", "first")


def context(df: DataFrame, line: str, matches: Column, before: int, after: int, by: tuple[str, ...] = (), chunk: int = CHUNK) -> DataFrame:
    """Lines that match, and those up to before/after lines around them, once each; `matched` tells which.

    `line` must be dense within `by`. Lines near the edge of a chunk are also put into the next one, so one shuffle and one
    window find the matches around each line.
    """
    n = F.col(line).cast("bigint")
    edges = F.array_distinct(F.array(F.floor(n / chunk), F.floor((n - before) / chunk), F.floor((n + after) / chunk)))
    rows = df.withColumn("matched", F.coalesce(matches, F.lit(False))).withColumn("_chunk", F.explode(edges))
    near = Window.partitionBy(*by, "_chunk").orderBy(n).rangeBetween(-after, before)
    around = rows.withColumn("_near", F.max("matched").over(near))
    return around.where(F.col("_near") & (F.col("_chunk") == F.floor(n / chunk))).drop("_chunk", "_near")


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last n records."""
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def sort_numeric(value: str, descending: bool = False) -> list[Column]:
    """Sort keys of a numeric sort of text: the leading number, 0 if there is none; ties by the whole line, in the same direction."""
    return sort_keys(value, numeric=True, descending=descending)


def sort_from_field(value: str, field: int, delimiter: str | None = None) -> list[Column]:
    """Sort keys from a field (counted from 1) to the end of the line; ties by the whole line."""
    return sort_keys(value, field, delimiter)


def sort_keys(value: str, field: int | None = None, delimiter: str | None = None, numeric: bool = False, descending: bool = False, ties_descending: bool | None = None, last: int | None = None) -> list[Column]:
    """Sort keys of the line, or of its part from a field on (up to field `last`, if given), as text or by the number it begins with; ties by the whole line, in the same direction unless told."""
    key = F.col(value)
    if field:
        skip = rf"^(?:[ \t]*[^ \t]+){{{field - 1}}}" if delimiter is None else rf"^(?:[^{_quote(delimiter)}]*[{_quote(delimiter)}]){{{field - 1}}}"
        key = F.when(F.col(value).rlike(skip), F.regexp_replace(value, skip, "")).otherwise("")
    if last:
        n, d = last - (field or 1), _quote(delimiter or " ")
        key = F.regexp_extract(key, rf"^[ \t]*[^ \t]*(?:[ \t]+[^ \t]+){{0,{n}}}" if delimiter is None else rf"^[^{d}]*(?:[{d}][^{d}]*){{0,{n}}}", 0)
    if numeric:
        key = F.coalesce(F.regexp_extract(key, r"^[ \t]*(-?[0-9]+(?:\.[0-9]*)?|-?\.[0-9]+)", 1).try_cast("double"), F.lit(0.0))
    ties_descending = descending if ties_descending is None else ties_descending
    return [key.desc() if descending else key.asc(), F.col(value).desc() if ties_descending else F.col(value).asc()]


def _quote(c: str) -> str:
    return "\\" + c if not c.isalnum() else c


def top_k(df: DataFrame, key: Column, k: int, name: str = "item") -> DataFrame:
    """The k most frequent values, ties in descending order of the value: (count, item)."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("count"))
    return counts.orderBy(F.col("count").desc(), F.col(name).desc()).limit(k)


def top_k_sum(df: DataFrame, key: Column, amount: Column, k: int, name: str = "item") -> DataFrame:
    """The k values with the largest sums, ties in descending order of the value: (total, item)."""
    sums = df.groupBy(key.alias(name)).agg(F.sum(amount).alias("total"))
    return sums.orderBy(F.col("total").desc(), F.col(name).desc()).limit(k)


def two_sided_places(counts: DataFrame, key: str, count: str) -> DataFrame:
    """counts with `place`: ranked by count, the odd ranks fill places from the left, the even ones from the right."""
    ranked = number_lines(counts, [count, key], "_rank")
    n = counts.agg(F.count("*")).scalar()
    return ranked.withColumn("place", F.when(F.col("_rank") % 2 == 1, F.floor((F.col("_rank") - 1) / 2)).otherwise(n - F.floor(F.col("_rank") / 2)).cast("bigint")).drop("_rank")

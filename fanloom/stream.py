"""Streams of records with an explicit order, and ordered bundles of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fanloom.session import free_name, shuffle_partitions


class PlanError(ValueError):
    """A graph that cannot be planned; the message names the stages at fault."""


@dataclass(frozen=True)
class Stream:
    """A channel: records and the columns that order them; dense if that is line_no, and it counts from 1 without gaps."""

    df: DataFrame
    order: tuple[str, ...] = ("line_no",)
    dense: bool = False

    def map(self, fn) -> Stream:
        return Stream(fn(self.df), self.order)


@dataclass(frozen=True)
class Bundle:
    """The channels between two stages, in order."""

    streams: tuple[Stream, ...] = field(default_factory=tuple)

    def __len__(self) -> int:
        return len(self.streams)

    def __getitem__(self, i: int) -> Stream:
        return self.streams[i]


def literal(spark, *lines: str) -> Stream:
    """A channel of given lines."""
    return Stream(spark.createDataFrame([(i, s) for i, s in enumerate(lines, 1)], "line_no bigint, value string"), dense=True)


def enumerate_channels(spark, n: int) -> Bundle:
    """n channels; channel i holds the one record i, counted from 0."""
    return Bundle(tuple(literal(spark, str(i)) for i in range(n)))


def number_lines(df: DataFrame, order: list, name: str = "line_no", copies: str | None = None) -> DataFrame:
    """df with dense line numbers from 1 in the given order (columns or sort expressions), without bringing all rows to one task.

    copies names a column that says how many equal records a row stands for; all of them come out, and the column goes, so
    that a record with a third of all copies is sorted once.

    Rows are range-partitioned, sorted, and placed within their partition; each partition sends its size to those after it,
    as one row each, and a running sum puts these ahead of the rows they shift. Nothing runs before the result is asked for.
    """
    parts = shuffle_partitions(df.sparkSession)
    part, at, size = (free_name(x, [*df.columns, name]) for x in ("_part", "_at", "_size"))
    n_columns, where = len(df.columns), df.columns.index(copies) if copies else None

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, me, schema = 0, None, None
        for b in batches:
            if not b.num_rows:
                continue
            me, schema = b.column(n_columns)[0].as_py(), b.schema
            n = b.column(where).to_numpy() if where is not None else np.ones(b.num_rows, np.int64)
            first = total + 1 + np.concatenate([[0], np.cumsum(n)[:-1]])
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first), pa.nulls(b.num_rows, pa.int64())], [*b.schema.names, at, size])
        if me is not None and me + 1 < parts:
            later = np.arange(me + 1, parts, dtype=np.int32)
            nothing = [pa.nulls(len(later), f.type) for f in list(schema)[:n_columns]]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(later), pa.array(np.zeros(len(later), np.int64)), pa.array(np.full(len(later), total))], [*schema.names, at, size])

    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id())
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema], T.StructField(part, T.IntegerType()), T.StructField(at, T.LongType()), T.StructField(size, T.LongType())])
    sent = ranged.mapInArrow(placed, schema)
    before = F.sum(size).over(Window.partitionBy(part).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    shifted = sent.withColumn(name, F.col(at) + F.coalesce(before, F.lit(0))).where(F.col(at) > 0).drop(part, at, size)
    return repeated(shifted, copies, name) if copies else shifted


def repeated(df: DataFrame, copies: str, name: str | None = None, block: int = 1 << 14) -> DataFrame:
    """Every row as often as `copies` says, that column gone; `name` counts on from its value in the row.

    In blocks, so that a row with a billion copies needs no array of that length.
    """
    n, b = F.col(copies).cast("bigint"), free_name("_block", df.columns)
    i = free_name("_i", [*df.columns, b])
    blocks = df.where(n > 0).withColumn(b, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((n - 1) / block))))
    each = blocks.withColumn(i, F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(block).cast("bigint"), n - F.col(b) * block) - 1)))
    kept = each.withColumn(name, F.col(name) + F.col(b) * block + F.col(i)) if name else each
    return kept.drop(copies, b, i)


def gather(bundle: Bundle) -> Stream:
    """All channels after one another: channel 1 in full, then channel 2, and so on; `channel` counts from 1."""
    if not len(bundle):
        raise PlanError("gather: no channels")
    if isinstance(bundle, Scattered):
        return bundle.gathered()
    order, parts = bundle[0].order, [s.df for s in bundle.streams]
    if any(s.order != order for s in bundle.streams):
        # Channels that are ordered by different columns get one in common.
        place = free_name("place_no", [c for df in parts for c in df.columns])
        parts, order = [number_lines(s.df, list(s.order), place) for s in bundle.streams], (place,)
    out = parts[0].withColumn("channel", F.lit(1))
    for i, p in enumerate(parts[1:], 2):
        out = out.unionByName(p.withColumn("channel", F.lit(i)), allowMissingColumns=True)
    return Stream(out, ("channel", *order))


def group_copy(bundle: Bundle, n_out: int) -> Bundle:
    """N channels copied to k*N: a, b to six are a, b, a, b, a, b."""
    if not len(bundle) or n_out % len(bundle):
        raise PlanError(f"tee: {n_out} outputs are no multiple of {len(bundle)} inputs")
    return Bundle(bundle.streams * (n_out // len(bundle)))


def group_gather(bundle: Bundle, n_out: int) -> Bundle:
    """k*N channels gathered to N by stride: a..f to two are a, c, e and b, d, f."""
    if not n_out or len(bundle) % n_out:
        raise PlanError(f"cat: {len(bundle)} inputs are no multiple of {n_out} outputs")
    return Bundle(tuple(gather(Bundle(bundle.streams[i::n_out])) for i in range(n_out)))


def permute(bundle: Bundle, places: list[int]) -> Bundle:
    """Input i goes to output places[i], both counted from 1; every output must be given once."""
    if len(places) != len(bundle) or sorted(places) != list(range(1, len(bundle) + 1)):
        raise PlanError(f"perm: {places} does not place {len(bundle)} inputs on as many outputs")
    by_place = {p: s for p, s in zip(places, bundle.streams)}
    return Bundle(tuple(by_place[p] for p in sorted(by_place)))


class Scattered(Bundle):
    """The channels of one scattered stream. They are one table with a column for the channel until one of them is asked for.

    A stage that does the same in every channel runs once over that table, so scattering adds no scans.
    """

    def __init__(self, whole: Stream, n: int, place: str):
        split = tuple(whole.map(lambda df, i=i: df.where(F.col(place) == i).drop(place)) for i in range(n))
        super().__init__(split)
        object.__setattr__(self, "whole", whole)
        object.__setattr__(self, "place", place)

    def map(self, fn) -> Scattered:
        """fn(stream, column of the channel) over all channels at once; it has to keep that column."""
        return Scattered(fn(self.whole, self.place), len(self), self.place)

    def gathered(self) -> Stream:
        taken = self.whole.df.withColumn("channel", F.col(self.place) + 1)
        return Stream(taken if self.place == "channel" else taken.drop(self.place), ("channel", *self.whole.order))


def scatter(stream: Stream, n: int, keys: list[str] | None = None) -> Scattered:
    """Each record to one of n channels, by a hash of its keys (all columns by default), so that a rerun gives the same."""
    place = free_name("channel_no", stream.df.columns)
    return Scattered(stream.map(lambda df: df.withColumn(place, F.pmod(F.xxhash64(*(keys or df.columns)), F.lit(n)).cast("int"))), n, place)

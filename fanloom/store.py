"""Stored values: written once by a stream, read any number of times, also before the place where they are written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanloom.stream import PlanError, Stream

UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400}


def last_record(stream: Stream, value: str = "value") -> DataFrame:
    """One row: the last record's value, '' over an empty stream."""
    order = F.struct(*stream.order) if len(stream.order) > 1 else F.col(stream.order[0])
    return stream.df.agg(F.coalesce(F.max_by(value, order), F.lit("")).alias(value))


def record_window(df: DataFrame, order: str, begin: int = 1, end: int = 0) -> DataFrame:
    """The records from the begin-th up to, but without, the end-th from the end; none if there are fewer than begin.

    The last `begin` records are found by one bounded top-n, not by ranking all.
    """
    if not 0 <= end < begin:
        raise PlanError(f"store: a window from {begin} to {end} holds nothing")
    last = df.orderBy(F.col(order).desc()).limit(begin)
    ranked = last.withColumn("_from_end", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col(order).desc())))
    ranked = ranked.withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(0))))
    return ranked.where((F.col("_n") >= begin) & (F.col("_from_end") > end)).drop("_from_end", "_n")


def time_window(df: DataFrame, time: str, begin: float, end: float = 0, unit: str = "s") -> DataFrame:
    """The records of the last begin units before the latest time, without those of the last end units."""
    if unit not in UNITS or not 0 <= end < begin:
        raise PlanError(f"store: no window from {begin} to {end} {unit}")
    now = df.agg(F.max(time)).scalar()
    back = lambda n: F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(n * UNITS[unit])))
    return df.where((F.col(time) > now - back(begin)) & (F.col(time) <= now - back(end)))


class Stores:
    """Named values of one graph. Each is defined once; definitions may read others, in any order but no cycle."""

    def __init__(self):
        self._makers: dict[str, Callable[[], DataFrame]] = {}
        self._made: dict[str, DataFrame] = {}
        self._open: list[str] = []

    def write(self, name: str, maker: Callable[[], DataFrame] | DataFrame) -> None:
        if name in self._makers:
            raise PlanError(f"store {name} is written twice")
        self._makers[name] = maker if callable(maker) else lambda: maker

    def read(self, name: str) -> DataFrame:
        """The store's one row; it is planned when first read."""
        if name not in self._makers:
            raise PlanError(f"store {name} is read but never written")
        if name in self._open:
            raise PlanError(f"stores read each other in a cycle: {' -> '.join([*self._open, name])}")
        if name not in self._made:
            self._open.append(name)
            try:
                self._made[name] = self._makers[name]()
            finally:
                self._open.pop()
        return self._made[name]

    def value(self, name: str, column: str = "value") -> Column:
        """The value as a scalar subquery, for use in any expression."""
        return self.read(name).select(column).scalar()

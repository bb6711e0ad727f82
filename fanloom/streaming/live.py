"""Streams that never end: stored values kept current, sliding windows of records and time, event-time windows."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fanloom.store import UNITS
from fanloom.stream import PlanError


class LiveStore:
    """A value kept current by a streaming query; readers may ask at any time, also for what there is at the end.

    With a folder, each batch's result is written there and the newest complete one read, so a store may hold any number of
    rows; the one before stays for its readers. Without, it is held by the driver, which is for stores of a few rows.
    output says what a batch brings: `complete` all of the result; `update` the rows that have changed, which replace those
    of equal keys; `append` further rows.
    """

    def __init__(self, name: str, stream: DataFrame, checkpoint: str | None = None, output: str = "complete", folder: str | None = None, keys: tuple[str, ...] = (), once: bool = False):
        self.name, self._spark, self._schema, self.folder, self.keys = name, stream.sparkSession, stream.schema, folder, list(keys)
        self._newest: int | None = None
        self._parts: list[int] = []  # batches that make up the value, where they add up
        if output == "update" and folder and not keys:
            raise PlanError(f"store {name}: rows that change need keys")
        if folder is None:
            writer = stream.writeStream.format("memory").queryName(name).outputMode(output)
        else:
            writer = stream.writeStream.queryName(name).outputMode(output).foreachBatch(self._write)
        self._adds = output == "append"
        writer = writer.trigger(availableNow=True) if once else writer
        self.query: StreamingQuery = (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()

    def _write(self, batch: DataFrame, number: int) -> None:
        if self.keys and self._newest is not None:
            batch = batch.unionByName(self.current().join(batch.select(*self.keys).distinct(), self.keys, "left_anti"))
        batch.write.mode("overwrite").parquet(f"{self.folder}/{number}")
        before, self._newest = self._newest, number
        if self._adds:
            self._parts.append(number)
        elif before is not None and before > 0:
            path = self._spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{before - 1}")
            path.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(path, True)

    def current(self) -> DataFrame:
        """What has been stored so far; no rows before the first record."""
        if self.folder is None:
            return self._spark.table(self.name)
        if self._newest is None:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*[f"{self.folder}/{i}" for i in self._parts or [self._newest]])

    def current_or_empty(self, column: str = "value") -> DataFrame:
        """One row at least: the current value, or ''."""
        return self.current().agg(F.coalesce(F.max(F.col(column).cast("string")), F.lit("")).alias(column))

    def first(self, seconds: float = 60.0, column: str = "value") -> DataFrame:
        """The current value once there is one; waits up to `seconds` for it, and raises TimeoutError after that."""
        until = time.monotonic() + seconds
        while self.current().where(F.col(column).isNotNull()).isEmpty():
            if self.query.exception() or time.monotonic() > until:
                raise TimeoutError(f"store {self.name} has no value after {seconds} s")
            time.sleep(0.05)
        return self.current()

    def last(self) -> DataFrame:
        """The value once everything that is there has been taken in."""
        self.query.processAllAvailable()
        if self.query.exception():
            raise self.query.exception()
        return self.current()

    def stop(self) -> None:
        self.query.stop()


def latest(stream: DataFrame, order: str, value: str) -> DataFrame:
    """The last record so far, as a streaming aggregate of one row."""
    return stream.groupBy().agg(F.max_by(value, order).alias(value))


def last_records(stream: DataFrame, key: str, order: str, value: str, begin: int, end: int = 0) -> DataFrame:
    """(key, values): for each key, the begin-th up to, but without, the end-th record from the end, each time it changes.

    The state holds no more than `begin` records per key.
    """
    if not 0 <= end < begin:
        raise PlanError(f"store: a window from {begin} to {end} holds nothing")
    kind = stream.schema[key].dataType.simpleString()

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        for b in batches:  # cut after each, so no more than a batch is held
            held = sorted(held + list(zip(b[order].tolist(), b[value].astype(str).tolist())))[-begin:]
        state.update(([x for x, _ in held], [v for _, v in held]))
        shown = [v for _, v in held[: len(held) - end]] if len(held) >= begin else []
        if shown:
            yield pd.DataFrame({key: [k[0]], "values": [shown]})

    return stream.select(key, F.col(order).cast("bigint").alias(order), F.col(value).cast("string").alias(value)).groupBy(key).applyInPandasWithState(
        keep, f"{key} {kind}, values array<string>", "orders array<bigint>, texts array<string>", "update", GroupStateTimeout.NoTimeout
    )


def last_span(stream: DataFrame, key: str, time: str, value: str, begin: float, end: float = 0, unit: str = "s") -> DataFrame:
    """(key, values): for each key, the records of the last begin units before its latest time, without those of the last end units, each time they change.

    Times are event times, a column of the records; records that come late but within the span still count. The state holds
    a key's records of the span, and nothing older.
    """
    if unit not in UNITS or not 0 <= end < begin:
        raise PlanError(f"store: no window from {begin} to {end} {unit}")
    kind, longest, shortest = stream.schema[key].dataType.simpleString(), int(begin * UNITS[unit] * 1e6), int(end * UNITS[unit] * 1e6)

    def keep(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = [tuple(x) for x in zip(*state.get)] if state.exists else []
        before = [v for t, v in held if t <= held[-1][0] - shortest]
        for b in batches:
            held = sorted(held + list(zip(b["at"].tolist(), b[value].astype(str).tolist())))
            held = [x for x in held if x[0] > held[-1][0] - longest]
        state.update(([t for t, _ in held], [v for _, v in held]))
        shown = [v for t, v in held if t <= held[-1][0] - shortest] if held else []
        if shown != before:
            yield pd.DataFrame({key: [k[0]], "values": [shown]})

    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = stream.where(F.col(time).isNotNull()).select(key, at.alias("at"), F.col(value).cast("string").alias(value))
    return rows.groupBy(key).applyInPandasWithState(keep, f"{key} {kind}, values array<string>", "times array<bigint>, texts array<string>", "update", GroupStateTimeout.NoTimeout)


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], sums: dict[str, Column], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Aggregates per window of event time; `late` bounds how long a stream waits for late rows. Batch tables work the same."""
    timed = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = timed.groupBy(F.window(time, width, slide).alias("w"), *keys).agg(F.count("*").alias("n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    return grouped.select(F.col("w.start").alias("started"), F.col("w.end").alias("ended"), *keys, "n", *sums)


def activity_sessions(df: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Sessions per key that end after a gap without events."""
    timed = df.withWatermark(time, late) if late and df.isStreaming else df
    grouped = timed.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return grouped.select(*keys, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def once_per_id(stream: DataFrame, ids: list[str], time: str, late: str) -> DataFrame:
    """Each record once, where deliveries are repeated within `late` of each other."""
    if not stream.isStreaming:
        return stream.dropDuplicates(ids)
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def monitored(df: DataFrame, name: str, value: str = "value") -> tuple[DataFrame, object]:
    """df with counters of the lines and bytes that pass, and the observation that holds them once it has run."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("nlines"), F.coalesce(F.sum(F.octet_length(value) + 1), F.lit(0)).alias("nbytes")), seen

"""What has passed a point of a graph, record by record."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom.operators.ordered import running


def monitor(df: DataFrame, order: str, value: str, by: tuple[str, ...] = (), time: str | None = None) -> DataFrame:
    """(by, order, nlines, nbytes, data): lines and bytes before each record, and the record.

    With a time column also atime, its seconds since 1970, and rtime, seconds since the first record.
    """
    counted = running(df, order, {"nlines": F.lit(1).cast("bigint"), "nbytes": (F.octet_length(F.coalesce(value, F.lit(""))) + 1).cast("bigint")}, by, inclusive=False)
    times = []
    if time:
        seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
        first = df.agg(F.min(seconds)).scalar()
        times = [seconds.alias("atime"), (seconds - first).alias("rtime")]
    return counted.select(*by, order, *times, "nlines", "nbytes", F.col(value).alias("data"))


def as_json(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(F.to_json(F.struct(*columns)).alias("value"))

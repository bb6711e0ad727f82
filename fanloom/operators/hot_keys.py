"""Per-key totals that stay balanced when a few keys hold most rows.

Every map task folds its rows into a hash table of mergeable key states (count and sums); Spark's partial
HashAggregate is that table, bounded by the task's memory, and spills when full. Of totals_by_key() only the states
shuffle, so a key that holds a third of all rows sends one row per map task to its reducer, not its records. Where
records can be delivered again, distinct_records() comes first, and shuffles them by their id, which no key makes uneven.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.functions.weblog import host_key, url_key


def distinct_records(df: DataFrame, ids: list[Column], keys: dict[str, Column], measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per record, of a table in which records may be delivered again with the same keys.

    ids identify a record; keys are the same in all its deliveries; of a measure that differs, the largest counts.
    The shuffle is on ids and keys, which are near unique, so no key makes it uneven, and all that is kept besides them
    is of fixed width, so both aggregations hash and need no sort.
    A null id is an id like any other: rows alike in it and in all keys are one record.
    """
    names = [f"id{i}" for i in range(len(ids))]
    rows = df.select(*[c.alias(n) for c, n in zip(ids, names)], *[c.alias(k) for k, c in keys.items()], *[c.alias(m) for m, c in (measures or {}).items()])
    if len(keys) > 1:
        rows = rows.where(F.coalesce(*[F.col(k).cast("string") for k in keys]).isNotNull())
    else:
        rows = rows.dropna(subset=list(keys))
    grouped = rows.groupBy(*names, *keys)
    out = grouped.agg(*[F.max(m).alias(m) for m in measures]) if measures else rows.distinct()
    return out.drop(*names)


def totals_by_key(records: DataFrame, fields: list[str], measures: list[str] = ()) -> DataFrame:
    """Totals per key of each field, in one pass: (field, item, requests, one sum per measure).

    Null keys take no part. An empty table gives no rows. A measure that is null everywhere for a key sums to null.
    Grouping sets expand each record once per field ahead of the map-side tables, so all fields share one shuffle.
    """
    per_field = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields])).alias("key")
    return (
        records.select(per_field, *measures)
        .select("key.field", "key.item", *measures)
        .where(F.col("item").isNotNull())
        .groupBy("field", "item")
        .agg(F.count("*").alias("requests"), *[F.sum(m).alias(m) for m in measures])
    )


def with_share(totals: DataFrame) -> DataFrame:
    """totals with `share`, each key's part of the requests of its field.

    The sums per field are one row per field name, a number fixed by the caller's list of fields, and are broadcast.
    """
    sums = totals.groupBy("field").agg(F.sum("requests").alias("field_requests"))
    return totals.join(F.broadcast(sums), "field").withColumn("share", F.col("requests") / F.col("field_requests"))


def weblog_totals(log: DataFrame) -> DataFrame:
    """(field, item, requests, bytes, field_requests, share) for every host_key and url_key of a parsed access log.

    A request counts once however often its line_no was delivered, with the largest byte count among the deliveries.
    Requests without a usable host count for their url and the reverse. Null and negative byte counts add nothing.
    """
    size = F.when(F.col("bytes") >= 0, F.col("bytes")).otherwise(F.lit(0).cast("bigint")).alias("bytes")
    records = distinct_records(log, [F.col("line_no")], {"host": host_key(F.col("host")), "url": url_key(F.col("url"))}, {"bytes": size})
    return with_share(totals_by_key(records, ["host", "url"], ["bytes"]))


def hot_keys(log: DataFrame, least_share: float = 0.02) -> DataFrame:
    """Keys that hold at least least_share of the requests with a usable key of their field: (field, item)."""
    return weblog_totals(log).where(F.col("requests") >= F.col("field_requests") * least_share).select("field", "item")

"""Exact distinct counts of identifiers per group and combination of groups, by hash ranges.

The identifiers' hashes are cut into disjoint buckets. Within a bucket the pairs of identifier and groups are held once
each, and counted exactly for every combination of groups; as no identifier is in two buckets, counts of buckets add up.
The error is zero. Bucket counts are the mergeable partial results: those of other buckets can be added at any time.

Pairs are first made distinct where they are read, and spread by identifier and groups together, so an identifier that
holds a third of all rows reaches its bucket only as its distinct pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.session import free_name, shuffle_partitions


def bucket_counts(df: DataFrame, identifier: Column, groups: dict[str, Column], sets: list[tuple[str, ...]], buckets: int | None = None) -> DataFrame:
    """(bucket, in_set, group columns, n): distinct identifiers per bucket, for each set of groups.

    in_set is the position in `sets`; groups outside a set are null there. Rows with a null identifier take no part; a
    null group is a group of its own. By default there are four buckets per shuffle partition. Groups called bucket,
    in_set or n keep their names, and those columns are numbered.
    """
    buckets = buckets or 4 * shuffle_partitions(df.sparkSession)
    names = list(groups)
    bucket, in_set, n = _names(names)
    pairs = df.select(identifier.alias("_id"), *[c.alias(g) for g, c in groups.items()]).where(F.col("_id").isNotNull()).distinct()
    placed = pairs.withColumn(bucket, F.pmod(F.xxhash64("_id"), F.lit(buckets)).cast("int")).repartition(bucket)
    types = dict(pairs.dtypes)
    combined = F.explode(F.array(*[F.struct(F.lit(i).alias(in_set), *[(F.col(g) if g in s else F.lit(None).cast(types[g])).alias(g) for g in names]) for i, s in enumerate(sets)])).alias("_c")
    once = placed.select(bucket, "_id", combined).select(bucket, "_id", "_c.*").distinct()
    return once.groupBy(bucket, in_set, *names).agg(F.count("*").alias(n))


def _names(groups: list[str]) -> tuple[str, ...]:
    return tuple(free_name(x, groups) for x in ("bucket", "in_set", "n"))


def add_buckets(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(in_set, group columns, n) over all buckets."""
    _, in_set, n = _names(groups)
    return counts.groupBy(in_set, *groups).agg(F.sum(n).alias(n))


def distinct_counts(df: DataFrame, identifier: Column, groups: dict[str, Column], sets: list[tuple[str, ...]], buckets: int | None = None) -> DataFrame:
    """Exact distinct counts for each set of groups; an empty table gives no rows."""
    return add_buckets(bucket_counts(df, identifier, groups, sets, buckets), list(groups))

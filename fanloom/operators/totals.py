"""Aggregates: counts, sizes, frequencies, partial counts, and files."""

from __future__ import annotations

import bz2
import lzma
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.operators.project import number


def byte_size(value: Column) -> Column:
    """Bytes of all records, each with its line end."""
    return F.coalesce(F.sum(F.octet_length(F.coalesce(value, F.lit(""))) + 1), F.lit(0)).cast("bigint")


def guarded_average(value: Column) -> Column:
    """The average, 0 over nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def fused(df: DataFrame, branches: dict[str, Column]) -> DataFrame:
    """Aggregates of several branches of one input in one pass; a branch that filters does so within its aggregate."""
    return df.agg(*[c.alias(n) for n, c in branches.items()])


def frequencies(df: DataFrame, item: Column, name: str = "item") -> DataFrame:
    return df.groupBy(item.alias(name)).agg(F.count("*").alias("count"))


def with_percentage(counts: DataFrame, total: Column, count: str = "count") -> DataFrame:
    """counts with each count's percentage of a total, such as a scalar subquery."""
    return counts.withColumn("percent", F.col(count) / total * 100)


def merge_sum(parts: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Totals of partial counts from any number of channels, in any order; Spark combines them ahead of the shuffle."""
    return parts.groupBy(key).agg(F.sum(value).alias(value))


def parse_partial(value: Column) -> tuple[Column, Column]:
    """The count and the key of a line `count key`; leading blanks are skipped, blanks in the key stay; null for other lines. Counts have up to 38 digits."""
    line = r"(?s)^\s*([0-9]+)\s+(.*)\z"
    hit = value.rlike(line)
    return F.when(hit, F.regexp_extract(value, line, 1).try_cast("decimal(38,0)")), F.when(hit, F.regexp_extract(value, line, 2))


def sum_of_field(text: Column) -> Column:
    return F.coalesce(F.sum(number(text)), F.lit(0))


def members(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """df with n, the number of its key's rows, for keys that have at least `least`. Null keys take no part.

    One row for each, so a key may have any number of them; only the counts are grouped.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return df.join(counts, key)


def listed(df: DataFrame, key: str, item: str, separator: str = " ", least: int = 1, shown: Callable[[Column], Column] | None = None, parts: int = 64) -> DataFrame:
    """(key, items, n): the items of each key that has at least `least`, in order on one line; n is how many they are.

    `shown` makes the text of an item once they are in order, so that numbers are ordered as numbers. Null keys and items
    take no part. Items are gathered in `parts` parts of a key, and the parts' lists put together. A line is one value; for
    keys with more items than fit into one, members() gives a row for each.
    """
    rows = df.select(key, F.col(item).alias("_item")).where(F.col(key).isNotNull() & F.col("_item").isNotNull())
    lists = rows.groupBy(key, F.pmod(F.xxhash64("_item"), F.lit(parts)).alias("_part")).agg(F.collect_list("_item").alias("_items"))
    whole = lists.groupBy(key).agg(F.sum(F.size("_items")).alias("n"), F.array_sort(F.flatten(F.collect_list("_items"))).alias("_items")).where(F.col("n") >= least)
    texts = F.transform("_items", shown) if shown else F.col("_items")
    return whole.select(key, F.array_join(texts, separator).alias("items"), "n")


def same_content(files: DataFrame, path: str, content: str, shown: Callable[[Column], Column] | None = None) -> DataFrame:
    """Paths of equal content on one line: (digest, items, n) for contents that occur more than once."""
    return listed(files.select(F.md5(F.col(content).cast("binary")).alias("digest"), path), "digest", path, least=2, shown=shown)


def compressed_sizes(files: DataFrame, content: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, bytes, xz, bzip2, gzip): sizes of each content, and compressed; null content counts as empty."""
    kinds = ", ".join(f"{k} {files.schema[k].dataType.simpleString()}" for k in keep)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(len(keep)).to_pylist()]
            packed = [[f(x) for x in raw] for f in (len, lambda x: len(lzma.compress(x)), lambda x: len(bz2.compress(x)), lambda x: len(zlib.compress(x, wbits=31)))]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keep))], *[pa.array(p, pa.int64()) for p in packed]], [*keep, "bytes", "xz", "bzip2", "gzip"])

    return files.select(*keep, F.col(content).cast("binary").alias("_content")).mapInArrow(sizes, (kinds + ", " if kinds else "") + "bytes bigint, xz bigint, bzip2 bigint, gzip bigint")


def presence(df: DataFrame, day: str, item: str) -> DataFrame:
    """(day, item): the items seen on every day from the first to the last, once each; a null item on days without any."""
    span = df.agg(F.min(day).alias("a"), F.max(day).alias("b")).where("a IS NOT NULL")
    calendar = span.select(F.explode(F.sequence("a", "b")).alias(day))
    return calendar.join(df.select(day, item).distinct(), day, "left")


def text_kind(content: Column) -> Column:
    """A guess at the kind of a content from its first bytes."""
    start = F.hex(F.substring(content.cast("binary"), 1, 6))
    kinds = {"1F8B": "gzip", "425A68": "bzip2", "FD377A585A00": "xz", "89504E47": "png", "25504446": "pdf", "504B0304": "zip"}
    out = F.when(F.octet_length(content) == 0, "empty")
    for magic, kind in kinds.items():
        out = out.when(start.startswith(magic), kind)
    return out.when(F.is_valid_utf8(content.cast("binary").cast("string")), "text").otherwise("data")

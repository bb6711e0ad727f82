"""Files as streams of records, and streams as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fanloom.operators.records import RECORD, parse_line, text_records
from fanloom.stream import Stream


def read_lines(spark: SparkSession, *paths: str, terminator: str | None = None) -> Stream:
    """(file_no, path, line_no, value): records of the files in the order given, a file's lines numbered from 1.

    Compressed files are read by their extension. A split's first line number is the number of lines in the splits before
    it, which is counted first; that summary has one row per split.
    """
    parts = None
    for i, p in enumerate(paths, 1):
        reader = spark.read.option("lineSep", terminator) if terminator is not None else spark.read
        rows = reader.text(p).select(F.lit(i).alias("file_no"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
        sizes = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        shifts = sizes.select("path", "_block", (before - F.col("_first") + 1).alias("_shift"))
        numbered = rows.join(F.broadcast(shifts), ["path", "_block"]).select("file_no", "path", (F.col("_id") + F.col("_shift")).alias("line_no"), "value")
        parts = numbered if parts is None else parts.unionAll(numbered)
    return Stream(parts, ("file_no", "path", "line_no"))


def fixed_width(files: DataFrame, length: int, content: str = "content", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keep, line_no, value): records of `length` bytes each, as binary; bytes after the last whole record are left out."""
    n = F.floor(F.length(content) / length).cast("int")
    numbers = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return files.select(*keep, content, F.explode(numbers).alias("line_no")).select(*keep, "line_no", F.substring(content, (F.col("line_no") - 1) * length + 1, F.lit(length)).alias("value"))


def read_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder)


def list_files(spark: SparkSession, folder: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, length, modified); contents are not read."""
    return read_files(spark, folder, glob, recursive).select("path", "length", F.col("modificationTime").alias("modified"))


def read_log(spark: SparkSession, *paths: str, terminator: str | None = None) -> DataFrame:
    """Typed requests of log files with `reason` and `error_at` for lines that do not load, one line per record."""
    lines = read_lines(spark, *paths, terminator=terminator).df
    return lines.withColumn("record", parse_line(F.col("value"))).select("file_no", "path", "line_no", "value", *[f"record.{f.name}" for f in RECORD])


def read_log_files(spark: SparkSession, *paths: str, terminator: str | None = None) -> DataFrame:
    """(path, line_no, lines, columns of RECORD): typed requests of log files in which quotes may run over line ends."""
    return text_records(read_lines(spark, *paths, terminator=terminator).df)


def read_delimited(spark: SparkSession, *paths: str, delimiter: str = ",", null: str = "\\N", header: bool = False, schema: str | None = None) -> DataFrame:
    """Quote-aware delimited files; cut() of the operators is the form in which quotes have no meaning."""
    reader = spark.read.option("sep", delimiter).option("nullValue", null).option("header", header).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(list(paths))


def read_xml_rows(spark: SparkSession, path: str, tag: str, schema: str | None = None) -> DataFrame:
    """One row per element of the given tag."""
    reader = spark.read.format("xml").option("rowTag", tag)
    return (reader.schema(schema) if schema else reader).load(path)


def read_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(i, x): one number per line, counted from 0; lines that are none are null."""
    lines = read_lines(spark, path).df
    return lines.select((F.col("line_no") - 1).alias("i"), F.btrim("value").try_cast("double").alias("x"))


def write_lines(df: DataFrame, path: str, value: str = "value", append: bool = False, compression: str | None = None, terminator: str = "\n") -> None:
    """Text files; append adds to what is there."""
    writer = df.select(F.col(value).cast("string")).write.mode("append" if append else "overwrite").option("lineSep", terminator)
    (writer.option("compression", compression) if compression else writer).text(path)


def write_by_file(df: DataFrame, folder: str, path: str, order: list[str], value: str = "value") -> None:
    """One folder of lines for each path, `path=...` with the path encoded, lines in order."""
    rows = df.select(F.col(path).alias("path"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(order)], F.col(value).cast("string").alias("value"))
    rows.repartition("path").sortWithinPartitions("path", *[f"_{i}" for i in range(len(order))]).select("path", "value").write.mode("overwrite").partitionBy("path").option("lineSep", "\n").text(folder)


def write_to_all(df: DataFrame, paths: list[str], value: str = "value", append: bool = False) -> None:
    """The same records to several places; computed once and kept meanwhile."""
    kept = df.persist()
    try:
        for p in paths:
            write_lines(kept, p, value, append)
    finally:
        kept.unpersist()

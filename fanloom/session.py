"""Session set-up and the few things that depend on the cluster."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The setting by which a session asks for rows to be spread ahead of costly work.
SPREAD = "spark.fanloom.spread"


def local_session(cores: str | int = "*", partitions: int = 8, app: str = "fanloom") -> SparkSession:
    """A single-machine session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config(SPREAD, "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores ahead of costly work on each row, if the session asks for that by the setting SPREAD.

    For a single machine, whose tables are files of one row group, which no scan can split. Not set, as on a cluster, tables
    are read where they lie. Either way, the plan does not depend on how large they are.
    """
    if df.sparkSession.conf.get(SPREAD, "false") != "true":
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files that a program writes and reads again: below the shared one that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all runs on this machine, as in tests, a folder of this machine is used.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="fanloom-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(base: str, taken) -> str:
    """base, or base with the first number that clashes with none of the names taken (case is ignored, as in Spark)."""
    used, name, k = {t.lower() for t in taken}, base, 0
    while name.lower() in used:
        k += 1
        name = f"{base}_{k}"
    return name

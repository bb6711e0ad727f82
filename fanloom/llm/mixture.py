"""Mixing sources to target shares of the tokens.

Tokens are summed per source; a source's rate is its share of the mixture's size over its tokens, but at most its cap on
repeats. Each document is then given floor(rate) times, and once more with the rate's fraction as probability, by a hash
of its id and a seed, so a run can be repeated and any task can be lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fanloom.llm.bpe import BYTE_BPE_50K, token_count
from fanloom.fuse import made_once
from fanloom.session import free_name

#: Parts into which a source's documents are spread when they meet their rate.
PARTS = 64


def measured(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", path: str = BYTE_BPE_50K) -> DataFrame:
    """(doc_id, source, tokens) of each document; null and empty texts have none."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text), path).alias("tokens"))


def kept(sizes: DataFrame) -> DataFrame:
    """What measured() gives, for several readers of one query, who share it: texts are tokenised once."""
    return made_once(sizes, "doc_id", "source")


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets: (source, target_share, max_repeats, tokens, size, wanted, rate, falls_short).

    sizes holds (source, tokens), any number of rows per source. size is the mixture's size, the tokens of all documents
    whose source is in targets. A source without tokens has rate 0 and falls short unless its share is 0. A source given
    several times in targets counts once, with the largest share and cap; a null share is 0, a null cap 1, a null source
    no source. targets is a table of settings, so its few rows are put into one window.
    """
    wanted = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    table = wanted.join(held, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    table = table.withColumn("size", F.sum("tokens").over(Window.partitionBy(F.lit(0)))).withColumn("wanted", F.col("target_share") * F.col("size"))
    rate = F.when(F.col("tokens") > 0, F.least(F.col("wanted") / F.nullif("tokens", F.lit(0)), F.col("max_repeats").cast("double"))).otherwise(F.lit(0.0))
    return table.withColumn("rate", rate).withColumn("falls_short", F.col("max_repeats") * F.col("tokens") < F.col("wanted"))


def _fraction(seed: int, *ids: Column) -> Column:
    """A number in [0, 1) that depends on seed and ids alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(1 << 53)) / F.lit(float(1 << 53))


def copies(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """docs (doc_id, source and any other columns) with `copies`, how often each goes into the mixture; those of no source in plan are left out.

    Null ids are ids like any other, so documents without one are used or left out together. The new column is numbered
    if its name is taken.
    """
    whole = F.floor("_rate")
    drawn = (_fraction(seed, F.col("doc_id")) < F.col("_rate") - whole).cast("bigint")
    # A source's rate is repeated for every part, and its documents spread over the parts, so no source is one task's.
    rated = plan.select("source", F.col("rate").alias("_rate"), F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("_part"))
    placed = docs.withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int"))
    return placed.join(rated, ["source", "_part"]).select(*docs.columns, (whole + drawn).alias(free_name("copies", docs.columns)))


def mixture(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """The documents of the mixture, one row per use, numbered by `use` from 1."""
    n, use = free_name("copies", docs.columns), free_name("use", docs.columns)
    return copies(docs, plan, seed).where(F.col(n) > 0).withColumn(use, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).drop(n)


def reached(docs: DataFrame, plan: DataFrame, seed: int = 17) -> DataFrame:
    """plan with what the mixture of docs (doc_id, source, tokens) really holds: mixed_tokens and mixed_share.

    The share is 0 where the whole mixture is empty.
    """
    held = copies(docs.select("doc_id", "source", "tokens"), plan, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    table = plan.join(held, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))
    return table.withColumn("mixed_share", F.coalesce(F.col("mixed_tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))

"""What branches of one input share: one pass for aggregates and projections, one kept copy for the rest."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse_totals(df: DataFrame, branches: dict[str, tuple[Column | None, Column]]) -> DataFrame:
    """One row with every branch's total: (condition or None, aggregate argument summed); one pass instead of one per branch."""
    return df.agg(*[F.coalesce(F.sum(F.when(c, a) if c is not None else a), F.lit(0)).alias(n) for n, (c, a) in branches.items()])


def fuse_columns(df: DataFrame, branches: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """Row-wise branches of one parent side by side, as one projection instead of a paste."""
    return df.select(*keep, *[c.alias(n) for n, c in branches.items()])


_kept: ContextVar[list[DataFrame] | None] = ContextVar("kept", default=None)


@contextmanager
def keeping() -> Iterator[None]:
    """While this is open, what several branches of a graph read is kept: spilled to disk where memory is short, redone if lost.

    For runs that end within it; a plan that is only handed on should not hold storage, and is left to Spark's own sharing
    of equal shuffles.
    """
    token = _kept.set([])
    try:
        yield
    finally:
        for df in _kept.get():
            df.unpersist()
        _kept.reset(token)


def shared(df: DataFrame, consumers: int) -> DataFrame:
    """df, kept for its consumers if there are several that cannot be fused, and a keeping() is open."""
    kept = _kept.get()
    if consumers < 2 or kept is None:
        return df
    if not df.is_cached:
        df.persist(StorageLevel.MEMORY_AND_DISK)
        kept.append(df)
    return df


def made_once(df: DataFrame, *keys: str) -> DataFrame:
    """df for several readers within one query, made once: it passes a shuffle by its keys, which the readers share.

    Rows are handed on behind it as they are, so that no reader's choice of columns changes what is planned below.
    """
    return df.repartition(*keys).mapInArrow(lambda batches: batches, df.schema)

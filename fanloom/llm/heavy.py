"""Most frequent items, by a majority-vote sketch of fixed size.

The sketch has rows of cells; a row's hash puts each item into one of its cells. A cell stores the total of its items, a
candidate, and the candidate's surplus of votes after every vote for it was cancelled against one for another item. Cells
merge by vote cancellation: votes for the same candidate add up, and what the strongest has beyond all others together
stays. That merge is a sum by candidate followed by one comparison, so its result does not depend on the order of merging.

An item's count lies, in each of its cells, between the surplus (if it is the candidate) or 0, and
(total + surplus) / 2 if it is the candidate, (total - surplus) / 2 if not; the tightest of its cells holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS, CELL_BITS = 4, 11
_CELLS = "field string, row int, cell int, candidate string, total bigint, surplus bigint"


def _check(bits: int) -> None:
    if not 1 <= bits <= 64 // ROWS:
        raise ValueError(f"{ROWS} rows take their cells from one hash of 64 bits, so cells have 1 to {64 // ROWS} bits")


class Sketch:
    """The cells of one task for one field: ROWS x 2**bits, whatever it is fed."""

    def __init__(self, bits: int = CELL_BITS):
        _check(bits)
        self.bits = bits
        self.total = np.zeros((ROWS, 1 << bits), np.int64)
        self.surplus = np.zeros_like(self.total)
        self.hashed = np.zeros(self.total.shape, np.uint64)
        self.candidate = np.full(self.total.shape, None, object)

    def add(self, items: pa.Array, hashes: np.ndarray) -> None:
        """Feeds a batch: its items are counted exactly, then vote with their counts."""
        coded = items.dictionary_encode()
        codes = coded.indices.to_numpy()
        values = np.array(coded.dictionary.to_pylist(), object)
        count, h = np.bincount(codes, minlength=len(values)), np.empty(len(values), np.uint64)
        h[codes] = hashes.view(np.uint64)
        for r in range(ROWS):
            cell = ((h >> np.uint64(r * self.bits)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)
            np.add.at(self.total[r], cell, count)
            held = np.flatnonzero(self.surplus[r])
            cells, keys = np.concatenate([held, cell]), np.concatenate([self.hashed[r][held], h])
            votes, names = np.concatenate([self.surplus[r][held], count]), np.concatenate([self.candidate[r][held], values])
            order = np.lexsort((keys, cells))
            cells, keys, votes, names = cells[order], keys[order], votes[order], names[order]
            first = np.flatnonzero(np.concatenate([[True], (cells[1:] != cells[:-1]) | (keys[1:] != keys[:-1])]))
            cells, keys, votes, names = cells[first], keys[first], np.add.reduceat(votes, first), names[first]
            all_votes = np.zeros(1 << self.bits, np.int64)
            np.add.at(all_votes, cells, votes)
            order = np.lexsort((votes, cells))
            top = order[np.flatnonzero(np.concatenate([cells[order][1:] != cells[order][:-1], [True]]))]
            cells = cells[top]
            self.surplus[r][cells] = np.maximum(2 * votes[top] - all_votes[cells], 0)
            self.hashed[r][cells], self.candidate[r][cells] = keys[top], names[top]

    def cells(self, field: str) -> pa.RecordBatch:
        row, cell = np.nonzero(self.total)
        surplus = self.surplus[row, cell]
        names = [c if s else None for c, s in zip(self.candidate[row, cell], surplus.tolist())]
        columns = [pa.array([field] * len(row), pa.string()), pa.array(row, pa.int32()), pa.array(cell, pa.int32()), pa.array(names, pa.string()), pa.array(self.total[row, cell]), pa.array(surplus)]
        return pa.RecordBatch.from_arrays(columns, ["field", "row", "cell", "candidate", "total", "surplus"])


def _cell(item: Column, row: int, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(item), row * bits).bitwiseAND(F.lit((1 << bits) - 1).cast("bigint")).cast("int")


def sketch(df: DataFrame, fields: list[str], bits: int = CELL_BITS) -> DataFrame:
    """One sketch per field over all rows: (field, row, cell, candidate, total, surplus). Null items take no part.

    Sketches of other parts of the data can be added with merge(a.unionByName(b)).
    """

    _check(bits)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches = {f: Sketch(bits) for f in fields}
        for b in batches:
            for i, f in enumerate(fields):
                items, hashes = b.column(2 * i), b.column(2 * i + 1)
                usable = items.is_valid()
                if usable.true_count:
                    sketches[f].add(items.filter(usable), hashes.filter(usable).to_numpy())
        for f, s in sketches.items():
            yield s.cells(f)

    columns = [c for i, f in enumerate(fields) for c in (F.col(f).alias(f"item{i}"), F.xxhash64(f).alias(f"hash{i}"))]
    return merge(df.select(*columns).mapInArrow(build, _CELLS))


def merge(cells: DataFrame) -> DataFrame:
    """Cells of several sketches, put together by vote cancellation."""
    votes = cells.groupBy("field", "row", "cell", "candidate").agg(F.sum("total").alias("total"), F.sum("surplus").alias("surplus"))
    best = votes.groupBy("field", "row", "cell").agg(F.max_by("candidate", "surplus").alias("candidate"), F.sum("total").alias("total"), F.max("surplus").alias("best"), F.sum("surplus").alias("all"))
    left = F.greatest(2 * F.col("best") - F.col("all"), F.lit(0))
    merged = best.select("field", "row", "cell", F.when(left > 0, F.col("candidate")).alias("candidate"), "total", left.alias("surplus"))
    # Passed on as it is: the readers of different columns then share the plan below, and the sketch is built once.
    return merged.mapInArrow(lambda batches: batches, _CELLS)


def _sizes(cells: DataFrame) -> DataFrame:
    """(field, n): the number of items of each field; every row of the sketch holds all of them."""
    return cells.where(F.col("row") == 0).groupBy("field").agg(F.sum("total").alias("n"))


def candidates(cells: DataFrame, bits: int = CELL_BITS) -> DataFrame:
    """(field, item, at_least, at_most, n): every candidate with its bounds, and the number n of its field's items.

    At most ROWS x 2**bits items per field, whatever the data.
    """
    named = cells.where(F.col("candidate").isNotNull()).select("field", F.col("candidate").alias("item")).distinct()
    place = F.explode(F.array(*[F.struct(F.lit(r).alias("row"), _cell(F.col("item"), r, bits).alias("cell")) for r in range(ROWS)])).alias("p")
    placed = named.select("field", "item", place).select("field", "item", "p.row", "p.cell").join(cells, ["field", "row", "cell"])
    mine = F.coalesce(F.col("candidate") == F.col("item"), F.lit(False))
    low, high = F.when(mine, F.col("surplus")).otherwise(F.lit(0)), F.floor((F.col("total") + F.when(mine, F.col("surplus")).otherwise(-F.col("surplus"))) / 2)
    bounds = placed.groupBy("field", "item").agg(F.max(low).alias("at_least"), F.min(high).alias("at_most"))
    return bounds.join(_sizes(cells), "field")


def frequent(df: DataFrame, fields: list[str], least_share: float, bits: int = CELL_BITS) -> DataFrame:
    """Candidates that can hold least_share of their field's items or more, with bounds: (field, item, at_least, at_most, n).

    An item of that share is no candidate only if, in each of its ROWS cells, the other items together have at least as
    many votes; frequent_exactly() finds those too. An empty table, or only null items, gives no rows. Ties and repeated
    rows count as any others.
    """
    return candidates(sketch(df, fields, bits), bits).where(F.col("at_most") >= F.col("n") * least_share)


def frequent_exactly(df: DataFrame, fields: list[str], least_share: float, bits: int = CELL_BITS) -> DataFrame:
    """All items that hold at least least_share of their field's items, with exact counts: (field, item, n, count).

    A second pass counts the candidates that the sketch's bounds allow, and those items which could be hidden: all their
    cells must leave room for an item of that share beside the candidate. Few cells do, at most 1 / (2 * least_share) in
    a row, so few items pass. Candidates and cells are bounded by the sketch's size, and are broadcast.
    """
    cells = sketch(df, fields, bits)
    found = candidates(cells, bits).where(F.col("at_most") >= F.col("n") * least_share).select("field", "item", F.lit(True).alias("_candidate"))
    sized = cells.join(F.broadcast(_sizes(cells)), "field")
    room = F.when((F.col("total") - F.col("surplus")) / 2 >= F.col("n") * least_share, F.col("row") * (1 << bits) + F.col("cell"))
    rooms = sized.groupBy("field", "n").agg(F.collect_set(room).alias("_rooms"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("item")) for f in fields])).alias("k")
    rows = df.select(each).select("k.field", "k.item").where(F.col("item").isNotNull())
    hidden = F.lit(True)
    for r in range(ROWS):
        hidden = hidden & F.array_contains("_rooms", _cell(F.col("item"), r, bits) + r * (1 << bits))
    kept = rows.join(F.broadcast(rooms), "field").join(F.broadcast(found), ["field", "item"], "left").where(F.col("_candidate").isNotNull() | hidden)
    return kept.groupBy("field", "item", "n").agg(F.count("*").alias("count")).where(F.col("count") >= F.col("n") * least_share)

"""How often every distinct term occurs, and in how many records, with marks on those too rare or too common.

Blocks of records are counted in two arrays, occurrences and records, over the block's own dictionary; a block is bounded by
its number of distinct terms. The blocks' terms, each once a block, then meet in RANGES ranges of their hash, where the
global dictionary gives each distinct term an integer: the range, and the term's place in it in byte order. Every block's
counts are encoded with these identifiers, come out of the dictionary in their order, and are added up in arrays over ranges
of PLACES identifiers, one such range after the other. A term that makes up most of the text is one number per block.

Identifiers depend on the set of terms alone, not on the cluster. With the dictionary of an earlier run, its terms keep
their identifiers and new terms follow, so encoded data stays valid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: what separates words; other Unicode spaces, and the vertical tab, are part of words.
WORD_BREAK = "[ \t\n\r\f]+"
_PARTIAL = "term string, occurrences bigint, records bigint"
#: Ranges of the terms' hash, the bits of a place in them, and identifiers in one count array. Lasting: identifiers depend on the first two.
RANGES, _PLACE_BITS, PLACES = 4096, 40, 1 << 16


def _counts(terms: pa.Array, weight: np.ndarray | None, record: np.ndarray | None) -> pa.Table:
    """The block's dictionary with its two count arrays. record: the record of each term; None if each is one of its own."""
    coded = terms.dictionary_encode()
    codes, n = coded.indices.to_numpy(), len(coded.dictionary)
    occurrences = np.bincount(codes, minlength=n) if weight is None else np.zeros(n, np.int64)
    if weight is not None:
        np.add.at(occurrences, codes, weight)
    once = codes if record is None else np.unique(record * n + codes) % max(n, 1)
    return pa.table([coded.dictionary, pa.array(occurrences.astype(np.int64)), pa.array(np.bincount(once, minlength=n).astype(np.int64))], names=["term", "occurrences", "records"])


def _sum(parts: list[pa.Table]) -> pa.Table:
    """Count arrays of several blocks, over one dictionary in byte order."""
    t = pa.concat_tables(parts)
    coded = t["term"].combine_chunks().dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    ids = place[coded.indices.to_numpy()]
    sums = []
    for c in ("occurrences", "records"):
        total = np.zeros(len(order), np.int64)
        np.add.at(total, ids, t[c].to_numpy())
        sums.append(pa.array(total))
    return pa.table([coded.dictionary.take(pa.array(order)), *sums], names=["term", "occurrences", "records"])


def _blocks(parts: Iterator[pa.Table], most_terms: int) -> Iterator[pa.RecordBatch]:
    """Puts batches together to blocks of at least most_terms distinct terms (or the task's end), and gives them out."""
    held, rows = [], 0
    for t in parts:
        held.append(t)
        rows += t.num_rows
        if rows > 2 * most_terms:
            held = [_sum(held)]
            rows = held[0].num_rows
            if rows > most_terms:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from _sum(held).to_batches()


def words_by_block(records: DataFrame, text: str, most_terms: int = 200_000) -> DataFrame:
    """Block counts of the words of a text column in which each row is one record."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            lists = pc.split_pattern_regex(b[0], WORD_BREAK)
            words, record = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
            real = pc.not_equal(words, "")
            yield _counts(words.filter(real), None, record[real.to_numpy(zero_copy_only=False)])

    return records.select(text).mapInArrow(lambda it: _blocks(split(it), most_terms), _PARTIAL)


def keys_by_block(counts: DataFrame, most_terms: int = 200_000) -> DataFrame:
    """Block counts of rows (term, weight), one for each record that holds the term."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for b in batches:
            yield _counts(b["term"], b["weight"].to_numpy(), None)

    return counts.select("term", "weight").mapInArrow(lambda it: _blocks(keyed(it), most_terms), _PARTIAL)


def encoded(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(term_id, term, occurrences, records): the blocks' counts under the identifiers of the global dictionary, in their order within each partition.

    known (term_id, term) is a dictionary made before, whose identifiers are kept. The dictionary is a ranking within hash
    ranges, which reads sorted rows one after another, so no range has to fit into memory.
    """
    rows = blocks.select("term", "occurrences", "records", F.lit(None).cast("bigint").alias("_known"))
    if known is not None:
        rows = rows.unionAll(known.select("term", F.lit(0).cast("bigint"), F.lit(0).cast("bigint"), F.col("term_id")))
    placed = rows.withColumn("_range", F.pmod(F.xxhash64("term"), F.lit(RANGES)).cast("bigint")).repartition("_range")
    order = [F.col("term")]
    if known is not None:
        # Known terms first, by their identifiers, which fill the first places of their range.
        placed = placed.withColumn("_known", F.max("_known").over(Window.partitionBy("_range", "term")))
        order = [F.col("_known").asc_nulls_last(), F.col("term")]
    place = F.dense_rank().over(Window.partitionBy("_range").orderBy(*order)).cast("bigint") - 1
    return placed.select((F.shiftleft("_range", _PLACE_BITS) + place).alias("term_id"), "term", "occurrences", "records")


def dictionary(blocks: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(term_id, term) of every distinct term, to be stored and passed on as `known`."""
    return encoded(blocks, known).select("term_id", "term").distinct()


def sum_by_range(counts: DataFrame, places: int = PLACES) -> DataFrame:
    """(term_id, term, occurrences, records) summed over what encoded() gives.

    The rows of a partition come in the order of their identifiers. Their counts are added into arrays over a range of
    `places` identifiers; the arrays are given out when the identifiers leave the range, and begun anew.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(places, np.int64), np.zeros(places, np.int64)]
        terms: list[pa.Array] = []  # of the identifiers seen in the range, which come without gaps
        at, n, done = -1, 0, []

        def close() -> None:
            nonlocal n
            if n:
                done.append(pa.table([pa.array(at * places + np.arange(n)), pa.chunked_array(terms), *[pa.array(c[:n].copy()) for c in sums]], names=["term_id", "term", "occurrences", "records"]))
                for c in sums:
                    c[:n] = 0
                terms.clear()
                n = 0

        for b in batches:
            ids = b["term_id"].to_numpy()
            counts, which = [b[c].to_numpy() for c in ("occurrences", "records")], ids // places
            edges = [0, *(np.flatnonzero(which[1:] != which[:-1]) + 1).tolist(), len(ids)] if len(ids) else []
            for a, z in zip(edges, edges[1:]):
                if at != which[a]:
                    close()
                    at = int(which[a])
                place = ids[a:z] - at * places
                for c, x in zip(sums, counts):
                    np.add.at(c, place, x[a:z])
                new = np.flatnonzero(np.diff(place, prepend=n - 1))
                terms.append(b["term"].take(pa.array(a + new)))
                n = int(place[-1]) + 1
            if sum(t.num_rows for t in done) >= 10_000:
                yield from pa.concat_tables(done).combine_chunks().to_batches()
                done = []
        close()
        if done:
            yield from pa.concat_tables(done).combine_chunks().to_batches()

    return counts.mapInArrow(total, "term_id bigint, term string, occurrences bigint, records bigint")


def word_frequencies(df: DataFrame, text: str, ids: list[str], known: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Frequencies of the words in df's text column, and the number of records as a scalar subquery.

    A record is a distinct combination of ids, nulls included; if it was delivered several times, one delivery counts.
    Null, empty and blank texts are records without words. Words are compared exactly. known is a dictionary made before;
    its terms come out too, with no occurrences if there are none.
    """
    once = df.select(*ids, text).dropDuplicates(ids)
    return sum_by_range(encoded(words_by_block(once, text), known)), df.select(*ids).distinct().agg(F.count("*")).scalar()


def key_frequencies(df: DataFrame, key: Column, weight: Column, record: str, ids: list[str], known: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """Frequencies of weighted keys, and the number of distinct records (of all rows of df, null left out).

    A row is a distinct combination of ids. Rows with a null or empty key, or a null weight or one below 1, take no part.
    A record that holds a key several times counts once as a record.
    """
    named = [f"_id{i}" for i in range(len(ids))]
    once = df.select(*[F.col(c).alias(n) for c, n in zip(ids, named)], F.col(record).alias("_record"), key.alias("term"), weight.cast("bigint").alias("weight")).dropDuplicates(named)
    valid = once.where((F.col("term") != "") & (F.col("weight") >= 1))
    per_record = valid.groupBy("_record", "term").agg(F.sum("weight").alias("weight"))
    return sum_by_range(encoded(keys_by_block(per_record), known)), df.agg(F.count_distinct(record)).scalar()


def marked(frequencies: DataFrame, n_records: Column, rare: Column, common_share: float) -> DataFrame:
    """frequencies with mark: `rare`, `common` (in more than common_share of all records), or null."""
    return frequencies.withColumn("mark", F.when(rare, "rare").when(F.col("records") > n_records * F.lit(common_share), "common"))


def line_words(lines: DataFrame) -> DataFrame:
    """Words of text lines: rare in at most 2 records, common in more than 30 % of them."""
    found, n = word_frequencies(lines, "value", ["path", "line_no"])
    return marked(found, n, F.col("records") <= 2, 0.3)


def merged_keys(counts: DataFrame) -> DataFrame:
    """Keys of partial counts: rare with a total of at most 2, common in more than 60 % of the channels."""
    found, n = key_frequencies(counts, F.btrim("key", F.lit(" \t\r")), F.col("value"), "channel", ["channel", "seq"])
    return marked(found, n, F.col("occurrences") <= 2, 0.6)

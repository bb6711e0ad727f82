"""Sessions of activity, by Cartesian trees over the gaps between consecutive events.

The gaps between an entity's consecutive events, the largest at the root, form a Cartesian tree. A node of the tree is a
run of events that hangs together for every allowed gap from its own largest inner gap up to, but without, the smaller of
the two gaps around it (`gap <= allowed < parent_gap`). So the nodes of one tree hold the sessions for all settings, and a
setting is a filter.

Rows are first reduced to (entity, tick, events), each spread by its own id, so that no burst of one entity is one task's.
Trees are then built per entity and chunk of time, so that no entity, however busy, has to fit into one task. A chunk's
nodes that touch neither its first nor its last event are final. What does touch them, the two outer spines, is handed on
as a short list of items in which every finished subtree counts as one; the lists of an entity's neighbouring chunks, put
together with the gaps between chunks, go through the same construction: once for spans of SPAN chunks, and once for the
whole entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fanloom.functions.weblog import host_key, minute_text, request_minute
from fanloom.session import shuffle_partitions

NO_GAP = np.int64(2**62)  # stands for the unbounded gap at either end of an entity
#: Ticks of a chunk unless told, and chunks of a span, the level between chunks and entities.
CHUNK, SPAN = 128, 1024
_NODES = "entity string, start bigint, end bigint, events bigint, gap bigint, parent_gap bigint, open boolean"
_NAMES = ["entity", "start", "end", "events", "gap", "parent_gap", "open"]


def cartesian_tree(gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inner nodes of the tree over gaps: (position, left, right), in no set order, and the tied positions.

    gaps[i] lies before item i; gaps[0] and gaps[-1], past the last item, must be NO_GAP. left and right are the nearest
    positions on either side with a larger gap, so the node spans items left..right-1, and its parent is the one of the
    two with the smaller gap. Equal gaps that span the same items are one node, at the first of them; the others are
    returned as pairs (position, position of the node).
    """
    stack: list[int] = []  # the last position of each open node
    nodes: list[int] = []  # the first one
    heights: list[int] = []
    at, left, right, tied = [], [], [], []
    for i, g in enumerate(gaps.tolist()):
        while heights and heights[-1] < g:
            heights.pop()
            stack.pop()
            at.append(nodes.pop())
            left.append(stack[-1])
            right.append(i)
        if not heights or heights[-1] > g:
            stack.append(i)
            nodes.append(i)
            heights.append(g)
        else:
            stack[-1] = i
            if g != NO_GAP:
                tied.append((i, nodes[-1]))
    return np.array(at, np.int64), np.array(left, np.int64), np.array(right, np.int64), np.array(tied, np.int64).reshape(-1, 2)


def _build(start: np.ndarray, end: np.ndarray, events: np.ndarray, first: np.ndarray, leaf: np.ndarray, cut: int | None, closed: bool) -> tuple[np.ndarray, ...]:
    """Nodes over items of whole groups: (item at the start, start, end, events, gap, parent_gap, open).

    first marks each group's first item. leaf marks items that are to be given out themselves; others are roots of
    subtrees given out before. closed: groups are whole entities; otherwise what touches a group's ends comes out with
    open set, as items for the next level. cut: only what is a session for this allowed gap.
    """
    n = len(start)
    gaps = np.empty(n + 1, np.int64)
    gaps[1:n] = start[1:] - end[:-1]
    gaps[:n][first] = NO_GAP
    gaps[n] = NO_GAP
    at, lo, hi, tied = cartesian_tree(gaps)
    item = np.arange(n)
    lo, hi = np.concatenate([lo, item]), np.concatenate([hi, item + 1])
    gap = np.concatenate([gaps[at], np.zeros(n, np.int64)])
    given = np.concatenate([np.ones(len(at), bool), leaf])
    parent = np.minimum(gaps[lo], gaps[hi])
    outer = (gaps[lo] == NO_GAP) | (gaps[hi] == NO_GAP)
    total = np.concatenate([[0], np.cumsum(events)])
    if cut is not None:
        keep = (gap <= cut) & (parent > cut)
        is_open = outer & (not closed)
    elif closed:
        keep, is_open = given & (parent > gap), np.zeros(len(lo), bool)
    else:
        # Items for the next level: what lies between neighbouring gaps of the spines, and the nodes that are final.
        spine = gaps == NO_GAP
        spine[at[outer[: len(at)]]] = True
        spine[tied[:, 0]] = spine[tied[:, 1]]
        between = np.flatnonzero(spine)
        keep = given & ~outer & (parent > gap)
        a, b = between[:-1], between[1:]
        ends = (gaps[a] == NO_GAP) | (gaps[b] == NO_GAP)
        lo, hi = np.concatenate([lo[keep], a]), np.concatenate([hi[keep], b])
        gap = np.concatenate([gap[keep], np.where(ends & (b - a == 1) & leaf[a], 0, -1)])  # -1: given out already
        parent = np.concatenate([parent[keep], np.zeros(len(a), np.int64)])
        is_open = np.concatenate([np.zeros(int(keep.sum()), bool), np.ones(len(a), bool)])
        keep = np.ones(len(lo), bool)
    lo, hi, gap, parent, is_open = lo[keep], hi[keep], gap[keep], parent[keep], is_open[keep]
    return lo, start[lo], end[hi - 1], total[hi] - total[lo], gap, parent, is_open


class _Level:
    """One level of construction over a sorted partition; holds back the last group of a batch until its end is seen."""

    def __init__(self, groups: list[str], cut: int | None, closed: bool):
        self.groups, self.cut, self.closed = groups, cut, closed
        self.held: list[pa.RecordBatch] = []

    def _changes(self, t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for g in self.groups:
            x = t[g].combine_chunks()
            new[1:] |= pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        return new

    def _nodes(self, t: pa.Table) -> pa.RecordBatch:
        start, end, events, kind = (t[c].to_numpy() for c in ("start", "end", "events", "gap"))
        lo, *values = _build(start, end, events, self._changes(t), kind >= 0, self.cut, self.closed)
        entity = t["entity"].combine_chunks().take(pa.array(lo))
        return pa.RecordBatch.from_arrays([entity, *map(pa.array, values)], _NAMES)

    def push(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if not b.num_rows:
            return
        if self.held and all(b[g][b.num_rows - 1] == self.held[-1][g][0] for g in self.groups):
            self.held.append(b)  # to its end still the group held back
            return
        t = pa.Table.from_batches([*self.held, b])
        last = int(np.flatnonzero(self._changes(t))[-1])
        self.held = t.slice(last).to_batches()
        if last:
            yield self._nodes(t.slice(0, last))

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self._nodes(pa.Table.from_batches(self.held))


def activity(df: DataFrame, entity: Column, tick: Column, ids: list[Column] | None = None, chunk: int = CHUNK) -> DataFrame:
    """(entity, chunk, tick, events): events per entity and tick, each record once; partitioned by entity and chunk, the first of `chunk` ticks.

    ids identify a record that may be delivered again for the same entity and tick; without ids each row is an event.
    Rows with a null entity or tick take no part; a null id is an id like any other.

    Records are spread by entity, chunk and a part of their id's hash, and counted there by tick; the parts' counts are then
    added up. An entity with a third of all rows in one tick is so counted by all tasks, and gives one row for each of them.
    """
    names = [f"id{i}" for i in range(len(ids or []))]
    rows = df.select(entity.cast("string").alias("entity"), tick.cast("bigint").alias("tick"), *[c.alias(n) for c, n in zip(ids or [], names)]).dropna(subset=["entity", "tick"])
    key, at = ["entity", "chunk", "tick"], _start("tick", chunk)
    if names:
        # What is derived is computed again behind the shuffle, where Spark knows it by its expression, so it is not sent.
        part = F.pmod(F.xxhash64(*names), F.lit(shuffle_partitions(df.sparkSession))).cast("int")
        once = rows.repartition("entity", at, part).withColumn("chunk", at).withColumn("part", part).distinct()
        counted = once.groupBy(*key, "part").agg(F.count("*").alias("events")).select("entity", "tick", "events")
    else:
        counted = rows.groupBy("entity", "tick").agg(F.count("*").alias("events"))
    return counted.repartition("entity", at).withColumn("chunk", at).groupBy(*key).agg(F.sum("events").alias("events"))


def _start(tick: str, width: int) -> Column:
    """The first tick of the stretch of that width in which a tick lies."""
    return F.col(tick) - F.pmod(F.col(tick), F.lit(width).cast("bigint"))


def gap_tree(ticks: DataFrame, cut: int | None = None, chunk: int = CHUNK, span: int = SPAN) -> DataFrame:
    """Nodes of the merged trees over what activity() gives for chunks of `chunk` ticks: (entity, start, end, events, gap, parent_gap).

    Without cut, all nodes, to be stored once and read for many settings with sessions_at(). With cut, only the sessions
    for that allowed gap, which saves passing on the rest; a chunk then hands on two items at most, and so does a span.
    Ties (several events in one tick) are one leaf with its number of events; equal gaps make one node.
    An empty table gives no rows.
    """
    items = ticks.select("entity", "chunk", F.col("tick").alias("start"), F.col("tick").alias("end"), "events", F.lit(0).cast("bigint").alias("gap"))

    def level(group: list[str], closed: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            level = _Level(group, cut, closed)
            for b in batches:
                if "open" in b.schema.names:
                    yield b.filter(pc.invert(b["open"])).select(_NAMES)
                    b = b.filter(b["open"])
                yield from level.push(b)
            yield from level.finish()

        return run

    # Finished nodes and open items go through one shuffle, so each level runs once.
    made = items.sortWithinPartitions("entity", "start").mapInArrow(level(["entity", "chunk"], False), _NODES)
    spans = made.withColumn("span", _start("start", chunk * span)).repartition("entity", "span").sortWithinPartitions("entity", "start")
    made = spans.mapInArrow(level(["entity", "span"], False), _NODES)
    return made.repartition("entity").sortWithinPartitions("entity", "start").mapInArrow(level(["entity"], True), _NODES).drop("open")


def sessions_at(nodes: DataFrame, allowed: int) -> DataFrame:
    """The sessions in stored trees when gaps of up to `allowed` ticks stay within a session: a filter, no regrouping."""
    return nodes.where((F.col("gap") <= allowed) & (F.col("parent_gap") > allowed)).select("entity", "start", "end", "events")


def sessions(df: DataFrame, entity: Column, tick: Column, allowed: int, ids: list[Column] | None = None, chunk: int | None = None, span: int = SPAN) -> DataFrame:
    """(entity, start, end, duration, events): sessions of each entity, in ticks.

    A new session starts when more than `allowed` ticks have passed since the entity's previous event. Rows with a null
    entity or tick take no part; repeated deliveries of an id count once; an empty table gives no sessions.
    Chunks are four times the allowed gap, so their number depends on the time covered and not on how fine a tick is.
    """
    chunk = chunk or max(4 * allowed, 16)
    found = sessions_at(gap_tree(activity(df, entity, tick, ids, chunk), allowed, chunk, span), allowed)
    return found.withColumn("duration", F.col("end") - F.col("start"))


def weblog_sessions(log: DataFrame, minutes: int = 30) -> DataFrame:
    """(host_key, started, ended, duration, requests): sessions of every usable host, times as yyyy-MM-dd HH:mm."""
    found = sessions(log, host_key(F.col("host")), request_minute(F.col("day"), F.col("hour"), F.col("minute")), minutes, [F.col("line_no")])
    return found.select(F.col("entity").alias("host_key"), minute_text(F.col("start")).alias("started"), minute_text(F.col("end")).alias("ended"), "duration", F.col("events").alias("requests"))

"""Graphs of stages: built as values, checked and sized before anything runs, then compiled to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from fanloom.arity import ANY, Node, solve, unify
from fanloom.fuse import shared
from fanloom.stream import Bundle, PlanError, Scattered, Stream, gather, group_copy, group_gather, permute, scatter


class Stage:
    """A node with `takes` input and `gives` output channels, ANY if it adapts; `a | b` connects, block(...) sets side by side."""

    name: str
    takes: int
    gives: int

    def run(self, inputs: Bundle, n_out: int) -> Bundle:
        raise NotImplementedError

    def __or__(self, other: Stage) -> Stage:
        return Pipe(self, other)

    def least(self, side: str) -> int:
        """The fewest channels it `takes` or `gives`."""
        n = getattr(self, side)
        return 1 if n == ANY else n

    def leaves(self) -> list[Stage]:
        return [self]

    def __call__(self, *streams: Stream, n_out: int = ANY) -> Bundle:
        """Runs the graph over the given channels."""
        n_in = unify(self.takes, len(streams), self.name, "the input")
        out = self.gives if n_out == ANY else n_out
        return self.run(Bundle(tuple(streams)), self.least("gives") if out == ANY else out) if n_in == len(streams) else Bundle()


@dataclass
class Function(Stage):
    """A Python function from channels to channels, with a fixed or adapting number of both.

    each, if given, does the same in all channels of a scattered stream at once: (stream, column of the channel) to a stream
    that keeps the column.
    """

    fn: Callable[..., object]
    takes: int = 1
    gives: int = 1
    name: str = ""
    reads: frozenset[str] = frozenset()  # stored values it uses
    writes: frozenset[str] = frozenset()  # and defines
    each: Callable[[Stream, str], Stream] | None = None

    def __post_init__(self):
        self.name = self.name or getattr(self.fn, "__name__", "function")

    def run(self, inputs: Bundle, n_out: int) -> Bundle:
        if self.takes not in (ANY, len(inputs)):
            raise PlanError(f"{self.name} takes {self.takes} channels and is given {len(inputs)}")
        made = self.fn(*inputs.streams)
        made = Bundle(()) if made is None else made if isinstance(made, Bundle) else Bundle(tuple(made) if isinstance(made, (list, tuple)) else (made,))
        if n_out != len(made):
            raise PlanError(f"{self.name} gives {len(made)} channels where {n_out} are taken")
        return made


def stage(n_in: int = 1, n_out: int = 1, name: str = "") -> Callable[[Callable], Function]:
    """Makes a function a stage: 0 inputs for a source, 0 outputs for a sink, ANY if it adapts."""
    return lambda fn: Function(fn, n_in, n_out, name)


@dataclass
class _Adapter(Stage):
    name: str
    action: Callable[[Bundle, int], Bundle]
    takes: int = ANY
    gives: int = ANY

    def run(self, inputs: Bundle, n_out: int) -> Bundle:
        return self.action(inputs, n_out)


def tee() -> Stage:
    """Copies its inputs, as a group, to as many channels as are taken; within keeping(), the inputs are computed once."""

    def copy(bundle: Bundle, n_out: int) -> Bundle:
        group_copy(bundle, n_out)  # checks the numbers
        return group_copy(Bundle(tuple(s.map(lambda df: shared(df, n_out // len(bundle))) for s in bundle.streams)), n_out)

    return _Adapter("tee", copy)


def cat(n_out: int = 1) -> Stage:
    """Gathers its inputs in order, or by stride to n_out channels."""
    return _Adapter("cat", lambda b, n: group_gather(b, n) if n > 1 else Bundle((gather(b),)), gives=n_out)


def perm(*places: int) -> Stage:
    if sorted(places) != list(range(1, len(places) + 1)):
        raise PlanError(f"perm: {list(places)} is no permutation")
    return _Adapter("perm " + ",".join(map(str, places)), lambda b, n: permute(b, list(places)), len(places), len(places))


def spread(n: int, keys: list[str] | None = None) -> Stage:
    return _Adapter(f"scatter {n}", lambda b, _: scatter(b[0], n, keys), 1, n)


def scattered(keys: list[str] | None = None) -> Stage:
    """Each record of its input to one of as many channels as are taken."""
    return _Adapter("scatter", lambda b, n: scatter(b[0], n, keys), 1)


def parallel(make: Callable[[object], Stage] | Stage, items: int | list) -> Stage:
    """A block of one stage per number from 1 on, or per item of a list; make may be a stage itself, the same for all."""
    return block(*[make if isinstance(make, Stage) else make(x) for x in (range(1, items + 1) if isinstance(items, int) else items)])


@dataclass
class Pipe(Stage):
    left: Stage
    right: Stage
    name: str = field(init=False)

    def __post_init__(self):
        self.name = f"{self.left.name} | {self.right.name}"
        self.takes, self.gives = self.left.takes, self.right.gives
        unify(self.left.gives, self.right.takes, self.left.name, self.right.name)

    def run(self, inputs: Bundle, n_out: int) -> Bundle:
        between = unify(self.left.gives, self.right.takes, self.left.name, self.right.name)
        if self.left.gives == self.right.takes == ANY:
            between = max(self.left.least("gives"), self.right.least("takes"))
        return self.right.run(self.left.run(inputs, between), n_out)

    def least(self, side: str) -> int:
        return (self.left if side == "takes" else self.right).least(side)

    def leaves(self) -> list[Stage]:
        return self.left.leaves() + self.right.leaves()


@dataclass
class Block(Stage):
    """Members side by side: inputs are given out from left to right, outputs taken in the same order."""

    members: tuple[Stage, ...]
    name: str = field(init=False)

    def __post_init__(self):
        if not self.members:
            raise PlanError("block: no members")
        self.name = "{ " + " & ".join(m.name for m in self.members) + " }"
        total = lambda ns: ANY if ANY in ns else sum(ns)
        self.takes, self.gives = total([m.takes for m in self.members]), total([m.gives for m in self.members])

    def least(self, side: str) -> int:
        return sum(m.least(side) for m in self.members)

    def _shares(self, fixed: list[int], n: int, what: str) -> list[int]:
        """n channels over the members: the fixed ones theirs, one for each other, what remains to the first of those."""
        shares = [m.least(what) for m in self.members]
        rest = n - sum(shares)
        if rest < 0 or (rest and ANY not in fixed):
            raise PlanError(f"{self.name} {what} {sum(shares)} channels where there are {n}")
        if rest:
            shares[fixed.index(ANY)] += rest
        return shares

    def run(self, inputs: Bundle, n_out: int) -> Bundle:
        first = self.members[0]
        if isinstance(inputs, Scattered) and len(inputs) == len(self.members) == n_out and all(m is first for m in self.members) and getattr(first, "each", None):
            return inputs.map(first.each)
        ins = self._shares([m.takes for m in self.members], len(inputs), "takes")
        outs = self._shares([m.gives for m in self.members], n_out, "gives")
        begins = [sum(ins[:i]) for i in range(len(ins))]
        made = {i: self.members[i].run(Bundle(inputs.streams[begins[i] : begins[i] + ins[i]]), outs[i]).streams for i in self._readers_last()}
        return Bundle(tuple(s for i in range(len(ins)) for s in made[i]))

    def _readers_last(self) -> list[int]:
        """Members in an order in which a stored value is written before it is read, wherever the two stand."""
        used = lambda m, what: frozenset().union(*[getattr(x, what, frozenset()) for x in m.leaves()])
        left, done = list(range(len(self.members))), []
        while left:
            ready = [i for i in left if not any(used(self.members[i], "reads") & used(self.members[j], "writes") for j in left if j != i)]
            if not ready:
                raise PlanError(f"stores are read and written in a cycle by {', '.join(self.members[i].name for i in left)}")
            done += ready
            left = [i for i in left if i not in ready]
        return done

    def leaves(self) -> list[Stage]:
        return [x for m in self.members for x in m.leaves()]


def block(*members: Stage) -> Stage:
    return Block(tuple(members))


def to_dot(nodes: dict[str, Node], edges: list[tuple[str, str]], with_unused: bool = False) -> str:
    """The solved graph in DOT; edges without channels are left out unless asked for."""
    quoted = lambda s: '"' + s.replace('"', '\\"') + '"'
    lines = [f"  {quoted(k)} [label={quoted(n.name)}];" for k, n in nodes.items()]
    lines += [f"  {quoted(a)} -> {quoted(b)} [label={quoted(str(n))}];" for (a, b), n in zip(edges, solve(nodes, edges)) if n or with_unused]
    return "\n".join(["digraph {", *lines, "}"])


def from_text(text: str, stages: dict[str, Callable[[list[str]], Stage]]) -> tuple[dict[str, Stage], list[tuple[str, str]]]:
    """A graph in text: lines `number command arguments`, a line with %, then lines `pipe from to`.

    stages gives, for each command, a function from its arguments to a stage.
    """
    nodes, edges, in_edges = {}, [], False
    for line in filter(None, map(str.strip, text.splitlines())):
        words = line.split()
        if words[0] == "%":
            in_edges = True
        elif in_edges:
            if words[0] not in ("pipe", "socketpipe") or len(words) != 3 or words[1] not in nodes or words[2] not in nodes:
                raise PlanError(f"graph: cannot read the edge {line!r}")
            edges.append((words[1], words[2]))
        elif words[1] not in stages:
            raise PlanError(f"graph: unknown stage {words[1]!r}")
        else:
            nodes[words[0]] = stages[words[1]](words[2:])
    return nodes, edges


def order(nodes, edges: list[tuple[str, str]]) -> list[str]:
    """Nodes in an order in which each comes after those it reads from; PlanError if they form a cycle."""
    left = {n: {a for a, b in edges if b == n} for n in nodes}
    done: list[str] = []
    while left:
        ready = [n for n, needs in left.items() if not needs - set(done)]
        if not ready:
            raise PlanError(f"a cycle runs through {', '.join(sorted(left))}")
        done += ready
        for n in ready:
            del left[n]
    return done


def run_graph(nodes: dict[str, Stage], edges: list[tuple[str, str]], draw: str | None = None) -> dict[str, Bundle]:
    """Solves and runs a graph of stages; returns the outputs of the nodes without outgoing edges.

    draw names a file to which the solved graph is written in DOT; nothing is run then.
    """
    leave = {a for a, _ in edges}
    sided = {k: Node(s.name, s.takes, s.gives if k in leave else ANY) for k, s in nodes.items()}
    if draw:
        with open(draw, "w", encoding="utf-8") as f:
            f.write(to_dot(sided, edges, with_unused=True) + "\n")
        return {}
    sizes = dict(enumerate(solve(sided, edges)))
    ready: dict[int, Bundle] = {}
    results = {}
    for n in order(nodes, edges):
        inputs = tuple(s for i, e in enumerate(edges) if e[1] == n for s in ready[i].streams)
        leaving = [i for i, e in enumerate(edges) if e[0] == n]
        total = sum(sizes[i] for i in leaving) if leaving else (1 if nodes[n].gives == ANY else nodes[n].gives)
        made, at = nodes[n].run(Bundle(inputs), total), 0
        for i in leaving:
            ready[i] = Bundle(made.streams[at : at + sizes[i]])
            at += sizes[i]
        if not leaving:
            results[n] = made
    return results

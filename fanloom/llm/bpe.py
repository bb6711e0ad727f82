"""Byte-pair encoding with the vocabulary files of public tokenizers.

A text is cut into pieces by a pattern; each piece starts as a doubly linked list of its bytes. A priority queue holds the
ranks of the merges that neighbouring symbols allow, each with its places. The lowest rank is taken next, its places from
left to right; places whose symbols have changed since are stale and are skipped. So a piece of n bytes takes O(n log n),
however long it is.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary files lie; every function that needs one takes the path as a parameter.
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.json"

# Fixed value: the published pattern that cuts text ahead of the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# The same pattern where a text holds nothing but ASCII characters.
ASCII_PATTERN = PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+")


def _shown_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary file: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class BytePairEncoder:
    """Encodes and decodes text by a byte-level BPE file in the JSON form of the public tokenizers."""

    def __init__(self, path: str = BYTE_BPE_50K, kept_pieces: int = 200_000):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        shown = _shown_bytes()
        as_bytes = lambda s: bytes(map(shown.__getitem__, s))
        self.vocabulary = {i: as_bytes(s) for s, i in model["vocab"].items()}
        ids = {s: i for s, i in model["vocab"].items()}
        self.byte_id = [0] * 256
        for c, b in shown.items():
            self.byte_id[b] = ids[c]
        #: The rank of two neighbouring symbols, as left << 20 | right; and of each rank, the two and what they make.
        self.merges: dict[int, int] = {}
        self.made: list[tuple[int, int, int]] = []
        rank_of: dict[int, int] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            if max(rank_of.get(ids[a], -1), rank_of.get(ids[b], -1)) >= rank or ids[a + b] in rank_of:
                raise ValueError(f"{path}: merge {rank} uses what is made later, or makes a symbol again")
            rank_of[ids[a + b]] = rank
            self.merges[ids[a] << 20 | ids[b]] = rank
            self.made.append((ids[a], ids[b], ids[a + b]))
        self.pattern, self.ascii_pattern = regex.compile(PATTERN), re.compile(ASCII_PATTERN, re.ASCII)
        #: Ids of pieces seen before; bounded, and started afresh when full.
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.kept_pieces = kept_pieces
        self.n_bytes = np.zeros(max(self.vocabulary) + 1, np.int32)
        for i, v in self.vocabulary.items():
            self.n_bytes[i] = len(v)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        symbol = [self.byte_id[b] for b in piece]
        n, ranked = len(symbol), self.merges.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        places: dict[int, list[int]] = {}  # of each rank in the queue, where its left symbols stand
        queue: list[int] = []
        for i in range(n - 1):
            if (rank := ranked(symbol[i] << 20 | symbol[i + 1])) is not None:
                if rank in places:
                    places[rank].append(i)
                else:
                    places[rank] = [i]
                    queue.append(rank)
        heapq.heapify(queue)
        while queue:
            rank = heapq.heappop(queue)
            left, right, made = self.made[rank]
            # What a merge makes takes part in higher ranks only, so all places of a rank are merged in one go.
            for i in sorted(places.pop(rank)):
                j = after[i]
                if symbol[i] != left or j >= n or symbol[j] != right:
                    continue  # stale: one of the two has gone into another symbol
                symbol[i], symbol[j] = made, -1
                k, h = after[j], before[i]
                after[i] = k
                if k < n:
                    before[k] = i
                    if (new := ranked(made << 20 | symbol[k])) is not None:
                        if new in places:
                            places[new].append(i)
                        else:
                            places[new] = [i]
                            heapq.heappush(queue, new)
                if h >= 0 and (new := ranked(symbol[h] << 20 | made)) is not None:
                    if new in places:
                        places[new].append(h)
                    else:
                        places[new] = [h]
                        heapq.heappush(queue, new)
        ids, i = [], 0
        while i < n:
            ids.append(symbol[i])
            i = after[i]
        return ids

    def piece(self, s: str) -> tuple[int, ...]:
        found = self.pieces.get(s)
        if found is None:
            found = tuple(self.merge(s.encode("utf-8")))
            if len(s) <= 128:
                if len(self.pieces) >= self.kept_pieces:
                    self.pieces.clear()
                self.pieces[s] = found
        return found

    def cut(self, text: str) -> list[str]:
        """The pieces of a text; ASCII texts by the faster engine, with the same result."""
        return (self.ascii_pattern if text.isascii() else self.pattern).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids without special tokens; strings that look like special tokens are ordinary text; none for null and ''."""
        ids: list[int] = []
        if text:
            known = self.pieces.get
            for s in self.cut(text):
                ids += known(s) or self.piece(s)
        return ids

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known = self.pieces.get
        return sum([len(known(s) or self.piece(s)) for s in self.cut(text)])

    def decode_bytes(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))

    def decode(self, ids) -> str:
        """The text of ids: the vocabulary's strings put together. Ids cut out of a character give U+FFFD there."""
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


@functools.lru_cache(maxsize=4)
def encoder(path: str = BYTE_BPE_50K) -> BytePairEncoder:
    """One encoder per file and Python worker."""
    return BytePairEncoder(path)


def texts(values: pa.Array) -> Iterator[str | None]:
    """The strings of an Arrow array, made into Python objects a few at a time."""
    for at in range(0, len(values), 256):
        yield from values[at : at + 256].to_pylist()


def encode(text: Column, path: str = BYTE_BPE_50K) -> Column:
    """Token ids of each text as ARRAY<INT>; an empty array for an empty and for a null text. Whole texts, whatever their length."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), containsNull=False))
    def ids(values: pa.Array) -> pa.Array:
        bpe, flat, offsets = encoder(path), array("i"), [0]
        for s in texts(values):
            flat.extend(bpe.encode(s))
            offsets.append(len(flat))
        items = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=pa.list_(pa.field("element", pa.int32(), nullable=False)))

    return ids(text)


def decode(ids: Column, path: str = BYTE_BPE_50K) -> Column:
    """The texts of arrays of ids, the reverse of encode(); null for a null array."""

    @F.arrow_udf(T.StringType())
    def text(values: pa.Array) -> pa.Array:
        bpe = encoder(path)
        return pa.array([None if v is None else bpe.decode(v) for v in texts(values)], pa.string())

    return text(ids)


def token_count(text: Column, path: str = BYTE_BPE_50K) -> Column:
    """Number of tokens of each text; 0 for an empty and for a null text."""

    @F.arrow_udf(T.LongType())
    def counted(values: pa.Array) -> pa.Array:
        bpe = encoder(path)
        return pa.array([bpe.count(s) for s in texts(values)], pa.int64())

    return counted(text)

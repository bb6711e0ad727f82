"""Cutting texts of too many tokens into pieces, at natural boundaries where there are any.

The tokens of the pattern's pieces give prefix sums of token offsets; boundaries of each kind become sorted arrays of such
offsets. From a piece's start, binary search finds the last boundary within the limit, trying the kinds from paragraphs to
words; the next piece starts the overlap before that cut. Where no boundary is left (one run without spaces that is longer
than the limit), the cut is a hard one between tokens, at a whole character. A piece that comes to more tokens on its own
is cut earlier.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fanloom.llm.bpe import BYTE_BPE_50K, BytePairEncoder, encoder

# Kinds of boundaries, the strongest first; a match's end is the boundary. Code blocks are cut before and after, not within, as far as paragraphs and lines go.
_KINDS = {
    "paragraph": regex.compile(r"\n[ \t\r]*\n\s*"),
    "line": regex.compile(r"\n"),
    "sentence": regex.compile(r"[.!?…][\"'”’)\]]*(?=\s)|[。！？؟।](?:[\"'”’」』）]*)"),
}
_FENCE = regex.compile(r"^[ \t]*(?:```|~~~).*$", regex.M)
_INDENTED = regex.compile(r"(?:^(?: {4}|\t).*(?:\n|\Z))+", regex.M)


class Piece(NamedTuple):
    start: int  # in tokens of the whole text
    end: int
    char_start: int
    char_end: int
    cut: str  # what the piece ends at


def _code_blocks(text: str) -> list[tuple[int, int]]:
    """Character spans of code: fenced blocks with their fences, and indented blocks outside them."""
    fences, blocks = [m.span() for m in _FENCE.finditer(text)], []
    for opened, closed in zip(fences[::2], fences[1::2]):
        blocks.append((opened[0], min(closed[1] + 1, len(text))))
    starts = [a for a, _ in blocks]
    for m in _INDENTED.finditer(text):
        k = bisect_right(starts, m.start()) - 1
        if k < 0 or blocks[k][1] <= m.start():
            blocks.append(m.span())
    return sorted(blocks)


class _Offsets:
    """Token offsets of a text: prefix sums over the pattern's pieces, and the tokens within a piece when asked."""

    def __init__(self, text: str, bpe: BytePairEncoder):
        self.text, self.bpe = text, bpe
        cut = bpe.cut(text)
        self.chars = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        lengths = np.fromiter((len(bpe.piece(s)) for s in cut), np.int64, len(cut))
        self.tokens = np.concatenate([[0], np.cumsum(lengths)])
        self.total = int(self.tokens[-1])
        self.seen: tuple[int, np.ndarray | None] = (-1, None)  # of the last piece asked for, as it may be long

    def boundaries(self) -> list[tuple[str, list[int]]]:
        """Sorted token offsets by kind; each boundary is moved on to the next piece of the pattern."""
        blocks = _code_blocks(self.text)
        starts, ends = np.array([a for a, _ in blocks], np.int64), np.array([b for _, b in blocks], np.int64)

        def outside(chars: np.ndarray) -> np.ndarray:
            k = np.searchsorted(starts, chars, "right") - 1
            within = (k >= 0) & (chars > starts[np.maximum(k, 0)]) & (chars < ends[np.maximum(k, 0)]) if len(starts) else np.zeros(len(chars), bool)
            return chars[~within]

        def offsets(chars: np.ndarray) -> list[int]:
            return np.unique(self.tokens[np.searchsorted(self.chars, chars)]).tolist()

        found = {k: np.array([m.end() for m in p.finditer(self.text)], np.int64) for k, p in _KINDS.items()}
        first = np.fromiter(((self.text[c].isspace() or (c and self.text[c - 1].isspace())) for c in self.chars[:-1].tolist()), bool, len(self.chars) - 1)
        return [
            ("paragraph", offsets(outside(found["paragraph"]))),
            ("code", offsets(np.concatenate([starts, ends]))),
            ("line", offsets(found["line"])),
            ("sentence", offsets(outside(found["sentence"]))),
            ("word", self.tokens[:-1][first].tolist()),
            ("part", self.tokens.tolist()),
        ]

    def _within(self, k: int) -> np.ndarray:
        """For each token of the k-th piece of the pattern, how many characters begin before it; -1 if it begins within one."""
        if self.seen[0] != k:
            s = self.text[int(self.chars[k]) : int(self.chars[k + 1])]
            raw = np.frombuffer(s.encode("utf-8"), np.uint8)
            begins = (raw & 0xC0) != 0x80
            first = np.concatenate([[0], np.cumsum(self.bpe.n_bytes[list(self.bpe.piece(s))])[:-1]])
            self.seen = k, np.where(begins[first], np.cumsum(begins)[first] - 1, -1)
        return self.seen[1]

    def char(self, token: int) -> int | None:
        """The position of the character at which a token begins; None if it begins within a character."""
        k = min(int(np.searchsorted(self.tokens, token, "right")) - 1, len(self.chars) - 2)
        within = token - int(self.tokens[k])
        before = int(self._within(k)[within]) if within else 0
        return None if before < 0 else int(self.chars[k]) + before

    def whole(self, token: int) -> tuple[int, int]:
        """The last token at or before the given one that begins a character, and that character's position."""
        while (c := self.char(token)) is None:
            token -= 1
        return token, c


def split(text: str | None, limit: int, overlap: int, bpe: BytePairEncoder) -> list[Piece]:
    """Pieces of at most limit tokens that cover the text; each but the first repeats the last overlap tokens of the one before.

    A piece is within the limit both as a part of the whole text's tokens and encoded on its own.

    Where the repeated part would begin within a character, it begins with that whole character, up to three tokens before.
    A boundary of a strong kind is taken if the piece then holds at least half the limit; words, and parts of words, too if not.
    Null and empty texts have no pieces.
    """
    if not 0 <= overlap or limit < 8 or overlap + 8 > limit:
        raise ValueError("the overlap must leave room for at least 8 tokens in the limit")
    if not text:
        return []
    if len(text) <= limit // 4:  # a character is at most four bytes, and a token at least one
        return [Piece(0, bpe.count(text), 0, len(text), "end")]
    at = _Offsets(text, bpe)
    if at.total <= limit:
        return [Piece(0, at.total, 0, len(text), "end")]
    kinds, pieces, start, char_start = at.boundaries(), [], 0, 0
    while True:
        most = min(start + limit, at.total)
        while True:
            if most == at.total:
                kind, end, char_end = "end", at.total, len(text)
            else:
                kind, end, char_end = _cut(at, kinds, start, most, limit, overlap)
            # On its own, a piece's text can come to other tokens than within the whole, as its ends are cut anew.
            over = bpe.count(text[char_start:char_end]) - limit
            if over <= 0 or end <= start + overlap + 4:
                break
            most = max(end - over, start + overlap + 4)
        pieces.append(Piece(start, end, char_start, char_end, kind))
        if kind == "end":
            return pieces
        start, char_start = at.whole(end - overlap)


def _cut(at: _Offsets, kinds: list[tuple[str, list[int]]], start: int, most: int, limit: int, overlap: int) -> tuple[str, int, int]:
    """The kind, token and character of the last boundary up to `most`, or of a hard cut there."""
    least, fallback = start + limit // 2, start + overlap + 4
    for kind, offsets in kinds:
        k = bisect_right(offsets, most) - 1
        if k >= 0 and offsets[k] >= (least if kind not in ("word", "part") else fallback):
            return kind, offsets[k], at.char(offsets[k])
    return "token", *at.whole(most)


def split_documents(docs: DataFrame, limit: int = 1024, overlap: int = 64, doc_id: str = "doc_id", text: str = "text", path: str = BYTE_BPE_50K, with_text: bool = True) -> DataFrame:
    """(doc_id, piece, pieces, start, end, char_start, char_end, cut, and text): the pieces of every document, from piece 0 on.

    start and end count tokens of the whole text, so end - start is a piece's size. A document within the limit is one
    piece; null and empty texts have none. Null and repeated ids are kept as they are.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, pieces int, start bigint, end bigint, char_start bigint, char_end bigint, cut string" + ", text string" * with_text

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            for at in range(0, b.num_rows, 64):  # few at a time, as texts may be long
                rows, ids = [], []
                part = b.slice(at, 64)
                for i, s in enumerate(part.column(1).to_pylist()):
                    found = split(s, limit, overlap, bpe)
                    for k, p in enumerate(found):
                        ids.append(i)
                        rows.append((k, len(found), *p, *([s[p.char_start : p.char_end]] if with_text else [])))
                if rows:
                    names = ["doc_id", "piece", "pieces", "start", "end", "char_start", "char_end", "cut", "text"][: 8 + with_text]
                    types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(ids)), *[pa.array(c, t) for c, t in zip(zip(*rows), types)]], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, schema)

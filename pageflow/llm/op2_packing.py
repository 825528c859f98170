"""Operator 2: sum-of-squares online packing of documents into windows.

A level array counts the open windows of every fill level, LEVELS of them. A document (its ids and an end id) goes to
the level, or to a new window, for which the sum of the squared counts grows least; of equals, to the fullest. Squared
counts keep few windows open at each level, so a task has some LEVELS open windows at any time, however much it packs. A
window with less room than a level is ended by the head of the next long document. A document of a window or more
fills windows of its own first and only its rest is placed. Tasks pack their partitions independently and in one pass,
without a shuffle.

At a task's end, the fullest open windows stay as they are; the pieces of the others are placed once more by the same rule,
in the room of those, and cut where they are longer than any room. What is left is less than a window and is cut in
powers of two, which need no padding. So a task adds no padding, and what moves at its end is bounded by the open windows.

Null and empty texts are one end id. Rows with null or repeated ids are documents of their own, extra columns are not
read, an empty table gives no pieces. Memory: one portion of a batch, the level array, and the ids in open windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from pageflow.llm.batches import id_and_text, portions
from pageflow.llm.words import WordIds, word_ids
from pageflow.session import ship

#: Fill levels of a window; a document of so many levels may give its head to end a window.
LEVELS, LONG_ENOUGH = 64, 4
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: A piece: doc_id, start in its document, ids, tokens of its document.
Piece = tuple[int | None, int, np.ndarray, int]


class SumOfSquares:
    """Online packing; placed pieces leave as (piece, sequence, offset) once their window is full."""

    def __init__(self, window: int, first_sequence: int = 0, levels: int = LEVELS):
        self.window, self.next = window, first_sequence
        self.grain = max(1, window // levels)
        top = (window - 1) // self.grain
        self.count = [0] * (top + 1)  # the level array: open windows by fill
        self.fill = [0] * (top + 1)  # of the window of each level that is next in turn
        self.open: list[list[tuple[int, list[Piece]]]] = [[] for _ in range(top + 1)]
        self.placed = self.moved = 0  # ids packed; of these, moved at the end

    def choose(self, size: int, may_open: bool = True) -> int:
        """The fill level to add to; -1: a new window. None fits and none may be opened: -2."""
        w, grain, count, fill = self.window, self.grain, self.count, self.fill
        best, least = (-1, 2 * count[size // grain] + 1) if may_open else (-2, float("inf"))
        for level, n in enumerate(count):
            if n and (after := fill[level] + size) <= w:
                to = after // grain
                if after == w:
                    growth = 1 - 2 * n  # the window leaves the array
                else:
                    growth = 2 * (count[to] - n) + 2 if to != level else 0
                if growth <= least:  # of equals, the fullest
                    best, least = level, growth
        return best

    def _take(self, level: int) -> tuple[int, list[Piece]]:
        fill, pieces = self.open[level].pop()
        self.count[level] -= 1
        self.fill[level] = self.open[level][-1][0] if self.open[level] else 0
        return fill, pieces

    def _put(self, fill: int, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        """Give a window back to its level; a full one leaves."""
        if fill == self.window:
            yield from self._sequence(pieces)
            return
        level = fill // self.grain
        self.open[level].append((fill, pieces))
        self.count[level] += 1
        self.fill[level] = fill

    def _sequence(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        at = 0
        for piece in pieces:
            yield piece, self.next, at
            at += len(piece[2])
        self.next += 1

    def _top_up(self, piece: Piece, level: int) -> tuple[Piece, Iterator[tuple[Piece, int, int]]]:
        """Fill the rest of a window of a level with the head of a piece; what is left of the piece, and the full window."""
        fill, pieces = self._take(level)
        (doc_id, start, ids, n), room = piece, self.window - fill
        return (doc_id, start + room, ids[room:], n), self._put(self.window, [*pieces, (doc_id, start, ids[:room], n)])

    def _place(self, piece: Piece, may_open: bool = True) -> Iterator[tuple[Piece, int, int]]:
        while len(piece[2]):
            level = self.choose(len(piece[2]), may_open)
            if level == -2:  # only at the end: it is longer than the room of any window, so the emptiest takes its head
                piece, out = self._top_up(piece, next(k for k, n in enumerate(self.count) if n))
                yield from out
                continue
            fill, pieces = self._take(level) if level >= 0 else (0, [])
            pieces.append(piece)
            yield from self._put(fill + len(piece[2]), pieces)
            return

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[Piece, int, int]]:
        n, w = len(ids), self.window
        whole = n - n % w
        for start in range(0, whole, w):
            yield from self._sequence([(doc_id, start, ids[start : start + w], n)])
        self.placed += n
        piece = (doc_id, whole, ids[whole:], n)
        # a window with less room than a level is ended by the head of a long document
        while self.count[-1] and len(piece[2]) >= LONG_ENOUGH * self.grain:
            piece, out = self._top_up(piece, len(self.count) - 1)
            yield from out
        yield from self._place(piece)

    def close(self) -> Iterator[tuple[Piece, int, int]]:
        """Full windows from what is open. The fullest stay as they are; the pieces of the others are placed once more, by the same
        rule, in their room. What is left at last is cut in powers of two."""
        w = self.window
        left = sorted((x for level in self.open for x in level), key=lambda x: -x[0])
        stay = sum(f for f, _ in left) // w
        for level in self.open:
            level.clear()
        self.count, self.fill = [0] * len(self.count), [0] * len(self.fill)
        for fill, pieces in left[:stay]:
            yield from self._put(fill, pieces)
        pieces = sorted((p for _, ps in left[stay:] for p in ps), key=lambda p: -len(p[2]))
        self.moved += sum(len(p[2]) for p in pieces)
        rest: list[Piece] = []
        for piece in pieces:
            if not any(self.count):
                rest.append(piece)
                continue
            room = sum((w - fill) for level in self.open for fill, _ in level)
            doc_id, start, ids, n = piece
            if len(ids) > room:
                rest.append((doc_id, start + room, ids[room:], n))
            yield from self._place((doc_id, start, ids[:room], n), may_open=False)
        sizes = [1 << b for b in range(w.bit_length(), -1, -1) if sum(len(p[2]) for p in rest) >> b & 1]
        for size in sizes:
            sequence, room = [], size
            while room:
                doc_id, start, ids, n = rest.pop(0)
                sequence.append((doc_id, start, ids[:room], n))
                if len(ids) > room:
                    rest.insert(0, (doc_id, start + room, ids[room:], n))
                room -= len(sequence[-1][2])
            yield from self._sequence(sequence)


def _batch(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
    longs = lambda it: pa.array(list(it), pa.int64())
    return pa.RecordBatch.from_arrays(
        [longs(p[0] for p, _, _ in placed), longs(p[1] for p, _, _ in placed), longs(len(p[2]) for p, _, _ in placed), pa.array([p[2].astype("<u4").tobytes() for p, _, _ in placed], pa.binary()), longs(p[3] for p, _, _ in placed), longs(s for _, s, _ in placed), longs(o for _, _, o in placed)],
        ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
    )


def pack_batches(batches: Iterator[pa.RecordBatch], own: WordIds, end_id: int, packer: SumOfSquares) -> Iterator[pa.RecordBatch]:
    """A task's pieces. Texts stay in their column; a document's ids are a part of its portion's."""
    for batch in batches:
        for part in portions(batch):
            placed = []
            ids, starts = own.coded(part.column("text"), end_id)
            for doc_id, x, y in zip(part.column("doc_id").to_pylist(), starts.tolist(), starts[1:].tolist()):
                placed += packer.add(doc_id, ids[x:y].copy())  # an open window holds its own ids only
            yield _batch(placed)
    yield _batch(list(packer.close()))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, window: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; ids are little-endian unsigned 32-bit. sequence_id: the task's number times 2^32, counted up."""
    ship(docs.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_batches(batches, word_ids(tokenizer_path), end_id, SumOfSquares(window, TaskContext.get().partitionId() << 32))

    return id_and_text(docs, id_col, text_col).mapInArrow(pack, SCHEMA)

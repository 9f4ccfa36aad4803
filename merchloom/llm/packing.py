"""Cost-balanced packing of documents into sequences of a fixed number of tokens.

A sequence costs ``linear`` per token plus ``quadratic`` per pair of tokens of one piece, as attention
stays inside a piece. Every task packs the documents it reads in lots of ``LOT_TOKENS``: full sequences
are cut off long documents, what is left is dealt in descending length to the sequence of lowest cost
that has room, and a piece is cut only when no sequence has room for all of it. Tokens that would leave
a sequence unfilled go to the next lot; at the end of a task they fill sequences whose lengths are
powers of two. So nothing is padded, and neither texts nor ids are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchloom.llm.arrow import pieces
from merchloom.llm.tokens import Encoder

SEQUENCE_TOKENS = 2048
LOT_TOKENS = 1 << 20

#: (doc number in the task, first token, tokens)
Piece = tuple[int, int, int]


def deal(items: list[Piece], rooms: list[int], linear: float = 1.0, quadratic: float = 1 / 1024) -> tuple[list[tuple[Piece, int, int]], list[Piece]]:
    """Deal pieces to sequences with the given room; gives ((piece, sequence, offset), pieces without room).

    The longest piece is first; equal ones keep their order. A piece goes whole to the sequence of lowest
    cost with room for it, else its head fills the sequence with most room and its tail waits for its turn.
    """
    room = np.array(rooms, np.int64)
    size = room.copy()
    cost = np.zeros(len(rooms))
    placed: list[tuple[Piece, int, int]] = []
    queue = sorted(items, key=lambda p: -p[2])
    tails: list[Piece] = []
    while queue or tails:
        if not queue:
            queue, tails = sorted(tails, key=lambda p: -p[2]), []
        for at, (doc, start, length) in enumerate(queue):
            fits = np.where(room >= length, cost, np.inf) if len(room) else np.array([np.inf])
            to = int(np.argmin(fits))
            taken = length
            if not np.isfinite(fits[to]):
                to = int(np.argmax(room)) if len(room) else 0
                taken = int(room[to]) if len(room) else 0
                if not taken:
                    return placed, [*queue[at:], *tails]
                tails.append((doc, start + taken, length - taken))
            placed.append(((doc, start, taken), to, int(size[to] - room[to])))
            room[to] -= taken
            cost[to] += linear * taken + quadratic * taken * taken
        queue = []
    return placed, []


def _powers(n: int) -> list[int]:
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


class Packer:
    """Packs the documents of one task, lot by lot."""

    def __init__(self, length: int, linear: float, quadratic: float):
        self.length, self.costs = length, (linear, quadratic)
        self.waiting: list[Piece] = []
        self.held = self.next_sequence = 0

    def add(self, doc: int, tokens: int) -> list[tuple[Piece, int, int]]:
        """Full sequences cut off a document; the rest waits for its lot."""
        out, start = [], 0
        while tokens - start >= self.length:
            out.append(((doc, start, self.length), self.next_sequence, 0))
            self.next_sequence += 1
            start += self.length
        if start < tokens:
            self.waiting.append((doc, start, tokens - start))
            self.held += tokens - start
        return out

    def close_lot(self, last: bool) -> list[tuple[Piece, int, int]]:
        rooms = [self.length] * (self.held // self.length) + (_powers(self.held % self.length) if last else [])
        placed, self.waiting = deal(self.waiting, rooms, *self.costs)
        self.held = sum(p[2] for p in self.waiting)
        base, self.next_sequence = self.next_sequence, self.next_sequence + len(rooms)
        return [(piece, base + to, offset) for piece, to, offset in placed]


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
         length: int = SEQUENCE_TOKENS, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are unsigned little-endian 32-bit numbers. A document is its text's ids and ``end_id``; a
    null text has the latter only. Each row of ``docs`` is a document of its own, also if ids repeat or are null.
    A sequence's id holds the partition that made it, so a task that is run again gives the same rows.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = Encoder(vocabulary), Packer(length, linear, quadratic)
        first = TaskContext.get().partitionId() << 32
        held: dict[int, tuple[object, bytes]] = {}
        number = 0

        def rows(placed: list[tuple[Piece, int, int]]) -> pa.RecordBatch:
            of = [held[doc] for (doc, _, _), _, _ in placed]
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _ in of], id_type), pa.array([p[1] for p, _, _ in placed], pa.int64()),
                pa.array([p[2] for p, _, _ in placed], pa.int64()),
                pa.array([ids[4 * p[1]:4 * (p[1] + p[2])] for (p, _, _), (_, ids) in zip(placed, of, strict=True)], pa.binary()),
                pa.array([len(ids) // 4 for _, ids in of], pa.int64()),
                pa.array([first + s for _, s, _ in placed], pa.int64()), pa.array([o for _, _, o in placed], pa.int64()),
            ], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def close(last: bool) -> pa.RecordBatch:
            nonlocal held
            out = rows(packer.close_lot(last))
            held = {doc: held[doc] for doc, _, _ in packer.waiting}
            return out

        id_type = None
        for batch, texts in pieces(batches, "text"):
            id_type = batch.schema.field(0).type
            whole: list[tuple[Piece, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                ids = encoder.encode((text or b"").decode("utf-8", "replace")) + end
                held[number] = (doc, ids)
                whole += packer.add(number, len(ids) // 4)
                number += 1
            if whole:
                yield rows(whole)
            if packer.held >= LOT_TOKENS:
                yield close(False)
            else:
                waiting = {doc for doc, _, _ in packer.waiting}
                held = {doc: x for doc, x in held.items() if doc in waiting}
        if packer.held:
            yield close(True)

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(
        run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")

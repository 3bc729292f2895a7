"""Harmonic packing of token sequences, without a shuffle.

Class j holds pieces longer than C/(j+1) and up to C/j, and a bin of the class takes
exactly j of them. A document gives whole sequences and one remainder, which goes to
its class uncut. What j pieces leave open in their bin (less than C/(j+1)) is filled
with a cut of exactly that length from a later document, as a rule a long one, so that
nothing is padded. A worker fills the bins of its own partition and needs to know
nothing of the others. At a partition's end the pieces of unfinished bins fill the last
gaps and then sequences one after the other; the very last has fewer than C tokens and
is cut into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, types as T

from hostgauge.llm.subwords import ADDED, Subwords, vocabulary_path

CAPACITY = 1024  # a power of two
END = 0  # id after each document
_SEQUENCE_BITS = 40  # of a sequence id; the partition's number stands above them
_OUT = 20_000  # pieces per batch handed back
WAITING = 256  # bins with a gap that wait for a long document; beyond it any document fills them
_SCHEMA = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Piece(NamedTuple):
    own: tuple  # what the document carries along
    doc_tokens: int
    start: int
    ids: memoryview  # bytes of the little-endian ids

    @property
    def length(self) -> int:
        return len(self.ids) // 4

    def split(self, n: int) -> tuple[Piece, Piece]:
        """The first ``n`` tokens and the others."""
        return self._replace(ids=self.ids[: 4 * n]), self._replace(start=self.start + n, ids=self.ids[4 * n :])

    def own_copy(self) -> Piece:
        """Does not hold the whole document's ids in memory."""
        return self._replace(ids=memoryview(bytes(self.ids)))


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths that ``n`` tokens are cut into: whole sequences, then the remainder."""
    rest = n % capacity
    return [capacity] * (n // capacity) + ([rest] if rest else [])


class Bins:
    """Bins of one worker; gives pieces their place as bins fill up."""

    def __init__(self, first_sequence: int, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next = first_sequence
        self.open: dict[int, list[Piece]] = {}  # by class: fewer pieces than a bin takes
        self.gaps: deque[tuple[int, list[Piece]]] = deque()  # bins that have all their pieces and room left
        self.placed: list[tuple] = []

    def _place(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            n = p.length
            self.placed.append((*p.own, p.start, n, zlib.crc32(p.ids), p.doc_tokens, self.next, offset))
            offset += n
        self.next += 1

    def _fill(self, piece: Piece) -> Piece | None:
        """Puts as much of ``piece`` as fits into the oldest gap; what is left of it."""
        gap, pieces = self.gaps.popleft()
        n = piece.length
        if n < gap:
            self.gaps.appendleft((gap - n, [*pieces, piece.own_copy()]))
            return None
        first, rest = piece.split(gap)
        self._place([*pieces, first])
        return rest if n > gap else None

    def _add_remainder(self, piece: Piece) -> None:
        fixed = self.capacity // piece.length  # the class, and how many pieces a bin of it takes
        pieces = self.open.setdefault(fixed, [])
        pieces.append(piece.own_copy())
        if len(pieces) == fixed:
            del self.open[fixed]
            gap = self.capacity - sum(p.length for p in pieces)
            if gap:
                self.gaps.append((gap, pieces))
            else:
                self._place(pieces)

    def add(self, document: Piece) -> None:
        rest: Piece | None = document
        long = document.length >= self.capacity
        while rest and self.gaps and (len(self.gaps) > WAITING or long and rest.length >= self.gaps[0][0]):
            rest = self._fill(rest)
        if rest is None:
            return
        for n in cut(rest.length, self.capacity):
            piece, rest = rest.split(n)
            if n == self.capacity:
                self._place([piece])
            else:
                self._add_remainder(piece)

    def flush(self) -> None:
        left = [p for _, pieces in sorted(self.open.items(), reverse=True) for p in pieces]
        self.open = {}
        while self.gaps:
            if not left:  # the newest bin is given up to fill the others
                left = self.gaps.pop()[1]
                continue
            rest = self._fill(left.pop())
            if rest:
                left.append(rest)
        while left:
            room = 1 << (min(self.capacity, sum(p.length for p in left)).bit_length() - 1)
            sequence: list[Piece] = []
            while room:
                piece = left.pop()
                if piece.length > room:
                    piece, rest = piece.split(room)
                    left.append(rest)
                sequence.append(piece)
                room -= piece.length
            self._place(sequence)


def pack(
    docs: DataFrame, text: str = "text", keep: list[str] | None = None, capacity: int = CAPACITY, vocabulary: str | None = None,
    added: tuple = ADDED,
) -> DataFrame:
    """One row per piece: ``keep`` columns and where the piece lies in its document and in its sequence.

    Null and empty texts are the end id alone. Repeated rows are packed each. The
    sequences are whole (``capacity`` tokens) but for the last few of a partition,
    whose lengths are powers of two. No rows in, no rows out. Memory per task: one
    Arrow batch, unfinished bins (one of each of some 2 sqrt(``capacity``) classes) and
    up to ``WAITING`` + 1 bins with a gap. ``added`` are the
    (string, id) pairs that the vocabulary holds besides its ranks.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    keep = keep or ["doc_id"]
    source = docs.select(*keep, text)
    schema = T.StructType([*docs.select(*keep).schema.fields, *T.StructType.fromDDL(_SCHEMA).fields])
    path = vocabulary or vocabulary_path()
    n_keep, names = len(keep), schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subwords = Subwords(path, added)
        bins = Bins(TaskContext.get().partitionId() << _SEQUENCE_BITS, capacity)
        types = None

        def out() -> pa.RecordBatch:
            placed, bins.placed = bins.placed, []
            columns = list(zip(*placed))
            ours = [pa.array(c, pa.int64()) for c in columns[n_keep:]]
            return pa.RecordBatch.from_arrays([*map(pa.array, columns[:n_keep], types), *ours], names=names)

        for batch in batches:
            types = [batch.schema.field(i).type for i in range(n_keep)]
            kept = [batch.column(i).to_pylist() for i in range(n_keep)]
            texts = batch.column(n_keep)
            for r in range(batch.num_rows):
                ids = np.append(subwords.ids(texts[r].as_py()), np.uint32(END)).astype("<u4", copy=False)
                own = tuple(k[r] for k in kept)
                bins.add(Piece(own, len(ids), 0, memoryview(ids).cast("B")))
                if len(bins.placed) >= _OUT:
                    yield out()
        bins.flush()
        if bins.placed:
            yield out()

    return source.mapInArrow(run, schema)

"""Sum-of-squares packing of token ids into sequences.

Each task packs the documents of its input split as they come.  A document is cut into full sequences and a rest;
the rest goes to the fill level that minimises the sum of squared counts of partly filled sequences, read off a level
array.  When a task's input ends, its fullest open sequences are filled up from the emptiest ones, whose pieces may be
cut, and the one sequence that is left is cut at powers of two, which need no padding.  So padding and cuts don't
depend on how the input was split, nothing is shuffled and a lost task is repeated alone.

Defined results: a NULL or empty text is the end id alone; repeated rows are packed each time; a very long text is cut
into full sequences; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ridgeline.llm.encoding import encoder
from ridgeline.llm.workers import tidy

#: doc_id, ids before the piece in its document, the piece's ids, all ids of the document.
Piece = tuple[int | None, int, bytes, int]
#: sequence, place in it, piece.
Placed = tuple[int, int, Piece]

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class SumOfSquares:
    """Online packing into sequences of ``size`` ids; sequences are handed out when they are full."""

    NONE = 1 << 60

    def __init__(self, size: int):
        self.size = size
        self.leave = np.full(size + 1, self.NONE, np.int64)  # change of the sum when a sequence leaves a level
        self.leave[0] = 0  # a new sequence is always at hand
        self.enter = np.ones(size + 1, np.int64)  # change when one comes to a level
        self.enter[size] = 0  # full ones don't count
        self.open: list[list[list[Piece]]] = [[] for _ in range(size + 1)]
        self.made = 0

    def _count(self, level: int) -> None:
        if 0 < level < self.size:
            n = len(self.open[level])
            self.leave[level] = 1 - 2 * n if n else self.NONE
            self.enter[level] = 1 + 2 * n

    def _out(self, pieces: list[Piece]) -> Iterator[Placed]:
        offset = 0
        for piece in pieces:
            yield self.made, offset, piece
            offset += len(piece[2]) // 4
        self.made += 1

    def add(self, piece: Piece) -> Iterator[Placed]:
        """Place a piece of at most ``size`` ids; of equally good levels the fullest takes it."""
        n = len(piece[2]) // 4
        top = self.size - n
        level = top - int((self.leave[: top + 1] + self.enter[n:])[::-1].argmin())
        pieces = self.open[level].pop() if level else []
        pieces.append(piece)
        self._count(level)
        if level + n == self.size:
            yield from self._out(pieces)
        else:
            self.open[level + n].append(pieces)
            self._count(level + n)

    def close(self) -> Iterator[Placed]:
        """Hand out what is left: fill the fullest from the emptiest, then cut the last at powers of two."""
        left = [x for level in self.open for x in level]  # by fill, emptiest first
        donor: list[Piece] = []
        first = 0
        while len(left) > first:
            pieces = left.pop()
            room = self.size - sum(len(x[2]) for x in pieces) // 4
            while room:
                if not donor:
                    if len(left) == first:
                        break
                    donor = left[first][::-1]
                    first += 1
                piece = donor.pop()
                if len(piece[2]) // 4 > room:
                    donor.append((piece[0], piece[1] + room, piece[2][4 * room :], piece[3]))
                    piece = (piece[0], piece[1], piece[2][: 4 * room], piece[3])
                pieces.append(piece)
                room -= len(piece[2]) // 4
            yield from self._out(pieces) if not room else self._powers(pieces)
            if len(left) == first and donor:
                left, first, donor = [donor[::-1]], 0, []

    def _powers(self, pieces: list[Piece]) -> Iterator[Placed]:
        total = sum(len(x[2]) for x in pieces) // 4
        todo = pieces[::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            own = []
            while room:
                piece = todo.pop()
                if len(piece[2]) // 4 > room:
                    todo.append((piece[0], piece[1] + room, piece[2][4 * room :], piece[3]))
                    piece = (piece[0], piece[1], piece[2][: 4 * room], piece[3])
                own.append(piece)
                room -= len(piece[2]) // 4
            yield from self._out(own)


def pack(documents: Iterator[tuple[int | None, bytes]], size: int) -> Iterator[Placed]:
    """Pieces of the documents' ids (little-endian unsigned 32-bit), placed in sequences."""
    packer = SumOfSquares(size)
    for doc_id, ids in documents:
        n = len(ids) // 4
        for start in range(0, n, size):
            yield from packer.add((doc_id, start, ids[4 * start : 4 * (start + size)], n))
    yield from packer.close()


def _batches(placed: Iterator[Placed], part: int, digest: bool) -> Iterator[pa.RecordBatch]:
    def batch(rows: list[Placed]) -> pa.RecordBatch:
        lengths = np.asarray([len(p[2]) // 4 for _, _, p in rows], np.int64)
        columns = {
            "doc_id": pa.array([p[0] for _, _, p in rows], pa.int64()), "start": pa.array([p[1] for _, _, p in rows], pa.int64()), "length": pa.array(lengths),
            "doc_tokens": pa.array([p[3] for _, _, p in rows], pa.int64()), "sequence_id": pa.array([(part << 32) + s for s, _, _ in rows], pa.int64()), "offset": pa.array([o for _, o, _ in rows], pa.int64()),
        }
        if digest:
            columns["ids_crc32"] = pa.array([zlib.crc32(p[2]) for _, _, p in rows], pa.int64())
        else:
            ends = np.concatenate([[0], np.cumsum(lengths)])
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(p[2] for _, _, p in rows))])
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
        return pa.RecordBatch.from_pydict(columns)

    rows: list[Placed] = []
    for x in placed:
        rows.append(x)
        if len(rows) >= 2000:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, size: int = 1024, digest: bool = False) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` with their sequence, place and ids.

    With ``digest`` a crc32 of each piece's ids (little-endian unsigned 32-bit integers) comes in place of the ids.
    """
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer)

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for b in batches:
                ids = tool.encode_column(b.column(1))
                yield from ((i.as_py(), x + end) for i, x in zip(b.column(0), ids))

        yield from _batches(pack(documents(), size), TaskContext.get().partitionId(), digest)

    schema = PIECE_SCHEMA.replace("ids array<int>", "ids_crc32 long") if digest else PIECE_SCHEMA
    return docs.select("doc_id", "text").mapInArrow(tidy(run, "encoders"), schema)

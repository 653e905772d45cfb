"""Online packing of documents into token sequences by the sum-of-squares rule.

Each task packs its documents as they come.  What a document has beyond whole sequences goes
to the fill level (a new sequence among them) for which the sum over levels of the squared
number of sequences at that level becomes smallest.  Only a level array and the sequences that
are still open are kept.  Where the rule would open one sequence too many, the smallest piece that
closes a sequence is cut off the document and the rule places what is left of it.  At the end the
emptiest open sequences fill the gaps of the fullest.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skysieve.llm import tokens

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
OPEN = 32  # sequences open at a time


class Levels:
    """Level array of the open sequences: how many are filled up to each level."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(capacity + 1)]

    def choose(self, size: int) -> int:
        """Level that an item of ``size`` goes to, 0 for a new sequence; the fullest of equals."""
        c, n = self.capacity, self.count
        best, change = 0, 2 * n[size] + 1
        levels = n[1: c - size]  # stay open with the item
        if len(levels):
            d = np.where(levels > 0, 2 * (n[1 + size: c] - levels) + 2, np.iinfo(np.int64).max)
            at = len(d) - 1 - int(np.argmin(d[::-1]))
            if levels[at] > 0 and d[at] <= change:
                best, change = at + 1, d[at]
        if n[c - size] > 0 and 1 - 2 * n[c - size] <= change:
            best = c - size  # becomes full
        return best

    def put(self, size: int, piece) -> list | None:
        """Place an item; the sequence's pieces if it is now full."""
        level = self.choose(size)
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.capacity:
            return pieces
        self.count[level + size] += 1
        self.open[level + size].append(pieces)
        return None

    def fullest(self) -> int:
        """Highest level that has a sequence."""
        return int(np.flatnonzero(self.count)[-1])


class Windows:
    """At most ``most`` open sequences for pieces ``(doc, start, ids, total)`` below the capacity.

    ``moved`` counts the ids that were cut off to fill a gap instead of being placed by the rule.
    """

    def __init__(self, capacity: int, most: int = OPEN):
        self.levels, self.capacity, self.most = Levels(capacity), capacity, most
        self.n_open = self.moved = 0

    def add(self, piece: tuple) -> Iterator[list]:
        """Place a piece; sequences that are full by it."""
        doc, start, ids, n = piece
        if self.n_open >= self.most and not self.levels.choose(len(ids)):
            level = self.levels.fullest()
            gap = self.capacity - level
            if gap < len(ids):
                self.levels.count[level] -= 1
                self.n_open -= 1
                self.moved += gap
                yield [*self.levels.open[level].pop(), (doc, start, ids[:gap], n)]
                piece = (doc, start + gap, ids[gap:], n)
            else:  # it fits everywhere: on top of the fullest
                self.levels.count[level] -= 1
                self.levels.count[level + len(ids)] += 1
                self.levels.open[level + len(ids)].append([*self.levels.open[level].pop(), piece])
                return
        before = int(self.levels.count.sum())
        full = self.levels.put(len(piece[2]), piece)
        self.n_open += int(self.levels.count.sum()) - before
        if full is not None:
            yield full

    def finish(self) -> Iterator[list]:
        """Everything still open: full sequences, then a rest in powers of two."""
        left = deque([level, pieces] for level, same in enumerate(self.levels.open) for pieces in same)
        total = sum(level for level, _ in left)
        while total >= self.capacity:
            level, pieces = left.pop()
            gap = self.capacity - level
            self.moved += gap
            while gap:
                donor = left[0]
                doc, start, ids, n = donor[1].pop()
                keep = max(0, len(ids) - gap)
                pieces.append((doc, start + keep, ids[keep:], n))
                if keep:
                    donor[1].append((doc, start, ids[:keep], n))
                gap -= len(ids) - keep
                donor[0] -= len(ids) - keep
                if not donor[0]:
                    left.popleft()
            total -= self.capacity
            yield pieces
        self.moved += total
        yield from cut_up([p for _, pieces in reversed(left) for p in pieces], self.capacity)
        self.levels, self.n_open = Levels(self.capacity), 0


def cut_up(pieces: list, capacity: int) -> Iterator[list]:
    """Sequences filled to the brim by cutting pieces ``(doc, start, ids, total)``; the rest in powers of two."""
    total = sum(len(p[2]) for p in pieces)
    sizes = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if total % capacity >> b & 1]
    queue, at = iter(pieces), None
    for size in sizes:
        room, out = size, []
        while room:
            doc, start, ids, n = at if at is not None else next(queue)
            out.append((doc, start, ids[:room], n))
            at = (doc, start + room, ids[room:], n) if len(ids) > room else None
            room -= len(out[-1][2])
        yield out


def _packer(path: str, capacity: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, windows, rows = tokens.encoder(path).document, Windows(capacity), []
        sequence = TaskContext.get().partitionId() << 40

        def close(pieces: list) -> None:
            nonlocal sequence
            offset = 0
            for doc, start, ids, n in pieces:
                raw = ids.tobytes()
                rows.append((doc, start, len(ids), zlib.crc32(raw), n, sequence, offset, raw if with_ids else None))
                offset += len(ids)
            sequence += 1

        def flush() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
                rows.clear()

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text)
                n = len(ids)
                whole = n - n % capacity
                for a in range(0, whole, capacity):
                    close([(doc, a, ids[a:a + capacity], n)])
                if n > whole:
                    for pieces in windows.add((doc, whole, ids[whole:], n)):
                        close(pieces)
                if len(rows) >= 5000:
                    yield from flush()
        for pieces in windows.finish():
            close(pieces)
        yield from flush()

    return run


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``capacity`` ids.

    ``docs`` needs ``doc_id`` and ``text``; a null or empty text is the end's id alone, equal rows
    and null ids are packed like any other.  Every id lies in one piece; sequences are full or as
    long as a power of two.  No shuffle: the sequences of a task hold its own documents only, and
    a task that runs again gives the same ones.
    """
    run = _packer(path or tokens.default_path(), capacity, with_ids)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, SCHEMA)


def digest(docs: DataFrame) -> DataFrame:
    """One row per piece, with a checksum in place of its ids."""
    return pack(docs, with_ids=False).drop("ids")

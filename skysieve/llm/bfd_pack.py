"""Token ids as packed binary rows: best-fit decreasing, found by a segment tree.

A task gathers documents up to a fixed number of ids, cuts those longer than a sequence into
whole sequences and a rest, and places the rests from the longest to the shortest in the
sequence whose free space they leave smallest.  A written part file is a matrix of ids, one
row to a sequence, with the borders of its segments and the position each starts from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from skysieve.llm import tokens

SCHEMA = ("sequence_id long, length int, ids binary, cu_seqlens array<int>, position_starts array<int>, doc_ids array<long>")
_ARROW = pa.schema([("sequence_id", pa.int64()), ("length", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(pa.int32())),
                    ("position_starts", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64()))])
_WINDOW = 4 << 20  # ids packed together


class SpaceTree:
    """Segment tree over amounts of free space: how many open sequences have each amount."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, n: int = 1) -> None:
        i = self.leaves + space
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, size: int) -> int:
        """Least free space of at least ``size``, -1 if no sequence has it."""
        i = self.leaves + size
        if self.count[i]:
            return size
        while i > 1:  # up to the first tree to the right that is not empty, then down its left side
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.leaves:
                    i *= 2
                    if not self.count[i]:
                        i += 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Items of each sequence, placed from the largest on; equal ones in their order."""
    tree, open_, out = SpaceTree(capacity), [[] for _ in range(capacity + 1)], []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        space = tree.tightest(size)
        if space < 0:
            space, items = capacity, []
            out.append(items)
        else:
            tree.add(space, -1)
            items = open_[space].pop()
        items.append(i)
        if space > size:
            tree.add(space - size)
            open_[space - size].append(items)
    return out


def _packer(path: str, capacity: int, pad: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).document
        kind = "<u2" if tokens.encoder(path).encoding.n_vocab <= 1 << 16 else "<u4"
        sequence = TaskContext.get().partitionId() << 40

        def rows(groups: list[list[tuple]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence
            for a in range(0, len(groups), 512):
                out = []
                for pieces in groups[a:a + 512]:
                    ids = np.full(capacity, pad, kind)
                    ends = np.cumsum([0] + [len(p[2]) for p in pieces])
                    ids[: ends[-1]] = np.concatenate([p[2] for p in pieces])
                    out.append((sequence, int(ends[-1]), ids.tobytes(), ends.tolist(), [p[1] for p in pieces], [p[0] for p in pieces]))
                    sequence += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ARROW)], schema=_ARROW)

        def packed(items: list[tuple]) -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(p[2]) for p in items], np.int64)
            yield from rows([[items[i] for i in group] for group in best_fit(sizes, capacity)])

        items, held = [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text)
                items += [(doc, a, ids[a:a + capacity].astype(kind)) for a in range(0, len(ids), capacity)]
                held += len(ids)
                if held >= _WINDOW:
                    yield from packed(items)
                    items, held = [], 0
        if items:
            yield from packed(items)

    return run


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, pad: int = 0) -> DataFrame:
    """One row per sequence: ``capacity`` little-endian ids (16 bits if the vocabulary allows), ``length`` of them used.

    ``cu_seqlens`` are the borders of the segments, 0 and ``length`` included; positions restart at
    each border from ``position_starts``, the segment's place in its document.  A null or empty
    text is the end's id alone; equal rows and null ids are packed like any other.  No shuffle.
    """
    run = _packer(path or tokens.default_path(), capacity, pad)
    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(text AS STRING) AS text").mapInArrow(run, SCHEMA)


def write(docs: DataFrame, target: str, capacity: int = 2048, path: str | None = None, pad: int = 0) -> None:
    """Write the packed rows; a job that fails leaves nothing behind its committer would show."""
    pack(docs, capacity, path, pad).write.mode("overwrite").option("compression", "zstd").parquet(target)


def unpack(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(doc_id, start, ids)``: the pieces of documents again, for reading back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], f"<u{len(r['ids']) // capacity}")
                cu = r["cu_seqlens"]
                out += [(d, s, ids[a:b].tolist()) for d, s, a, b in zip(r["doc_ids"], r["position_starts"], cu, cu[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array([x[0] for x in out], pa.int64()),
                                              "start": pa.array([x[1] for x in out], pa.int64()),
                                              "ids": pa.array([x[2] for x in out], pa.list_(pa.int32()))})

    return packed.select("ids", "cu_seqlens", "position_starts", "doc_ids").mapInArrow(run, "doc_id long, start long, ids array<int>")

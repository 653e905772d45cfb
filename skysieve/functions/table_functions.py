"""Table functions for SQL: block transforms by name and the line rasteriser.

After ``register(spark)``::

    SELECT * FROM block_transform(TABLE(SELECT iter, ant, sample, re, im FROM v) PARTITION BY (iter, ant) ORDER BY (sample), 'rms', 'iter, ant')
    SELECT * FROM rasterise(TABLE(lines))
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_LONG, _INT, _DOUBLE = T.LongType(), T.IntegerType(), T.DoubleType()
# a transform gets the samples of a block in order and gives rows of the named columns
TRANSFORMS: dict[str, tuple[dict[str, T.DataType], Callable[[np.ndarray], Iterator[tuple]]]] = {
    "rms": ({"n": _LONG, "rms": _DOUBLE}, lambda x: iter([(len(x), float(np.sqrt((np.abs(x) ** 2).mean())))])),
    "total_power": ({"n": _LONG, "power": _DOUBLE}, lambda x: iter([(len(x), float((np.abs(x) ** 2).sum()))])),
    "spectrum": ({"channel": _INT, "power": _DOUBLE}, lambda x: ((i, float(p)) for i, p in enumerate(
        np.abs(np.fft.fftshift(np.fft.fft(x))) ** 2))),
}
_CELLS = 20_000  # of lines drawn at a time
_PIECE = 65_536  # samples held as Python numbers before they become an array


@udtf
class BlockTransform:
    """Rows ``(keys, result)`` of each partition of a table with columns ``re`` and ``im``.

    ``keys`` name the partition's columns, comma-separated; samples are taken in the order the call
    gives them, null parts as zero.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, transform: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or transform.value not in TRANSFORMS:
            raise ValueError(f"block_transform needs a table and one of {', '.join(TRANSFORMS)}")
        fields = [table.dataType[k.strip()] for k in keys.value.split(",")]
        return AnalyzeResult(T.StructType(fields + [T.StructField(n, t) for n, t in TRANSFORMS[transform.value][0].items()]))

    def __init__(self):
        self.pieces, self.now, self.key, self.run = [], [], None, None

    def eval(self, row: Row, transform: str, keys: str):
        if self.key is None:
            self.key, self.run = tuple(row[k.strip()] for k in keys.split(",")), TRANSFORMS[transform][1]
        self.now.append(complex(row["re"] or 0.0, row["im"] or 0.0))
        if len(self.now) == _PIECE:
            self.pieces.append(np.array(self.now))
            self.now = []

    def terminate(self):
        if self.run:
            for out in self.run(np.concatenate([*self.pieces, np.array(self.now, complex)])):
                yield (*self.key, *out)


@udtf(useArrow=True)
class Rasterise:
    """The table's columns and, in a row each, the cells on the line from (t0, c0) to (t1, c1).

    Lines are drawn together once they have about ``_CELLS`` cells.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        cells = [T.StructField(n, T.IntegerType()) for n in ("time_idx", "channel_sample")]
        return AnalyzeResult(T.StructType([f for f in table.dataType.fields if f.name not in ("time_idx", "channel_sample")] + cells))

    def __init__(self):
        self.kept, self.ends, self.cells = [], [], 0

    def eval(self, row: Row):
        t0, c0, t1, c1 = ends = row["t0"], row["c0"], row["t1"], row["c1"]
        self.cells += int(max(abs(t1 - t0), abs(c1 - c0))) + 1
        self.ends.append(ends)
        self.kept.append(tuple(v for n, v in zip(row.__fields__, row) if n not in ("time_idx", "channel_sample")))
        if self.cells >= _CELLS:
            yield from self.drawn()

    def terminate(self):
        yield from self.drawn()

    def drawn(self) -> Iterator[tuple]:
        t0, c0, t1, c1 = np.array(self.ends, float).reshape(-1, 4).T
        n = np.maximum(np.abs(t1 - t0), np.abs(c1 - c0)).astype(np.int64)
        line = np.repeat(np.arange(len(n)), n + 1)
        k = np.arange(len(line)) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        share = np.divide(k, n[line], out=np.zeros(len(line)), where=n[line] > 0)
        t = np.floor(t0[line] + share * (t1 - t0)[line] + 0.5).astype(np.int64).tolist()
        c = np.floor(c0[line] + share * (c1 - c0)[line] + 0.5).astype(np.int64).tolist()
        kept, self.kept, self.ends, self.cells = self.kept, [], [], 0
        return ((*kept[i], x, y) for i, x, y in zip(line.tolist(), t, c))


def register(spark: SparkSession) -> SparkSession:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("block_transform", BlockTransform)
    spark.udtf.register("rasterise", Rasterise)
    return spark

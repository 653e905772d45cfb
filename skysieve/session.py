"""Session settings, the shared working folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "skysieve") -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster leave ``master`` and ``shuffle_partitions`` unset: AQE sizes the
    partitions from the measured shuffle output.
    """
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
    )
    if master:
        b = b.master(master).config("spark.driver.memory", "12g")  # one JVM does all the work
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting and gets a folder of its own: on a cluster
    each executor would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="skysieve-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    The lineage ends at the written table, so a lost executor costs no recomputation; unlike
    a checkpoint the plan runs only once, and later joins know the size of the table.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partitions by ``keys`` in the configured number, for stages that run Python.

    Their cost is arithmetic, not bytes, so partitions must not be merged for being small.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys to one partition each, in the configured number, for stages that are no grouping to Spark.

    The hash is not recognised as a partitioning by ``keys``: where rows already lie by them, Spark
    would drop the exchange and merge the partitions of the one before.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def whole_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType,
                 rows: int = 50_000) -> DataFrame:
    """``run(table, starts)`` on runs of whole groups, which begin at the places ``starts`` of the table.

    Many small groups cost one call together; a task holds about ``rows`` rows, or its largest group.
    """
    keys = list(keys)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, enough = [], 0, rows
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < enough:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            starts = _group_starts(table, keys)
            last = int(starts[-1])  # this group may go on
            if last:
                yield from run(table.slice(0, last), starts[:-1]).to_batches()
                table = table.slice(last)
            held, n = table.to_batches(), table.num_rows
            enough = max(rows, 2 * n)
        if n:
            table = pa.Table.from_batches(held).combine_chunks()
            yield from run(table, _group_starts(table, keys)).to_batches()

    return deal(df, *keys).sortWithinPartitions(*keys).mapInArrow(go, schema)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Places where a key differs from the row before; null is a key like any other."""
    new = np.ones(table.num_rows, bool)
    new[1:] = False
    for k in keys:
        column = table.column(k).combine_chunks()
        none = column.is_null().to_numpy(zero_copy_only=False)
        new[1:] |= pc.fill_null(pc.not_equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False)
        new[1:] |= none[1:] != none[:-1]
    return np.flatnonzero(new)


def numbers(table: pa.Table, name: str, kind: pa.DataType) -> np.ndarray:
    """A column as an array of its own; nulls only in floating point, as NaN."""
    return pc.cast(table.column(name), kind).to_numpy(zero_copy_only=False).copy()

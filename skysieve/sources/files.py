"""File sets of raw recordings: order, offsets, block ranges, headers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from skysieve.operators.sequences import small


def file_index(files: DataFrame, prefix: str, keys: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Roll-over files (base.dat, base_1.dat, ...) in numeric order with their byte offsets.

    The list has one row per file of at least one block, not per block or sample.
    """
    base = F.concat(F.lit(prefix), F.col(keys[0]).cast("string"), F.lit(".dat"))
    suffix = F.regexp_extract("path", r"_(\d+)\.dat$", 1).try_cast("int")
    part = F.when(F.col("path") == base, F.lit(0)).otherwise(F.coalesce(suffix, F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("part", part).withColumn("offset_bytes", F.coalesce(F.sum("n_bytes").over(w), F.lit(0)))


def time_ranges(index: DataFrame, block_bytes: int, block_seconds: float) -> DataFrame:
    """Whole blocks and time span of each file."""
    start = F.col("offset_bytes") / block_bytes * block_seconds
    end = (F.col("offset_bytes") + F.col("n_bytes")) / block_bytes * block_seconds
    return index.select("obs_id", "path", F.floor(F.col("n_bytes") / block_bytes).alias("n_blocks"),
                        start.alias("from_s"), end.alias("to_s"))


def block_range(df: DataFrame, skip: int = 0, limit: int | None = None, skip_seconds: float | None = None,
                seconds: float | None = None, block_seconds: float = 1.0) -> DataFrame:
    """Skip and limit as a range of block numbers, which prunes at the scan."""
    if skip_seconds is not None:
        skip = int(skip_seconds / block_seconds)
    if seconds is not None:
        limit = int(seconds / block_seconds)
    out = df.where(F.col("iter") >= skip)
    return out if limit is None else out.where(F.col("iter") <= skip + limit - 1)


def with_header(df: DataFrame, headers: DataFrame, keys: Sequence[str] = ("obs_id",)) -> DataFrame:
    """Observation metadata attached to its rows."""
    return df.join(small(headers), list(keys))

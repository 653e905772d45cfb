"""Ordered operations on long sequences without one task per sequence.

A plain window sends every row of a key to one task.  Here each key is cut into buckets along
its order (a coarse ``bucket`` column that never decreases with the order), the window runs
inside a bucket, and only one summary row per bucket crosses bucket borders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def _carry(df: DataFrame, keys: Sequence[str], bucket: str, value: Column, how=F.sum) -> DataFrame:
    """Per bucket: the aggregate of ``value`` over all earlier buckets of the key."""
    per_bucket = df.groupBy(*keys, bucket).agg(how(value).alias("_part"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per_bucket.withColumn("_carry", how("_part").over(w)).drop("_part")


def running(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: str, value: Column,
            name: str, how=F.sum) -> DataFrame:
    """Running aggregate (sum, max, min) up to and including the row."""
    tmp = df.withColumn("_v", value)
    carry = _carry(tmp, keys, bucket, F.col("_v"), how)
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = how("_v").over(w)
    joined = tmp.withColumn("_in", inner).join(carry, [*keys, bucket])
    if how is F.sum:
        total = F.coalesce(F.col("_carry"), F.lit(0)) + F.coalesce(F.col("_in"), F.lit(0))
    elif how is F.max:
        total = F.greatest("_in", "_carry")
    else:
        total = F.least("_in", "_carry")
    return joined.withColumn(name, total).drop("_v", "_in", "_carry")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: str,
              name: str = "row_index") -> DataFrame:
    """1-based position of the row inside its key."""
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (
        df.withColumn("_rn", F.row_number().over(inner))
        .join(offsets, [*keys, bucket])
        .withColumn(name, F.col("_rn") + F.col("_off"))
        .drop("_rn", "_off")
    )


def previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: str,
             columns: dict[str, str]) -> DataFrame:
    """Values of the preceding row of the key: ``{new column: source column}``."""
    src = list(columns.values())
    last = df.groupBy(*keys, bucket).agg(
        F.max_by(F.struct(*src), F.struct(*order)).alias("_last"))
    w = Window.partitionBy(*keys).orderBy(bucket)
    edge = last.withColumn("_carry", F.lag("_last").over(w)).drop("_last")
    inner = Window.partitionBy(*keys, bucket).orderBy(*order)
    out = (
        df.withColumn("_prev", F.lag(F.struct(*src)).over(inner))
        .withColumn("_first", F.row_number().over(inner) == 1)
        .join(edge, [*keys, bucket])
    )
    chosen = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    out = out.withColumn("_p", chosen)
    for new, old in columns.items():
        out = out.withColumn(new, F.col("_p").getField(old))
    return out.drop("_prev", "_first", "_carry", "_p")


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence, bucket: str, n: int,
            aggregates: dict[str, Column], chunk: int = 4096) -> DataFrame:
    """Window aggregates over the current and the ``n - 1`` preceding rows of the key.

    Rows are cut into chunks of ``chunk`` by their exact position; the last ``n - 1`` rows of
    a chunk are also sent to the next one, so frames never miss a row.
    """
    chunk = max(chunk, n)
    ranked = row_index(df, keys, order, bucket, "_pos").withColumn(
        "_home", F.floor((F.col("_pos") - 1) / chunk))
    spill = F.pmod(F.col("_pos") - 1, F.lit(chunk)) >= chunk - (n - 1)
    targets = F.when(spill & F.lit(n > 1), F.array(F.col("_home"), F.col("_home") + 1)).otherwise(
        F.array(F.col("_home")))
    w = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(n - 1), 0)
    out = ranked.withColumn("_chunk", F.explode(targets))
    for name, agg in aggregates.items():
        out = out.withColumn(name, agg.over(w))
    return out.where(F.col("_chunk") == F.col("_home")).drop("_pos", "_home", "_chunk")


def small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast hint for a dimension, given only after its size was checked.

    A larger table is returned as it is and joins by shuffle.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df

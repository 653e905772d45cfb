"""Space partition of image pixels into small leaves."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from skysieve.session import cut, numbers, whole_groups

IMAGE = ("iter", "beam_id")
BOX = ("x1", "x2", "y1", "y2")


def kd_partition(pixels: DataFrame, n_channels: int, n_times: int, leaf: int = 40,
                 keys: Sequence[str] = IMAGE, task_points: int = 20_000) -> DataFrame:
    """Leaves of at most ``leaf`` pixels: halve the widest axis at its middle until small.

    Adds ``node`` (coarse part, the unit of later per-task work), ``leaf`` and the leaf box.
    Parts above ``task_points`` pixels are split by distributed rounds of extents per node;
    what remains is finished inside tasks, so no task ever holds a larger part.  Low side is
    ``<=``; boxes do not overlap.  Pixels in one place cannot be split and stay one leaf,
    however many.
    """
    keys = list(keys)
    df = pixels.select(*keys, "channel_sample", "time_idx", "power")
    df = df.withColumn("node", F.lit(1).cast("bigint"))
    for name, value in zip(BOX, (0.0, float(n_times), 0.0, float(n_channels))):
        df = df.withColumn(name, F.lit(value))
    while True:
        wide = (F.max("channel_sample") > F.min("channel_sample")) | (F.max("time_idx") > F.min("time_idx"))
        top = df.groupBy(*keys, "node").agg(F.count("*").alias("n"), wide.alias("wide")).where("wide").agg(F.max("n")).first()[0] or 0
        if top <= task_points:
            break
        df = cut(_split_round(df, keys, task_points))
    leaf_schema = T.StructType([pixels.schema[k] for k in keys] + [
        T.StructField("channel_sample", T.IntegerType()), T.StructField("time_idx", T.IntegerType()),
        T.StructField("power", T.DoubleType()), T.StructField("node", T.LongType()),
        T.StructField("leaf", T.LongType())] + [T.StructField(b, T.DoubleType()) for b in BOX])

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ch, t = numbers(table, "channel_sample", pa.float64()), numbers(table, "time_idx", pa.float64())
        ids = numbers(table, "node", pa.int64())
        box = np.stack([numbers(table, name, pa.float64()) for name in BOX], 1)
        at = np.arange(table.num_rows)  # pixels of open parts, part by part
        while len(at):
            c, v = ch[at], t[at]
            c0, c1, t0, t1 = (f.reduceat(x, starts) for x in (c, v) for f in (np.minimum, np.maximum))
            n, wide_c, wide_t = np.diff(np.append(starts, len(at))), c1 - c0, t1 - t0
            split = (n > leaf) & ((wide_c > 0) | (wide_t > 0))
            by_c = (wide_c >= wide_t) | np.isnan(wide_t)
            middle = np.where(by_c, (c0 + c1) / 2, (t0 + t1) / 2)
            part = np.repeat(np.arange(len(starts)), n)
            on = np.flatnonzero(split[part])
            at, part = at[on], part[on]
            high = np.where(by_c[part], c[on], v[on]) > middle[part]
            ids[at] = ids[at] * 2 + high
            box[at, np.where(by_c[part], np.where(high, 2, 3), np.where(high, 0, 1))] = middle[part]
            order = np.argsort(part * 2 + high, kind="stable")
            at, side = at[order], (part * 2 + high)[order]
            starts = np.flatnonzero(np.diff(side, prepend=-1))
        out = table.select([*keys, "channel_sample", "time_idx", "power", "node"]).append_column("leaf", pa.array(ids))
        for i, name in enumerate(BOX):
            out = out.append_column(name, pa.array(box[:, i]))
        return out

    df = df.withColumns({"channel_sample": F.col("channel_sample").cast("int"), "time_idx": F.col("time_idx").cast("int"),
                         "power": F.col("power").cast("double")})
    return whole_groups(df, [*keys, "node"], run, leaf_schema)


def _split_round(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """One distributed split of every node above ``limit``."""
    ext = df.groupBy(*keys, "node").agg(
        F.count("*").alias("_n"), F.min("channel_sample").alias("_c0"), F.max("channel_sample").alias("_c1"),
        F.min("time_idx").alias("_t0"), F.max("time_idx").alias("_t1")).where(
        (F.col("_n") > limit) & ((F.col("_c1") > F.col("_c0")) | (F.col("_t1") > F.col("_t0"))))
    ext = ext.withColumn("_axis", F.when(F.col("_c1") - F.col("_c0") >= F.col("_t1") - F.col("_t0"), 0).otherwise(1))
    ext = ext.withColumn("_at", F.when(F.col("_axis") == 0, (F.col("_c0") + F.col("_c1")) / 2).otherwise(
        (F.col("_t0") + F.col("_t1")) / 2)).select(*keys, "node", "_axis", "_at")
    j = df.join(ext, keys + ["node"], "left")
    high = F.when(F.col("_axis") == 0, F.col("channel_sample")).otherwise(F.col("time_idx")) > F.col("_at")
    for name, axis, when_high in (("x1", 1, True), ("x2", 1, False), ("y1", 0, True), ("y2", 0, False)):
        j = j.withColumn(name, F.when((F.col("_axis") == axis) & (high if when_high else ~high),
                                      F.col("_at")).otherwise(F.col(name)))
    return j.withColumn("node", F.when(F.col("_axis").isNotNull(), F.col("node") * 2 + high.cast("bigint")).otherwise(
        F.col("node"))).drop("_axis", "_at")


def leaf_gate(leaves: DataFrame, noise: DataFrame, keys: Sequence[str] = IMAGE, min_points: int = 2,
              snr_db: float = 5.0) -> DataFrame:
    """Keep leaves with more than ``min_points`` pixels and, inside them, pixels whose power
    exceeds the leaf mean less the noise at the given SNR.

    ``noise(keys, beam_noise)``.  The leaf mean is an aggregate over at most one leaf.
    """
    keys = list(keys)
    own = Window.partitionBy(*keys, "node", "leaf")  # the leaves are made once, not again for their means
    stats = leaves.withColumn("_m", F.avg("power").over(own)).withColumn("_n", F.count("*").over(own)).where(F.col("_n") > min_points)
    gate = F.col("_m") - F.col("beam_noise") * (10 ** (snr_db / 10))
    columns = [*keys, "node", "leaf", *[c for c in leaves.columns if c not in (*keys, "node", "leaf")]]
    return stats.join(noise.select(*keys, "beam_noise"), keys).where(F.col("power") > gate).select(*columns)

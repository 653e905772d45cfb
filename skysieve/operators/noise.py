"""Power, noise estimates and moving statistics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from skysieve.operators.sequences import rolling

PIXEL_KEYS = ("iter", "beam_id", "channel_sample")


def doppler_window(spectra: DataFrame, start_mhz: float, channel_mhz: float, tx_mhz: float,
                   lo_hz: float, hi_hz: float, channel: str = "channel_sample") -> DataFrame:
    """Channels strictly inside the Doppler range around the transmitter, renumbered from 0.

    The frequency bounds are turned into whole channel bounds here, so the predicate is a
    plain range on the stored column and reaches the scan.
    """
    a, b = tx_mhz + lo_hz * 1e-6, tx_mhz + hi_hz * 1e-6
    first = int(np.floor((a - start_mhz) / channel_mhz))
    while start_mhz + first * channel_mhz <= a:
        first += 1
    first = max(first, 0)
    last = int(np.ceil((b - start_mhz) / channel_mhz))
    while start_mhz + last * channel_mhz >= b:
        last -= 1
    kept = spectra.where((F.col(channel) >= first) & (F.col(channel) <= last))
    return kept.withColumn("channel", F.lit(start_mhz) + F.col(channel) * channel_mhz).withColumn(
        channel, F.col(channel) - F.lit(first))


def channel_noise(pixels: DataFrame, keys: Sequence[str] = PIXEL_KEYS) -> DataFrame:
    """Median and population deviation over time; a group is one channel of one block."""
    return pixels.groupBy(*keys).agg(
        F.median("power").alias("noise"), F.stddev_pop("power").alias("noise_std"))


def strip_noise(strips: DataFrame) -> DataFrame:
    """The same for dense rows that hold a whole channel of a block as array: no shuffle."""
    schema = T.StructType([*strips.schema.fields, T.StructField("noise", T.DoubleType()),
                           T.StructField("noise_std", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                sizes = b["power"].map(len)
                for _, g in b.groupby(sizes, sort=False):
                    x = np.stack(g["power"].to_numpy())
                    yield g.assign(noise=np.median(x, axis=1), noise_std=x.std(axis=1))

    return strips.mapInPandas(run, schema)


def rolling_noise(noise: DataFrame, n_blocks: int = 10, keys: Sequence[str] = ("beam_id", "channel_sample"),
                  bucket_blocks: int = 1024) -> DataFrame:
    """Median over the last ``n_blocks`` block estimates, the current one included."""
    df = noise.withColumn("_bucket", F.floor(F.col("iter") / bucket_blocks))
    out = rolling(df, list(keys), ["iter"], "_bucket", n_blocks, {
        "channel_noise": F.percentile("noise", F.lit(0.5)),
        "channel_noise_std": F.percentile("noise_std", F.lit(0.5))})
    return out.drop("_bucket")


def subtract_noise(pixels: DataFrame, noise: DataFrame, keys: Sequence[str] = PIXEL_KEYS,
                   column: str = "channel_noise") -> DataFrame:
    """Power above the noise of its channel; both sides share the join keys."""
    n = noise.select(*keys, F.col(column).alias("_n"))
    return pixels.join(n, list(keys)).withColumn("power", F.col("power") - F.col("_n")).drop("_n")


def beam_noise(noise: DataFrame, keys: Sequence[str] = ("iter", "beam_id"), column: str = "noise") -> DataFrame:
    """Mean and median of the channel noise of each beam."""
    return noise.groupBy(*keys).agg(F.avg(column).alias("beam_noise"), F.median(column).alias("beam_median"))


def overall_noise(noise: DataFrame, keys: Sequence[str] = ("iter",), column: str = "noise") -> DataFrame:
    return noise.groupBy(*keys).agg(F.median(column).alias("mean_noise"))


def observation_noise_summary(noise: DataFrame, at_iter: int, column: str = "channel_noise") -> DataFrame:
    """Noise written once after warm-up: overall median and median per beam."""
    one = noise.where(F.col("iter") == at_iter)
    per_beam = one.groupBy("iter", "beam_id").agg(F.median(column).alias("noise_beam"))
    overall = one.groupBy("iter").agg(F.median(column).alias("noise_mean"))
    return per_beam.join(overall, "iter")


def chunk_statistics(pixels: DataFrame, keys: Sequence[str], chunk: int = 32) -> DataFrame:
    """Mean and deviation per chunk of samples."""
    return pixels.withColumn("chunk", F.floor(F.col("time_idx") / chunk)).groupBy(*keys, "chunk").agg(
        F.avg("power").alias("mean"), F.stddev_pop("power").alias("std"))


def moving_chunk_average(stats: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    """Mean of the last ``n`` chunk statistics; a block has only a handful of chunks."""
    w = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(-(n - 1), 0)
    return stats.withColumn("avg_mean", F.avg("mean").over(w)).withColumn("avg_std", F.avg("std").over(w))


def bandpass(pixels: DataFrame, keys: Sequence[str] = ("iter", "beam_id")) -> DataFrame:
    """Power summed over time per channel."""
    return pixels.groupBy(*keys, "channel_sample").agg(F.sum("power").alias("power"))


def total_power_db(pixels: DataFrame, keys: Sequence[str] = ("iter", "beam_id", "time_idx")) -> DataFrame:
    """Mean power over channels in dB."""
    return pixels.groupBy(*keys).agg(F.avg("power").alias("_m")).select(
        *keys, F.when(F.col("_m") > 0, 10 * F.log10("_m")).alias("power_db"))


def sparse(pixels: DataFrame) -> DataFrame:
    """Pixels with positive power."""
    return pixels.where(F.col("power") > 0)


def sparse_from_strips(strips: DataFrame, threshold="threshold") -> DataFrame:
    """Explode dense strips and keep what exceeds the row's threshold, in one codegen span."""
    keys = [c for c in strips.columns if c != "power"]
    return strips.select(*keys, F.posexplode("power").alias("time_idx", "power")).where(
        F.col("power") > F.col(threshold))


def skip_warm_up(df: DataFrame, blocks: int = 2) -> DataFrame:
    return df.where(F.col("iter") >= blocks)

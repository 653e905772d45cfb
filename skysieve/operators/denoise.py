"""Noise and interference filters; each is ``pixels -> pixels`` and usable by name."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skysieve.operators import image, thresholds

IMAGE = ("iter", "beam_id")


def background(pixels: DataFrame, noise: DataFrame, n_sigma: float = 3.0, fill: float | None = 0.0,
               keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels at or below noise + n_sigma * std of their channel get ``fill`` (None drops them)."""
    channel = [*keys, "channel_sample"]
    n = noise.select(*channel, (n_sigma * F.col("channel_noise_std") + F.col("channel_noise")).alias("_t"))
    j = pixels.join(n, channel)
    if fill is None:
        return j.where(F.col("power") > F.col("_t")).drop("_t")
    return j.withColumn("power", F.when(F.col("power") <= F.col("_t"), F.lit(fill)).otherwise(F.col("power"))).drop("_t")


def triangle_gate(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Drop pixels below the triangle threshold of their image."""
    return thresholds.above(pixels, thresholds.triangle(pixels, n_bins, keys), keys)


def triangle_with_fallback(pixels: DataFrame, noise: DataFrame, max_points: int = 1_000_000,
                           n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Triangle gate; blocks that keep more than ``max_points`` are sigma-clipped as well.

    The decision is a column, so both cases are one plan.  Blocks are treated by their load, as in
    the survey's overload rule, so this is a step of its own and not part of the default chain.
    """
    kept = triangle_gate(pixels, n_bins, keys)
    block, channel = [k for k in keys if k != "beam_id"], [*keys, "channel_sample"]
    load = kept.where("power > 0").groupBy(*block).agg((F.count("*") > max_points).alias("_over"))
    n = noise.select(*channel, (3.0 * F.col("channel_noise_std") + F.col("channel_noise")).alias("_t"))
    return (
        kept.join(load, block, "left").join(n, channel, "left")
        .where(~F.coalesce(F.col("_over"), F.lit(False)) | (F.col("power") > F.col("_t")))
        .drop("_over", "_t")
    )


def rfi_peaks(pixels: DataFrame, n_sigma: float = 5.0, fill: float = -100.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Channels whose time sum stands out over all beams and channels, blanked in every beam."""
    block = [k for k in keys if k != "beam_id"]
    sums = pixels.groupBy(*keys, "channel_sample").agg(F.sum("power").alias("_s"))
    stats = sums.groupBy(*block).agg((F.avg("_s") + n_sigma * F.stddev_pop("_s")).alias("_t"))
    bad = sums.join(stats, block).where("_s > _t").select(*block, "channel_sample").distinct().withColumn(
        "_bad", F.lit(True))
    return pixels.join(bad, [*block, "channel_sample"], "left").withColumn(
        "power", F.when(F.col("_bad"), F.lit(fill)).otherwise(F.col("power"))).drop("_bad")


def rfi_persistent(pixels: DataFrame, beam_noise: DataFrame, n_samples: int, n_sigma: float = 3.0,
                   share: float = 0.6, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Channels with an outstanding sum that also exceed the beam noise most of the time."""
    keys = list(keys)
    b = beam_noise.select(*keys, F.col("beam_noise").alias("_bn"))
    sums = pixels.join(b, keys).groupBy(*keys, "channel_sample").agg(
        F.sum("power").alias("_s"), F.count_if(F.col("power") > F.col("_bn")).alias("_n"))
    stats = sums.groupBy(*keys).agg((F.avg("_s") + n_sigma * F.stddev_pop("_s")).alias("_t"))
    bad = sums.join(stats, keys).where(
        (F.col("_s") > F.col("_t")) & (F.col("_n") > share * n_samples)).join(b, keys).select(*keys, "channel_sample", "_bn")
    return pixels.join(bad, [*keys, "channel_sample"], "left").withColumn(
        "power", F.coalesce("_bn", "power")).drop("_bn")


def rfi_mean_fill(pixels: DataFrame, n_sigma: float = 5.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Outstanding channels of an image are replaced by the image mean."""
    keys = list(keys)
    sums = pixels.groupBy(*keys, "channel_sample").agg(F.sum("power").alias("_s"), F.count("*").alias("_n"))
    stats = sums.groupBy(*keys).agg((F.avg("_s") + n_sigma * F.stddev_pop("_s")).alias("_t"),
                                    (F.sum("_s") / F.sum("_n")).alias("_mean"))
    bad = sums.join(stats, keys).where("_s > _t").select(*keys, "channel_sample", "_mean")
    return pixels.join(bad, [*keys, "channel_sample"], "left").withColumn(
        "power", F.coalesce("_mean", "power")).drop("_mean")


def pepper(pixels: DataFrame, n_channels: int, n_times: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    return image.remove_isolated(pixels, n_channels, n_times, 1, keys)


def denoise(pixels: DataFrame, noise: DataFrame, n_channels: int, n_times: int,
            steps: Sequence[str] = ("triangle", "pepper"), keys: Sequence[str] = IMAGE) -> DataFrame:
    """Ordered list of filters by name; the default pair is the enabled one.

    ``keys`` name an image: block and beam, and the observation where a table has several.
    """
    known = {
        "triangle": lambda p: triangle_gate(p, keys=keys),
        "triangle_with_fallback": lambda p: triangle_with_fallback(p, noise, keys=keys),
        "pepper": lambda p: pepper(p, n_channels, n_times, keys),
        "sigma_clip": lambda p: background(p, noise, 3.0, None, keys),
        "background": lambda p: background(p, noise, 3.0, -50.0, keys),
        "rfi_peaks": lambda p: rfi_peaks(p, keys=keys),
        "rfi_mean": lambda p: rfi_mean_fill(p, keys=keys),
    }
    for s in steps:
        pixels = known[s](pixels)
    return pixels

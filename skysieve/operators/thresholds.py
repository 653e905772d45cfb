"""Thresholds of images (a block of one beam), chosen by name.

Every threshold is a table with one row per image.  Histogram thresholds work on at most
``n_bins`` rows per image, so the ordered steps are windows over bounded groups; ties go to
the lowest bin.  Sums run over bin numbers instead of bin centres where the criterion does
not depend on the unit, which keeps them exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skysieve.session import deal

IMAGE = ("iter", "beam_id")


def value_range(pixels: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    return pixels.groupBy(*keys).agg(F.min("power").alias("lo"), F.max("power").alias("hi"))


def _bin_counts(pixels: DataFrame, n_bins: int, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Range of each image and pixels in its bins, those without a pixel left out."""
    rng = value_range(pixels, keys)
    ratio = F.try_divide(F.col("power") - F.col("lo"), F.col("hi") - F.col("lo")) * n_bins
    b = F.least(F.lit(n_bins - 1), F.floor(ratio)).cast("int")
    return rng, pixels.join(rng, keys).where("hi > lo").groupBy(*keys, b.alias("bin")).agg(
        F.count("*").alias("_n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def histogram(pixels: DataFrame, n_bins: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Equal-width bins from image minimum to maximum, empty bins included."""
    keys = list(keys)
    rng, counts = _bin_counts(pixels, n_bins, keys)
    grid = rng.where("hi > lo").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return grid.join(counts.drop("lo", "hi"), keys + ["bin"], "left").withColumn("n", F.coalesce("_n", F.lit(0))).drop("_n")


def _centre(n_bins: int) -> Column:
    return F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / n_bins


def _best(df: DataFrame, keys: Sequence[str], score: Column, value: Column, tie: Column) -> DataFrame:
    """Value at the highest score; the lowest ``tie`` wins."""
    return df.where(score.isNotNull()).groupBy(*keys).agg(
        F.max_by(value, F.struct(score, -tie)).alias("threshold"))


def _cumulative(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    n, b = F.col("n"), F.col("bin")
    return (
        h.withColumn("c", F.sum(n).over(up)).withColumn("cb", F.sum(n * b).over(up))
        .withColumn("sq", F.sum(n * n).over(up)).withColumn("tc", F.sum(n).over(whole))
        .withColumn("tcb", F.sum(n * b).over(whole)).withColumn("tsq", F.sum(n * n).over(whole))
    )


def triangle(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Bin farthest below the line from the peak to the longer tail; 1.0 for a flat image."""
    keys = list(keys)
    h = histogram(pixels, n_bins, keys)
    w = Window.partitionBy(*keys)
    used = F.when(F.col("n") > 0, F.col("bin"))
    h = (
        h.withColumn("_top", F.max(F.struct(F.col("n"), (-F.col("bin")).alias("b"))).over(w))
        .withColumn("_a", F.min(used).over(w)).withColumn("_z", F.max(used).over(w))
        .withColumn("_p", -F.col("_top.b"))
    )
    right = (F.col("_p") - F.col("_a")) < (F.col("_z") - F.col("_p"))
    width = F.when(right, F.col("_z") - F.col("_p")).otherwise(F.col("_p") - F.col("_a"))
    x = F.when(right, F.col("_z") - F.col("bin")).otherwise(F.col("bin") - F.col("_a"))
    score = F.col("_top.n") * x - width * F.col("n")
    found = _best(h.where((x >= 0) & (x < width)), keys, score, _centre(n_bins), x)
    return value_range(pixels, keys).join(found, keys, "left").select(
        *keys, F.coalesce("threshold", F.lit(1.0)).alias("threshold"))


def otsu(pixels: DataFrame, n_bins: int = 256, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Largest between-class variance."""
    h = _cumulative(histogram(pixels, n_bins, keys), keys)
    c2, m1 = F.col("tc") - F.col("c"), F.try_divide(F.col("cb"), F.col("c"))
    d = m1 - F.try_divide(F.col("tcb") - F.col("cb"), c2)
    return _best(h, keys, F.col("c") * c2 * d * d, _centre(n_bins), F.col("bin"))


def yen(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Largest entropy-like correlation of the two classes."""
    h = _cumulative(histogram(pixels, n_bins, keys), keys)
    c = F.col("c").cast("double")
    a = c * (F.col("tc") - c)
    s2 = (F.col("tsq") - F.col("sq")).cast("double")
    return _best(h.where("c < tc"), keys, F.try_divide(a * a, F.col("sq").cast("double") * s2),
                 _centre(n_bins), F.col("bin"))


def isodata(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """First bin whose centre lies at most one bin below the mean of the class means."""
    h = _cumulative(histogram(pixels, n_bins, keys), keys)
    mid = (F.try_divide(F.col("cb"), F.col("c"))
           + F.try_divide(F.col("tcb") - F.col("cb"), F.col("tc") - F.col("c"))) / 2 - F.col("bin")
    return h.where((mid >= 0) & (mid < 1)).groupBy(*keys).agg(
        F.min_by(_centre(n_bins), F.col("bin")).alias("threshold"))


def kittler(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Minimum error of two normal classes; the result is a left bin edge."""
    up = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    h = histogram(pixels, n_bins, keys).withColumn(
        "g", F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / n_bins)
    n, g, eps = F.col("n"), F.col("g"), 1e-6
    h = (h.withColumn("c", F.sum(n).over(up)).withColumn("m", F.sum(n * g).over(up))
         .withColumn("s", F.sum(n * g * g).over(up)).withColumn("tc", F.sum(n).over(whole))
         .withColumn("tm", F.sum(n * g).over(whole)).withColumn("ts", F.sum(n * g * g).over(whole)))
    mf = F.col("m") / F.col("c")
    vf = F.col("s") / F.col("c") - mf * mf
    cb = F.col("tc") - F.col("c") + eps
    mb = (F.col("tm") - F.col("m") + eps) / cb
    vb = (F.col("ts") - F.col("s") + eps) / cb - mb * mb
    p = F.col("c") / F.col("tc")
    cost = F.when((vf >= 0) & (vb >= 0) & (p < 1),
                  p * F.log(F.sqrt(vf) + eps) + (1 - p) * F.log(F.sqrt(vb) + eps)
                  - p * F.log(p) - (1 - p) * F.log(1 - p))
    return _best(h, keys, -cost, g, F.col("bin"))


def minimum(pixels: DataFrame, n_bins: int = 1024, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Lowest point between the two peaks that remain after repeated 3-bin smoothing.

    The filled bins of each image are one array row, at most ``n_bins`` of them; images with other
    than two final peaks have no threshold.
    """
    keys = list(keys)
    counts = _bin_counts(pixels, n_bins, keys)[1].where("bin IS NOT NULL")
    rows = counts.groupBy(*keys).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.collect_list(F.struct("bin", "_n")).alias("_h"))
    rows = rows.select(*keys, "lo", "hi", F.col("_h.bin").alias("_bins"), F.col("_h._n").alias("_counts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                bins, counts = part.column(part.num_columns - 2), part.column(part.num_columns - 1)
                h = np.zeros((part.num_rows, n_bins))
                h[np.repeat(np.arange(len(h)), pc.list_value_length(bins).to_numpy()), bins.flatten().to_numpy()] = counts.flatten().to_numpy()
                found = _valleys(h)
                at = pa.array([i for i, v in enumerate(found) if v is not None], pa.int64())
                out = pa.Table.from_batches([part]).select([*keys, "lo", "hi"]).take(at).append_column(
                    "bin", pa.array([v for v in found if v is not None], pa.int32()))
                yield from out.to_batches()

    # few bytes but much arithmetic per row: spread over all tasks whatever the data size.  A filter on
    # the result of a column function would run it before the spreading too, in few merged tasks.
    schema = T.StructType([rows.schema[c] for c in (*keys, "lo", "hi")] + [T.StructField("bin", T.IntegerType())])
    return deal(rows, *keys).mapInArrow(run, schema).select(*keys, _centre(n_bins).alias("threshold"))


def _valleys(x: np.ndarray, max_rounds: int = 10000, together: int = 32) -> list[int | None]:
    """Lowest bin between two peaks for a batch of histograms (rows).

    ``together`` of them are smoothed at a time, which stay in a core's cache; a finished one
    makes room for the next.
    """
    result: list[int | None] = [None] * len(x)
    width = x.shape[1]
    pad = np.empty((together, width + 2))  # a bin more at both ends
    new = np.empty((together, width))
    rows, rounds = np.zeros(0, np.int64), np.zeros(0, np.int64)
    following = 0
    while True:
        n = min(together - len(rows), len(x) - following)
        if n:
            pad[len(rows):len(rows) + n, 1:-1] = x[following:following + n]
            rows = np.append(rows, np.arange(following, following + n))
            rounds = np.append(rounds, np.zeros(n, np.int64))
            following += n
        if not len(rows):
            return result
        p, s = pad[:len(rows)], new[:len(rows)]
        p[:, 0], p[:, -1] = p[:, 1], p[:, -2]
        np.add(p[:, :-2], p[:, 1:-1], out=s)
        np.add(s, p[:, 2:], out=s)
        np.divide(s, 3, out=p[:, 1:-1])
        y = p[:, 1:-1]
        up, down = y[:, 1:] > y[:, :-1], y[:, 1:] < y[:, :-1]
        peak = down.copy()
        peak[:, 1:] &= up[:, :-1]
        level = np.flatnonzero(_count(up | down) < width - 1)
        if len(level):
            peak[level] = _peaks_with_plateaus(np.diff(y[level], axis=1))
        count = _count(peak)
        rounds += 1
        done = (count < 3) | (rounds >= max_rounds)
        if done.any():
            for i in np.flatnonzero(count == 2):
                a, b = np.flatnonzero(peak[i])
                result[rows[i]] = int(a + np.argmin(y[i, a: b + 1]))
            kept = np.flatnonzero(~done)
            pad[:len(kept)] = p[kept]
            rows, rounds = rows[kept], rounds[kept]


def _count(flags: np.ndarray) -> np.ndarray:
    return np.add.reduce(flags.view(np.uint8), axis=1, dtype=np.uint32)


def _peaks_with_plateaus(step: np.ndarray) -> np.ndarray:
    """Bins left downwards that were reached upwards, level stretches skipped."""
    columns = np.arange(step.shape[1])
    last = np.maximum.accumulate(np.where(step != 0, columns, -1), axis=1)
    before = np.concatenate([np.full((len(step), 1), -1), last[:, :-1]], axis=1)
    came = np.where(before < 0, 1.0, np.take_along_axis(step, np.maximum(before, 0), axis=1))
    return (step < 0) & (came > 0)


def mean_sigma(pixels: DataFrame, n_sigma: float = 3.0, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Mean plus ``n_sigma`` deviations; per image, channel or chunk according to the keys."""
    return pixels.groupBy(*keys).agg(
        (F.avg("power") + n_sigma * F.stddev_pop("power")).alias("threshold"))


def sigma_clip(pixels: DataFrame, rounds: int, lower: float, upper: float, median: bool,
               keys: Sequence[str] = IMAGE) -> DataFrame:
    """Bounds after repeated clipping at centre - lower*std .. centre + upper*std.

    Each round needs only the bounds of the one before: one row per image.  Once nothing is
    clipped any more the bounds stay, so a fixed number of rounds equals stopping early.
    """
    keys = list(keys)
    bounds = None
    for _ in range(rounds):
        kept = pixels.select(*keys, "power")
        if bounds is not None:
            kept = kept.join(bounds, keys).where((F.col("power") >= F.col("low")) & (F.col("power") <= F.col("high")))
        centre = F.median("power") if median else F.avg("power")
        aggs = [centre.alias("_c"), F.stddev_pop("power").alias("_s")]
        if bounds is not None:
            aggs += [F.first("low").alias("_l"), F.first("high").alias("_h")]
        stats = kept.groupBy(*keys).agg(*aggs)
        low, high = F.col("_c") - lower * F.col("_s"), F.col("_c") + upper * F.col("_s")
        if bounds is not None:
            low, high = F.greatest(low, F.col("_l")), F.least(high, F.col("_h"))
        bounds = stats.select(*keys, low.alias("low"), high.alias("high"))
    return bounds


def tile_background(pixels: DataFrame, tile: int = 50, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Per tile: median and deviation after clipping, threshold = median + 3 deviations.

    Pixels use the threshold of their own tile (no interpolation between tiles).
    """
    t = pixels.withColumn("tile_c", F.floor(F.col("channel_sample") / tile)).withColumn(
        "tile_t", F.floor(F.col("time_idx") / tile))
    keys = [*keys, "tile_c", "tile_t"]
    bounds = sigma_clip(t, 3, 10.0, 3.0, False, keys)
    kept = t.join(bounds, keys).where((F.col("power") >= F.col("low")) & (F.col("power") <= F.col("high")))
    return kept.groupBy(*keys).agg(F.median("power").alias("background"), F.stddev_pop("power").alias("rms")).withColumn(
        "threshold", F.col("background") + 3.0 * F.col("rms"))


def chunked(threshold: Callable[..., DataFrame], chunk: int = 32, keys: Sequence[str] = IMAGE, **kw):
    """Any threshold applied per chunk of samples: the chunk becomes part of the image key."""

    def run(pixels: DataFrame) -> DataFrame:
        return threshold(pixels.withColumn("chunk", F.floor(F.col("time_idx") / chunk)),
                         keys=[*keys, "chunk"], **kw)

    return run


THRESHOLDS: dict[str, Callable[..., DataFrame]] = {
    "triangle": lambda p, **k: triangle(p, **{"n_bins": 2048, **k}),
    "otsu": otsu, "yen": yen, "isodata": isodata, "kittler": kittler, "minimum": minimum,
    "global": mean_sigma,
    "local": lambda p, **k: mean_sigma(p, **{"keys": ("iter", "beam_id", "channel_sample"), **k}),
}


def above(pixels: DataFrame, thresholds: DataFrame, keys: Sequence[str] = IMAGE, strict: bool = False) -> DataFrame:
    """Pixels that are not below their threshold; images without one (flat, or not solved) keep all of theirs."""
    j = pixels.join(thresholds.select(*keys, "threshold"), list(keys), "left")
    cond = F.col("power") > F.col("threshold") if strict else F.col("power") >= F.col("threshold")
    return j.where(F.col("threshold").isNull() | cond).drop("threshold")

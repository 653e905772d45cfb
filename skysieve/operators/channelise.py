"""Polyphase channeliser."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T


def prototype_filter(n_chans: int, n_taps: int, width: float = 1.0) -> np.ndarray:
    """Sinc times Hann low-pass, in the order it is applied."""
    n = n_taps * n_chans
    x = np.arange(n) / n_chans - n_taps / 2
    return (np.sinc(width * x) * np.hanning(n))[::-1]


def filter_coefficient(k, n_chans: int, n_taps: int, width: float = 1.0) -> Column:
    """The same coefficient number ``k`` as a column expression."""
    n = n_taps * n_chans
    j = F.lit(n - 1) - (F.col(k) if isinstance(k, str) else k)
    x = F.lit(np.pi * width) * (j / F.lit(n_chans) - F.lit(n_taps / 2))
    sinc = F.when(x == 0, F.lit(1.0)).otherwise(F.try_divide(F.sin(x), x))
    return sinc * (0.5 - 0.5 * F.cos(F.lit(2 * np.pi) * j / (n - 1)))


def fir(samples: DataFrame, n_chans: int, n_taps: int, keys: Sequence[str] = ("ant",)) -> DataFrame:
    """Weighted tap sums per (stream, spectrum, position), long form.

    A sample is addressed by its global number, so block borders do not exist: it feeds the
    ``n_taps`` spectra whose window covers it, and the sums combine before the shuffle.
    Spectrum m covers samples (m - n_taps) * n_chans onwards; what lies before the start of
    the stream counts as zero.
    """
    s = F.col("sample")
    spread = samples.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(n_taps - 1))))
    spread = spread.withColumn("pos", (s % n_chans).cast("int")).withColumn("spectrum", F.floor(s / n_chans) - F.col("_j") + n_taps)
    h = filter_coefficient(F.col("_j") * n_chans + F.col("pos"), n_chans, n_taps)
    return spread.groupBy(*keys, "spectrum", "pos").agg(F.sum(F.col("re") * h).alias("re"), F.sum(F.col("im") * h).alias("im"))


def channelise(samples: DataFrame, n_chans: int, n_taps: int, keys: Sequence[str] = ("ant",)) -> DataFrame:
    """Spectra of a sparse or long-form stream: tap sums, then one FFT per spectrum row."""
    keys = list(keys)
    cells = fir(samples, n_chans, n_taps, keys)
    rows = cells.groupBy(*keys, "spectrum").agg(F.collect_list(F.struct("pos", "re", "im")).alias("_c")).select(
        *keys, "spectrum", F.col("_c.pos").alias("pos"), F.col("_c.re").alias("re"), F.col("_c.im").alias("im"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = np.zeros((len(b), n_chans), complex)
            for i, (p, re, im) in enumerate(zip(b["pos"], b["re"], b["im"])):
                x[i, p] = np.asarray(re) + 1j * np.asarray(im)
            y = np.fft.fftshift(np.fft.fft(x, axis=1), axes=1)
            out = b[keys + ["spectrum"]].copy()
            out["re"], out["im"] = list(y.real), list(y.imag)
            yield out

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([samples.schema[k] for k in keys] + [
        T.StructField("spectrum", T.LongType()), T.StructField("re", arr), T.StructField("im", arr)])
    spec = rows.mapInPandas(run, schema)
    return spec.select(*keys, "spectrum", F.posexplode(F.arrays_zip("re", "im")).alias("channel", "_v")).select(
        *keys, "spectrum", "channel", F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def block_spectra(before: np.ndarray, x: np.ndarray, n_chans: int, n_taps: int) -> np.ndarray:
    """Spectra (channel, time) of one block that follows the samples ``before``."""
    h = prototype_filter(n_chans, n_taps).reshape(n_taps, n_chans)
    frames = np.concatenate([before, x]).reshape(-1, n_chans)
    n = len(frames) - n_taps
    y = sum(frames[j: j + n] * h[j] for j in range(n_taps))
    return np.fft.fftshift(np.fft.fft(y, axis=1), axes=1).T


def channelise_strips(strips: DataFrame, n_chans: int, n_taps: int, keys: Sequence[str] = ("stream_id",)) -> DataFrame:
    """Spectra of dense streams stored as one array row per block.

    Only the tail of a block (``n_chans * n_taps`` samples) travels to the next one; filter and
    FFT run on whole blocks inside the task.  ``strips(keys, iter, re[], im[])`` with block
    lengths that are multiples of ``n_chans``; output is one row per (block, channel) with
    arrays over time.
    """
    keys, tail = list(keys), n_chans * n_taps
    tails = strips.select(*keys, (F.col("iter") + 1).alias("iter"), F.slice("re", -tail, tail).alias("tr"),
                          F.slice("im", -tail, tail).alias("ti"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                x = np.asarray(row.re) + 1j * np.asarray(row.im)
                before = np.zeros(tail, complex) if row.tr is None else np.asarray(row.tr) + 1j * np.asarray(row.ti)
                y = block_spectra(before, x, n_chans, n_taps)
                out = pd.DataFrame({"channel": np.arange(n_chans, dtype="int32"), "re": list(y.real), "im": list(y.imag)})
                out.insert(0, "iter", row.iter)
                for k in keys:
                    out.insert(0, k, getattr(row, k))
                yield out[keys + ["iter", "channel", "re", "im"]]

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([strips.schema[k] for k in keys] + [
        strips.schema["iter"], T.StructField("channel", T.IntegerType()), T.StructField("re", arr), T.StructField("im", arr)])
    return strips.join(tails, keys + ["iter"], "left").mapInPandas(run, schema)


def block_metadata(blocks: DataFrame, n_chans: int, n_taps: int) -> DataFrame:
    """Block metadata after channelising (times in microseconds, bandwidths in MHz)."""
    bw = F.col("channel_bandwidth") / n_chans
    return (
        blocks.withColumn("t0_us", F.col("t0_us") - F.round((n_taps - 1) * n_chans * F.col("sampling_time") * 1e6).cast("bigint"))
        .withColumn("nsamp", F.floor(F.col("nsamp") / n_chans)).withColumn("sampling_time", F.col("sampling_time") * n_chans)
        .withColumn("start_center_frequency", F.col("start_center_frequency") - bw * n_chans / 2)
        .withColumn("channel_bandwidth", bw)
    )

"""ADC captures: spectra, levels and tones."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from skysieve.functions import units


def capture_spectra(captures: DataFrame, n_avg: int, bits: int, keys: Sequence[str], samples: str = "samples") -> DataFrame:
    """Averaged amplitude spectrum of each capture in dB of full scale.

    A capture (fixed length) is one array row; it is cut into ``n_avg`` chunks, each
    Hann-windowed and transformed.  One row per (capture, bin).
    """
    keys = list(keys)
    full = 2.0 ** (bits - 1) - 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, x in zip(b.index, b[samples]):
                size = len(x) // n_avg
                chunks = np.asarray(x, float)[: size * n_avg].reshape(n_avg, size)
                spec = np.abs(np.fft.rfft(chunks * np.hanning(size), axis=1))
                level = (2.0 * spec / spec.shape[1]).mean(axis=0)
                out = pd.DataFrame({"bin": np.arange(len(level), dtype="int32"), "amplitude": level})
                for k in keys:
                    out.insert(0, k, b.at[i, k])
                yield out[keys + ["bin", "amplitude"]]

    schema = T.StructType([captures.schema[k] for k in keys] + [
        T.StructField("bin", T.IntegerType()), T.StructField("amplitude", T.DoubleType())])
    spec = captures.select(*keys, samples).mapInPandas(run, schema)
    return spec.withColumn("level", F.when(F.col("amplitude") > 0, 20 * F.log10(F.col("amplitude") / full)))


def adc_levels(samples: DataFrame, keys: Sequence[str], bits: int, value: str = "value") -> DataFrame:
    """RMS, RF power in dBm, dBFS and bits in use of each capture."""
    v = F.col(value).cast("double")
    g = samples.groupBy(*keys).agg(F.avg(v * v).alias("_p"))
    full = 2.0 ** (bits - 1)
    return g.select(*keys, F.sqrt("_p").alias("rms"), units.adc_rf_dbm(F.sqrt("_p"), bits).alias("rf_dbm"),
                    units.to_db(F.col("_p") / (full * full / 2)).alias("dbfs"),
                    F.when(F.col("_p") > 0, F.log2(F.sqrt("_p"))).alias("bits_used"))


def bit_spread(levels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Largest difference in bits in use between antennas."""
    return levels.groupBy(*keys).agg((F.max("bits_used") - F.min("bits_used")).alias("bit_spread"))


def fundamental(spectra: DataFrame, keys: Sequence[str], bin_hz: float) -> DataFrame:
    """Frequency and level of the spectral maximum; the lower bin wins a tie."""
    return spectra.groupBy(*keys).agg(
        F.max_by(F.col("bin") * bin_hz, F.struct(F.col("level"), -F.col("bin"))).alias("frequency"), F.max("level").alias("level"))


def band(spectra: DataFrame, lo_hz: float, hi_hz: float, bin_hz: float) -> DataFrame:
    """Bins of a frequency band, with their frequency."""
    f = F.col("bin") * bin_hz
    return spectra.where((f >= lo_hz) & (f <= hi_hz)).withColumn("frequency", f)


def mean_spectrum(spectra: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Average of dB spectra taken in linear units."""
    return spectra.groupBy(*keys, "bin").agg((10 * F.log10(F.avg(units.from_db("level")))).alias("level"))


def relative_power(spectra: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Level of one bin over time, relative to the first capture of its antenna."""
    first = spectra.groupBy(*keys).agg(F.min_by("level", F.struct(*order)).alias("_first"))
    return spectra.join(first, list(keys)).withColumn("relative", F.col("level") - F.col("_first")).drop("_first")


def resolution(n_samples: int, rate: float, wanted_hz: float) -> tuple[int, float]:
    """Power-of-two averaging whose bin width is nearest the wanted one."""
    options = [2 ** k for k in range(0, int(np.log2(n_samples)))]
    best = min(options, key=lambda a: (abs(rate / (n_samples / a) - wanted_hz), a))
    return best, rate / (n_samples / best)

"""Beamforming, beam power and antenna level metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skysieve.functions import pointing
from skysieve.functions.cplx import cabs2, cmul
from skysieve.functions.units import to_db
from skysieve.operators.sequences import small

MAX_WEIGHT_ROWS = 2_000_000


def weights_for(beams: DataFrame, antennas: DataFrame, on: str, ref_dec: float, lat: float,
                start_mhz: float, bandwidth_mhz: float, n_subs: int = 1) -> DataFrame:
    """Steering weights per (sub-band, beam, antenna).

    ``beams(on, beam_id, ha, ddec)`` and ``antennas(on, ant, east, north, up, gain_re, gain_im)``
    meet on the array they belong to; calibration gains are folded in once.
    """
    az, el = pointing.beam_azimuth_elevation(ref_dec, "ha", "ddec", lat)
    aimed = beams.select(on, "beam_id", az.alias("az"), el.alias("el"))
    aimed = aimed.withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(n_subs - 1))))
    freq = pointing.sub_band_mhz(start_mhz, bandwidth_mhz, "sub", n_subs)
    wre, wim = pointing.phase_weight("el", "az", "east", "north", "up", freq)
    gre, gim = cmul(F.col("w_re"), F.col("w_im"), F.col("gain_re"), F.col("gain_im"))
    return (
        aimed.join(antennas, on)
        .withColumn("w_re", wre).withColumn("w_im", wim)
        .select(on, "sub", "beam_id", "ant", gre.alias("re"), gim.alias("im"))
    )


def disable_antennas(weights: DataFrame, antennas: Sequence[int]) -> DataFrame:
    """Zero weight for the named antennas."""
    off = F.col("ant").isin(list(antennas))
    return weights.withColumn("re", F.when(off, F.lit(0.0)).otherwise(F.col("re"))).withColumn(
        "im", F.when(off, F.lit(0.0)).otherwise(F.col("im")))


def first_antennas(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("ant") < n)


def beamform(voltages: DataFrame, weights: DataFrame, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Weighted sum over antennas per beam, long form.

    Weights may have further keys (array, sub-band, polarisation): where voltages have the
    column too they meet on it, otherwise each of its values gives beams of its own.  The weights
    are a checked-size dimension, the sums combine map-side before the shuffle.
    """
    extra = [c for c in weights.columns if c not in ("ant", "beam_id", "re", "im")]
    w = small(weights.select("ant", "beam_id", *extra, F.col("re").alias("w_re"), F.col("im").alias("w_im")),
              MAX_WEIGHT_ROWS)
    re, im = cmul(F.col("re"), F.col("im"), F.col("w_re"), F.col("w_im"))
    group = [*keys, *[c for c in extra if c not in keys], "beam_id"]
    return voltages.join(w, ["ant", *[c for c in extra if c in voltages.columns]]).groupBy(*group).agg(
        F.sum(re).alias("re"), F.sum(im).alias("im"))


def to_frames(voltages: DataFrame, n_ants: int, keys: Sequence[str] = ("sample",)) -> DataFrame:
    """One row per sample with an array over antennas; missing antennas are zero."""
    sums = []
    for a in range(n_ants):
        hit = F.col("ant") == a
        sums += [F.sum(F.when(hit, F.col(p))).alias(f"{p}{a}") for p in ("re", "im")]
    wide = voltages.groupBy(*keys).agg(*sums)
    return wide.select(*keys, *[
        F.array(*[F.coalesce(F.col(f"{p}{a}"), F.lit(0.0)) for a in range(n_ants)]).alias(p)
        for p in ("re", "im")])


def weight_matrix(weights: DataFrame) -> np.ndarray:
    """Weights as (beam, antenna) matrix; refused beyond a fixed size, or with two weights for one place."""
    rows = weights.select("beam_id", "ant", "re", "im").limit(MAX_WEIGHT_ROWS + 1).toPandas()
    if len(rows) > MAX_WEIGHT_ROWS:
        raise ValueError("weight table too large for a matrix; use beamform()")
    if rows.duplicated(["beam_id", "ant"]).any():
        raise ValueError("several weights for one beam and antenna: select one sub-band and array first")
    out = np.zeros((rows.beam_id.max() + 1, rows.ant.max() + 1), dtype=np.complex128)
    out[rows.beam_id, rows.ant] = rows.re + 1j * rows.im
    return out


def beamform_frames(frames: DataFrame, weights: DataFrame,
                    keys: Sequence[str] = ("sample",)) -> DataFrame:
    """Beamform dense frames: one matrix product per Arrow batch, no shuffle.

    Output rows keep the frame keys and carry arrays over beams.
    """
    matrix = weight_matrix(weights).T
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = np.stack(b["re"].to_numpy()) + 1j * np.stack(b["im"].to_numpy())
                y = x @ matrix[: x.shape[1]]
                out = b[keys].copy()
                out["re"], out["im"] = list(y.real), list(y.imag)
                yield out

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([frames.schema[k] for k in keys] + [
        T.StructField("re", arr), T.StructField("im", arr)])
    return frames.select(*keys, "re", "im").mapInPandas(run, schema)


def beam_slices(frames: DataFrame, weights: DataFrame, keys: Sequence[str] = ("obs_id", "iter")) -> DataFrame:
    """Beams of dense frames as ``(keys, beam_id, first, re[], im[])``: runs of consecutive samples.

    One matrix product per Arrow batch, no shuffle and no row per sample: a run is as long as a
    batch gives it.
    """
    matrix = weight_matrix(weights).T
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values([*keys, "sample"], kind="stable", ignore_index=True)
            x = np.stack(b["re"].to_numpy()) + 1j * np.stack(b["im"].to_numpy())
            y = (x @ matrix[: x.shape[1]]).T
            cuts = (b["sample"].diff() != 1) | (b[keys] != b[keys].shift()).any(axis=1)
            starts = np.flatnonzero(cuts.to_numpy())
            for a, z in zip(starts, [*starts[1:], len(b)]):
                out = pd.DataFrame({"beam_id": np.arange(len(y), dtype="int32"), "first": b["sample"].iloc[a],
                                    "re": list(y[:, a:z].real), "im": list(y[:, a:z].imag)})
                for k in reversed(keys):
                    out.insert(0, k, b[k].iloc[a])
                yield out

    arr = T.ArrayType(T.DoubleType())
    schema = T.StructType([frames.schema[k] for k in keys] + [
        T.StructField("beam_id", T.IntegerType()), T.StructField("first", T.LongType()), T.StructField("re", arr), T.StructField("im", arr)])
    return frames.select(*keys, "sample", "re", "im").mapInPandas(run, schema)


def power(re="re", im="im", floor: float = 1e-14) -> Column:
    """Pixel power with the small offset that keeps logarithms finite."""
    return cabs2(re, im) + F.lit(floor)


def integrated_power(beams: DataFrame, n_samples: int, keys: Sequence[str] = ()) -> DataFrame:
    """Beam power summed over chunks of ``n_samples`` samples."""
    return beams.groupBy(*keys, "beam_id", F.floor(F.col("sample") / n_samples).alias("chunk")).agg(
        F.sum(cabs2("re", "im")).alias("power"))


def calibrated_beam_power(chunks: DataFrame, keys: Sequence[str] = ("beam_id",),
                          head: int = 100, tail: int = 50) -> DataFrame:
    """Noise from the first ``head`` and last ``tail`` chunks, then power above noise in dB.

    A chunk that belongs to both ends counts twice.
    """
    edges = _edge_means(chunks, keys, head, tail)
    return (
        chunks.join(edges, list(keys))
        .withColumn("power_db", to_db(F.col("power") - F.col("noise")))
        .withColumn("noise_db", to_db("noise"))
    )


def _edge_means(chunks: DataFrame, keys: Sequence[str], head: int, tail: int) -> DataFrame:
    """Mean power of the first ``head`` and last ``tail`` chunks.

    Chunk numbers are the order; ends are found by counting from both sides through a
    per-bucket histogram, so no key is ever sorted whole.
    """
    from skysieve.operators.sequences import row_index

    binned = chunks.withColumn("_bucket", F.floor(F.col("chunk") / 1024))
    ranked = row_index(binned, keys, ["chunk"], "_bucket", "_pos")
    totals = chunks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    at_head, at_tail = F.col("_pos") <= head, F.col("_pos") > F.col("_total") - tail
    both = (at_head.cast("int") + at_tail.cast("int"))
    return (
        ranked.join(totals, list(keys)).withColumn("_w", both).where("_w > 0")
        .groupBy(*keys).agg((F.sum(F.col("power") * F.col("_w")) / F.sum("_w")).alias("noise"))
    )


def antenna_rms(voltages: DataFrame, keys: Sequence[str] = ("ant",), normalise: bool = True) -> DataFrame:
    """RMS level per antenna; without ``normalise`` the root of the summed power."""
    agg = F.avg if normalise else F.sum
    return voltages.groupBy(*keys).agg(F.sqrt(agg(cabs2("re", "im"))).alias("rms"))


def every_kth(df: DataFrame, column: str, k: int) -> DataFrame:
    """Every k-th block: the sampling of the metrics feed."""
    return df.where(F.pmod(F.col(column), F.lit(k)) == 0)

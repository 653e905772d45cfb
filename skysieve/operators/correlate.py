"""Correlation of antenna pairs and work on visibilities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skysieve.functions.cplx import cabs, cmul_conj
from skysieve.operators.sequences import small


_HELD_BYTES = 256 << 20  # window sums of a task before they are passed on
_ROWS = 100_000  # visibilities made at once


def baseline_index(ant1, ant2, n_ants: int) -> Column:
    """Position of the pair (ant1 < ant2) in row-major upper-triangle order."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (ant1, ant2))
    return (a * n_ants - F.floor(a * (a + 1) / 2) + (b - a - 1)).cast("int")


def correlate_blocks(frames: DataFrame, integration: int, n_ants: int, n_pols: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """Hermitian sums ``(keys, t_idx, block)`` of x conj(x)^T over windows of ``integration`` samples.

    Frames have arrays over inputs, polarisations innermost (``ant * n_pols + pol``).  A task adds
    up one matrix per window over all its batches; what is shuffled and added again is the packed
    upper triangle, diagonal included, as 128-bit complex numbers.
    """
    keys = list(keys)
    upper = np.triu_indices(n_ants * n_pols)
    schema = T.StructType([frames.schema[k] for k in keys] + [T.StructField("t_idx", T.LongType()), T.StructField("block", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["re"].to_numpy()) + 1j * np.stack(b["im"].to_numpy())
            group = b.groupby(keys + ["t_idx"], sort=False, dropna=False)
            order = np.argsort(group.ngroup().to_numpy(), kind="stable")
            edges = [0, *np.cumsum(group.size().to_numpy())]
            for key, a, z in zip(group.size().index, edges, edges[1:]):
                key = key if isinstance(key, tuple) else (key,)
                part = x[order[a:z]]
                held[key] = held.get(key, 0) + (part.T @ part.conj())[upper]
            if sum(v.nbytes for v in held.values()) > _HELD_BYTES:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict[tuple, np.ndarray]) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=keys + ["t_idx"])
        out["block"] = [v.astype("<c16").tobytes() for v in held.values()]
        return out

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, "<c16") for v in pdf["block"])
        return pd.DataFrame([(*key, total.tobytes())], columns=keys + ["t_idx", "block"])

    df = frames.withColumn("t_idx", F.floor(F.col("sample") / integration))
    parts = df.select(*keys, "t_idx", "re", "im").mapInPandas(run, schema)
    return parts.groupBy(*keys, "t_idx").applyInPandas(add, schema)


def visibilities(blocks: DataFrame, n_ants: int, n_pols: int = 1, autos: bool = False) -> DataFrame:
    """Rows of packed blocks: a row for each pair of antennas and, where there are several, of polarisations."""
    i, j = np.triu_indices(n_ants * n_pols)
    a1, a2, p1, p2 = i // n_pols, j // n_pols, i % n_pols, j % n_pols
    kept = np.flatnonzero((a1 < a2) | autos)
    keys = [c for c in blocks.columns if c != "block"]
    schema = T.StructType([blocks.schema[k] for k in keys] + [T.StructField(n, T.IntegerType()) for n in ("ant1", "ant2", "pol1", "pol2")]
                          + [T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), _ROWS // len(kept) + 1):
                part = b.iloc[start: start + _ROWS // len(kept) + 1]
                v = np.stack([np.frombuffer(x, "<c16")[kept] for x in part["block"]])
                out = {k: np.repeat(part[k].to_numpy(), len(kept)) for k in keys}
                out |= {n: np.tile(x[kept].astype("int32"), len(part)) for n, x in (("ant1", a1), ("ant2", a2), ("pol1", p1), ("pol2", p2))}
                yield pd.DataFrame({**out, "re": v.real.ravel(), "im": v.imag.ravel()})

    out = blocks.mapInPandas(run, schema).withColumn("baseline", baseline_index("ant1", "ant2", n_ants))
    return out if n_pols > 1 else out.drop("pol1", "pol2")


def correlate_frames(frames: DataFrame, integration: int, n_ants: int, keys: Sequence[str] = (), n_pols: int = 1) -> DataFrame:
    """Sum of x_a conj(x_b) per window and pair, for several polarisations per pair of them."""
    return visibilities(correlate_blocks(frames, integration, n_ants, n_pols, keys), n_ants, n_pols)


def channel_range(spectra: DataFrame, start: int, end: int) -> DataFrame:
    """Channels start..end-1, renumbered from zero."""
    return spectra.where((F.col("channel") >= start) & (F.col("channel") < end)).withColumn(
        "channel", F.col("channel") - start)


def _gain(gains: DataFrame, side: str, keys: Sequence[str]) -> DataFrame:
    return small(gains.select(*keys, F.col("ant").alias(side), F.col("re").alias(f"{side}_re"),
                              F.col("im").alias(f"{side}_im")))


def apply_gains(visibilities: DataFrame, gains: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """V c1 conj(c2) for the two antennas of each pair; for one snapshot or a whole transit."""
    keys = list(keys)
    df = visibilities.join(_gain(gains, "ant1", keys), keys + ["ant1"]).join(
        _gain(gains, "ant2", keys), keys + ["ant2"])
    fre, fim = cmul_conj("ant1_re", "ant1_im", "ant2_re", "ant2_im")
    re = F.col("re") * fre - F.col("im") * fim
    im = F.col("re") * fim + F.col("im") * fre
    return df.withColumn("_re", re).withColumn("im", im).withColumn("re", F.col("_re")).drop(
        "_re", "ant1_re", "ant1_im", "ant2_re", "ant2_im")


def trim_zero_padding(visibilities: DataFrame, keys: Sequence[str] = ("baseline",), order: str = "t_idx",
                      leading: bool = False) -> DataFrame:
    """Drop the samples after the last (and before the first) one with any signal."""
    live = (F.col("re") != 0) | (F.col("im") != 0)
    keys = list(keys)
    ends = visibilities.groupBy(*keys).agg(
        F.min(F.when(live, F.col(order))).alias("_lo"), F.max(F.when(live, F.col(order))).alias("_hi"))
    joined = visibilities.join(ends, keys)
    keep = F.col(order) <= F.col("_hi")
    if leading:
        keep = keep & (F.col(order) >= F.col("_lo"))
    return joined.where(keep).drop("_lo", "_hi")


def transit_peaks(visibilities: DataFrame, keys: Sequence[str] = ("baseline",),
                  order: str = "t_idx") -> DataFrame:
    """Per pair: position (after trimming) of the strongest amplitude that is not an outlier.

    Amplitudes beyond two standard deviations are replaced by the mean before the maximum
    is taken; the first maximum wins.
    """
    keys = list(keys)
    amp = trim_zero_padding(visibilities, keys, order, leading=True).select(
        *keys, order, cabs("re", "im").alias("_a"))
    stats = amp.groupBy(*keys).agg(
        F.avg("_a").alias("_m"), F.stddev_pop("_a").alias("_s"), F.min(order).alias("_t0"))
    clamped = F.when(F.abs(F.col("_a") - F.col("_m")) < 2 * F.col("_s"), F.col("_a")).otherwise(F.col("_m"))
    return (
        amp.join(stats, keys).withColumn("_c", clamped)
        .groupBy(*keys).agg(F.max_by(F.col(order) - F.col("_t0"),
                                     F.struct(F.col("_c"), -F.col(order))).alias("peak"))
    )


def transit_peak(visibilities: DataFrame, group: Sequence[str] = (),
                 pair: str = "baseline") -> DataFrame:
    """Mean peak position over the pairs, as whole sample."""
    peaks = transit_peaks(visibilities, [*group, pair])
    return peaks.groupBy(*group).agg(F.floor(F.avg("peak")).cast("bigint").alias("vis_peak"))


def transit_sample(start_s, transit_s, integration_s: float) -> Column:
    """Sample index of a transit; negative differences wrap by one day."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start_s, transit_s))
    return F.floor(F.pmod(b - a, F.lit(86400)) / F.lit(integration_s)).cast("bigint")

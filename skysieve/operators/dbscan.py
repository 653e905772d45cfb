"""Density clustering of pixels on the (channel, time) lattice."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from skysieve.functions import regression as rg
from skysieve.operators.graph import connected_components, local_components
from skysieve.session import cut, spread

IMAGE = ("iter", "beam_id")


def dbscan(pixels: DataFrame, n_channels: int, n_times: int, eps: int = 5, min_points: int = 5,
           keys: Sequence[str] = IMAGE, tile: int = 256) -> DataFrame:
    """Clusters of pixels; noise is left out.

    A core pixel has ``min_points`` pixels (itself included) within ``eps``; core pixels
    within ``eps`` of each other belong together; a border pixel joins the lowest cluster it
    touches.  ``cluster_id`` is the lowest ``channel * n_times + time`` of the core pixels.

    Images are cut into channel tiles with a halo of twice ``eps``.  A tile labels its part;
    core pixels seen by two tiles tie the parts together, and only those ties enter the
    distributed component search.
    """
    keys = list(keys)
    halo, last = 2 * eps, (n_channels - 1) // tile
    c = F.col("channel_sample")
    copies = pixels.select(*keys, "channel_sample", "time_idx", "power").withColumn(
        "_tile", F.explode(F.sequence(
            F.greatest(F.lit(0), F.floor((c - halo) / tile)).cast("int"),
            F.least(F.lit(last), F.floor((c + halo) / tile)).cast("int"))))
    offsets = [(a, b) for a in range(eps + 1) for b in range(-eps, eps + 1)
               if (a, b) > (0, 0) and a * a + b * b <= eps * eps]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = key[-1] * tile
        ch, t = pdf["channel_sample"].to_numpy(), pdf["time_idx"].to_numpy()
        order = np.lexsort((t, ch))
        ch, t, power = ch[order], t[order], pdf["power"].to_numpy()[order]
        base = ch.min()
        grid = np.full((ch.max() - base + 1 + eps, n_times + 2 * eps), -1)
        grid[ch - base, t + eps] = np.arange(len(ch))
        pairs = []
        for a, b in offsets:
            other = grid[ch - base + a, t + eps + b]
            hit = np.flatnonzero(other >= 0)
            pairs.append(np.stack([hit, other[hit]]))
        u, v = np.concatenate(pairs, axis=1)
        degree = 1 + np.bincount(u, minlength=len(ch)) + np.bincount(v, minlength=len(ch))
        # pixels within eps of the own rows have all their neighbours here
        sure = (ch >= own - eps) & (ch < own + tile + eps)
        core = sure & (degree >= min_points)
        cc = core[u] & core[v]
        label = local_components(len(ch), u[cc], v[cc])
        rep = ch[label].astype("int64") * n_times + t[label]
        mine = (ch >= own) & (ch < own + tile)
        touch = np.concatenate([np.stack([u, v]), np.stack([v, u])], axis=1)
        touch = touch[:, (mine & ~core)[touch[0]] & core[touch[1]]]
        rows = pd.concat([
            pd.DataFrame({"p": np.flatnonzero(core), "rep": rep[core], "core": True}),
            pd.DataFrame({"p": touch[0], "rep": rep[touch[1]], "core": False}).drop_duplicates(),
        ])
        p = rows["p"].to_numpy()
        out = pd.DataFrame({"channel_sample": ch[p], "time_idx": t[p], "power": power[p],
                            "rep": rows["rep"].to_numpy(), "core": rows["core"].to_numpy(), "own": mine[p]})
        for name, value in zip(keys, key):
            out.insert(0, name, value)
        return out[keys + ["channel_sample", "time_idx", "power", "rep", "core", "own"]]

    schema = T.StructType([pixels.schema[k] for k in keys] + [
        T.StructField("channel_sample", T.IntegerType()), T.StructField("time_idx", T.IntegerType()),
        T.StructField("power", T.DoubleType()), T.StructField("rep", T.LongType()),
        T.StructField("core", T.BooleanType()), T.StructField("own", T.BooleanType())])
    parts = spread(copies, *keys, "_tile").groupBy(*keys, "_tile").applyInPandas(run, schema)
    cell = [*keys, "channel_sample", "time_idx"]
    if last == 0:
        return parts.where("own").groupBy(*cell).agg(
            F.first("power").alias("power"), F.min("rep").alias("cluster_id"), F.first("core").alias("core"))

    parts = cut(parts)
    ties = (
        parts.where("core").groupBy(*cell).agg(F.min("rep").alias("src"), F.max("rep").alias("dst"))
        .where("src <> dst").select(*keys, "src", "dst").distinct()
    )
    comp = connected_components(ties, keys).withColumnRenamed("node", "rep")
    return (
        parts.where("own").join(comp, keys + ["rep"], "left")
        .groupBy(*cell).agg(F.first("power").alias("power"),
                            F.min(F.coalesce("component", "rep")).alias("cluster_id"),
                            F.first("core").alias("core"))
    )


def cluster_fits(clusters: DataFrame, keys: Sequence[str], x: str = "time_idx", y: str = "channel_sample") -> DataFrame:
    """Size and straight-line fit of each cluster."""
    sums = clusters.groupBy(*keys, "cluster_id").agg(*rg.sum_aggs(x, y))
    f = rg.fit_of()
    return sums.select(*keys, "cluster_id", "n", f["slope"].alias("slope"), f["intercept"].alias("intercept"),
                       f["r"].alias("r"))


def valid_clusters(fits: DataFrame, channel_hz: float, sampling_time: float, linearity: float = 0.99,
                   gradient: tuple[float, float] | None = (-57.0, -291.47), min_size: int = 3) -> DataFrame:
    """Clusters with enough points, a linear shape and a Doppler rate inside the window."""
    rate = F.col("slope") * (channel_hz / sampling_time)
    ok = (F.col("n") >= min_size) & (F.abs("r") >= linearity)
    if gradient is not None:
        ok = ok & (rate <= gradient[0]) & (rate >= gradient[1])
    return fits.where(ok).withColumn("rate", rate)


def loosely_valid(fits: DataFrame, r_max: float = -0.9, p_max: float = 0.05) -> DataFrame:
    """The analysis gate: p < 0.05 and r below the limit."""
    return fits.where((F.col("r") < r_max) & rg.p_value_gate("n", "r", p_max, abs(r_max)))


def dbscan_3d_pairs(pixels: DataFrame, eps: float, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Neighbour pairs with power as third coordinate (analysis variant)."""
    from skysieve.operators.graph import neighbour_pairs

    ident = F.col("channel_sample").cast("bigint") * 100000 + F.col("time_idx")
    return neighbour_pairs(pixels.withColumn("ident", ident), keys,
                           ["channel_sample", "time_idx", "power"], eps, "ident")

"""Straight-line detector by voting, and the line rasteriser."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skysieve.session import numbers, spread, whole_groups

IMAGE = ("iter", "beam_id")


def votes(pixels: DataFrame, n_theta: int = 180, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Pixels per (angle, distance) cell.

    An image's cells are nearly as many as its pixels times the angles, so only pixels are dealt, and
    images are counted one by one inside the tasks.  An image's pixels are counted by place first.
    """
    keys = list(keys)
    angles = [-math.pi / 2 + k * (math.pi / (n_theta - 1)) for k in range(n_theta)]
    cos, sin = np.array([math.cos(a) for a in angles]), np.array([math.sin(a) for a in angles])
    def count(t: np.ndarray, c: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        step = max(1, min(n_theta, 1_000_000 // len(t)))  # angles counted together
        for k in range(0, n_theta, step):
            rho = np.floor(t[None, :] * cos[k:k + step, None] + c[None, :] * sin[k:k + step, None] + 0.5).astype(np.int64)
            low = rho.min()
            width = rho.max() - low + 1
            cell = (rho - low + np.arange(len(rho))[:, None] * width).ravel()
            found = np.bincount(cell, np.tile(n, len(rho)))
            at = np.flatnonzero(found)
            yield k + at // width, at % width + low, found[at]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t, c = (numbers(table, x, pa.float64()) for x in ("time_idx", "channel_sample"))
        n, placed = numbers(table, "_n", pa.int64()), ~(np.isnan(t) | np.isnan(c))
        image, parts = [], []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            on = a + np.flatnonzero(placed[a:b])
            found = list(count(t[on], c[on], n[on])) if len(on) else []
            if len(on) < b - a:  # pixels without a place have no distance
                nowhere = int(n[a:b][~placed[a:b]].sum())
                found.append((np.arange(n_theta), np.full(n_theta, np.nan), np.full(n_theta, nowhere)))
            image += [np.full(len(x[0]), a) for x in found]
            parts += found
        theta, rho, votes_of = (np.concatenate(x) for x in zip(*parts))
        none = np.isnan(rho)
        return table.select(keys).take(pa.array(np.concatenate(image))).append_column("theta", pa.array(theta, pa.int32())).append_column(
            "rho", pa.array(np.where(none, 0, rho).astype(np.int32), mask=none)).append_column("votes", pa.array(votes_of.astype(np.int64)))

    schema = T.StructType([pixels.schema[k] for k in keys] + [
        T.StructField("theta", T.IntegerType()), T.StructField("rho", T.IntegerType()), T.StructField("votes", T.LongType())])
    places = pixels.where("power > 0").groupBy(*keys, "time_idx", "channel_sample").agg(F.count("*").alias("_n"))
    return whole_groups(places, keys, run, schema, rows=5_000)


def segments(pixels: DataFrame, min_votes: int = 10, min_length: int = 5, max_gap: int = 3,
             n_theta: int = 180, keys: Sequence[str] = IMAGE, bands: int = 4) -> DataFrame:
    """Line segments: cells with enough votes, cut where pixels along the line leave a gap.

    A group is an image and every ``bands``-th angle; it holds the image's pixels and goes through its
    angles one by one, so pixels are dealt ``bands`` times instead of once for each angle, and only
    those on a cell with enough votes are put in order.
    """
    keys = list(keys)
    kinds = {c: pixels.schema[c].dataType.simpleString() for c in (*keys, "time_idx", "channel_sample")}
    out = [*keys, "theta", "rho", "segment", "n", "t0", "c0", "t1", "c1"]

    def run(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        t, c = pdf["time_idx"].to_numpy(np.int64), pdf["channel_sample"].to_numpy(np.int64)
        by_place = np.lexsort((t, c))  # once: the order of pixels at the same position of a line
        t, c, found = t[by_place], c[by_place], []
        for k in range(int(group[-1]), n_theta, bands):
            a = -math.pi / 2 + k * (math.pi / (n_theta - 1))
            rho = np.floor(t * math.cos(a) + c * math.sin(a) + 0.5).astype(np.int64)
            cell = rho - rho.min()
            on = np.flatnonzero(np.bincount(cell)[cell] >= min_votes)
            if not len(on):
                continue
            pos = np.floor(c[on] * math.cos(a) - t[on] * math.sin(a) + 0.5).astype(np.int64)
            low = pos.min()
            order = np.argsort(cell[on] * (pos.max() - low + 1) + (pos - low), kind="stable")
            on, pos = on[order], pos[order]
            line = rho[on]
            new_line = np.diff(line, prepend=line[0] - 1) != 0
            gap = (np.diff(pos, prepend=pos[0]) > max_gap + 1) & ~new_line
            first = np.flatnonzero(new_line | gap)
            last = np.append(first[1:], len(on)) - 1
            breaks = np.cumsum(gap)
            segment = breaks[first] - np.maximum.accumulate(np.where(new_line, breaks, 0))[first]
            long_ones = pos[last] - pos[first] >= min_length
            f, z = first[long_ones], last[long_ones]
            found.append(np.stack([np.full(len(f), k), line[f], segment[long_ones], z - f + 1, t[on[f]], c[on[f]], t[on[z]], c[on[z]]], 1))
        rows = np.concatenate(found) if found else np.zeros((0, 8), np.int64)
        return pd.DataFrame({**dict(zip(keys, group)), **dict(zip(out[len(keys):], rows.T))}, columns=out)

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + (
        f", theta int, rho int, segment long, n long, t0 {kinds['time_idx']}, c0 {kinds['channel_sample']}, "
        f"t1 {kinds['time_idx']}, c1 {kinds['channel_sample']}")
    dealt = pixels.where("power > 0").select(*keys, "time_idx", "channel_sample", F.explode(
        F.sequence(F.lit(0), F.lit(bands - 1))).alias("_band"))
    return spread(dealt, *keys, "_band").groupBy(*keys, "_band").applyInPandas(run, schema)


def rasterise(lines: DataFrame, x1="t0", y1="c0", x2="t1", y2="c1") -> DataFrame:
    """One row per cell on the line between two points, stepping along the longer axis."""
    dx, dy = F.col(x2) - F.col(x1), F.col(y2) - F.col(y1)
    n = F.greatest(F.abs(dx), F.abs(dy))
    steps = lines.withColumn("_n", n).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n").cast("int"))))
    share = F.when(F.col("_n") > 0, F.col("_k") / F.col("_n")).otherwise(0.0)
    return (
        steps.withColumn("time_idx", F.floor(F.col(x1) + share * (F.col(x2) - F.col(x1)) + 0.5).cast("int"))
        .withColumn("channel_sample", F.floor(F.col(y1) + share * (F.col(y2) - F.col(y1)) + 0.5).cast("int"))
        .drop("_n", "_k")
    )

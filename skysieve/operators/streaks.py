"""Streak detection: leaf clusters, merging of leaves, robust line validation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skysieve.functions import regression as rg
from skysieve.operators.graph import connected_components, local_components, neighbour_pairs
from skysieve.operators.partition import kd_partition, leaf_gate
from skysieve.session import cut, numbers, whole_groups

IMAGE = ("iter", "beam_id")
# Time and frequency resolution of the stream, steepest Doppler rate, its margin.
SAMPLING_TIME = 0.0958698057142857  # seconds
CHANNEL_HZ = 10.43081283569336
MIN_SLOPE = 1.1 * -291 * SAMPLING_TIME / CHANNEL_HZ  # channels per sample


def link_offsets(reach: float = 4.0, min_slope: float = MIN_SLOPE) -> list[tuple[int, int]]:
    """Lattice steps (channel, time) that link two pixels of a falling streak.

    Neighbours in time on one channel link; otherwise the channel must fall with time, no
    steeper than ``min_slope`` channels per sample, within ``reach``.
    """
    r = int(reach)
    steps = [(0, 1)]
    for dt in range(1, r + 1):
        steps += [(-dc, dt) for dc in range(1, r + 1)
                  if dc * dc + dt * dt <= reach * reach and -dc / dt >= min_slope]
    return steps


def _linked(group: np.ndarray, ch: np.ndarray, t: np.ndarray, leaf: np.ndarray, steps: Sequence[tuple[int, int]],
            every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pixels and of those a step away in the same leaf of a group.

    A step leads to all pixels in its cell, or to the last one without ``every``.
    """
    pad = max(abs(x) for s in steps for x in s)
    width, height = int(np.ptp(t)) + 1 + 2 * pad, int(np.ptp(ch)) + 1 + 2 * pad
    code = (group * height + (ch - ch.min() + pad)) * width + (t - t.min() + pad)
    order = np.argsort(code, kind="stable")
    code = code[order]
    u, v = [], []
    for dc, dt in steps:
        want = code + dc * width + dt
        end = np.searchsorted(code, want, "right")
        hit = np.flatnonzero(code[np.maximum(end - 1, 0)] == want)
        n = end[hit] - np.searchsorted(code, want[hit]) if every else np.ones(len(hit), np.int64)
        back = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        a, b = order[np.repeat(hit, n)], order[np.repeat(end[hit], n) - 1 - back]
        same = leaf[a] == leaf[b]
        u.append(a[same])
        v.append(b[same])
    return np.concatenate(u), np.concatenate(v)


def leaf_edges(leaves: DataFrame, keys: Sequence[str] = IMAGE, reach: float = 4.0,
               min_slope: float = MIN_SLOPE) -> DataFrame:
    """Linked pixel pairs inside each leaf.

    Every pixel looks up the few lattice cells it may link to among the pixels of its partition
    node, so no leaf is joined with itself as a whole and only pixels are shuffled.
    """
    keys = [*keys, "node"]
    steps = link_offsets(reach, min_slope)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ch, t, leaf = (numbers(table, x, pa.int64()) for x in ("channel_sample", "time_idx", "leaf"))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ch))))
        u, v = _linked(group, ch, t, leaf, steps, every=True)
        out = table.select([*keys, "leaf"]).take(pa.array(u))
        for name, x in (("c2", ch[v]), ("t2", t[v]), ("c1", ch[u]), ("t1", t[u])):
            out = out.append_column(name, pa.array(x.astype(np.int32)))
        return out

    known = leaves.select(*keys, "leaf", "channel_sample", "time_idx").dropna()
    schema = T.StructType([known.schema[k] for k in (*keys, "leaf")] + [T.StructField(x, T.IntegerType()) for x in ("c2", "t2", "c1", "t1")])
    return whole_groups(known, keys, run, schema, rows=20_000)


def leaf_components(leaves: DataFrame, n_times: int, keys: Sequence[str] = IMAGE, reach: float = 4.0,
                    min_slope: float = MIN_SLOPE) -> DataFrame:
    """Component of each pixel among the linked pixels of its leaf (``comp``).

    Works on whole partition nodes, which the partitioner keeps below its task limit.
    """
    keys = list(keys)
    steps = link_offsets(reach, min_slope)
    fields = [*leaves.schema.fields, T.StructField("comp", T.LongType())]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        ch, t, leaf = (numbers(table, x, pa.int64()) for x in ("channel_sample", "time_idx", "leaf"))
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ch))))
        label = local_components(len(ch), *_linked(group, ch, t, leaf, steps, every=False))
        low = np.full(len(ch), np.iinfo(np.int64).max)
        np.minimum.at(low, label, ch * n_times + t)
        return table.append_column("comp", pa.array(low[label]))

    return whole_groups(leaves, [*keys, "node"], run, T.StructType(fields))


def leaf_clusters(components: DataFrame, keys: Sequence[str] = IMAGE, min_length: int = 5,
                  max_missing: float = 0.5, min_ratio: float = -0.15) -> DataFrame:
    """Components that look like a piece of a falling line, one row each.

    Carries the power-weighted centroid, the slope (null when unknown) and the leaf box.
    """
    ident = [*keys, "node", "leaf", "comp"]
    c, t, p = F.col("channel_sample"), F.col("time_idx"), F.col("power")
    g = components.groupBy(*ident).agg(
        F.count("*").alias("n"), F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.size(F.collect_set(t)).alias("_td"),
        F.min(c).alias("_c0"), F.max(c).alias("_c1"), F.size(F.collect_set(c)).alias("_cd"),
        F.var_samp(t).alias("_vt"), F.var_samp(c).alias("_vc"), F.covar_samp(t, c).alias("_cov"),
        (F.sum(t * p) / F.sum(p)).alias("t_mean"), (F.sum(c * p) / F.sum(p)).alias("c_mean"),
        F.first("x1").alias("x1"), F.first("x2").alias("x2"), F.first("y1").alias("y1"), F.first("y2").alias("y2"))
    g = g.where(F.col("n") >= min_length)
    miss_t = rg.missing_score_closed("_t0", "_t1", "_td", "n")
    miss_c = rg.missing_score_closed("_c0", "_c1", "_cd", "n")
    g = g.withColumn("ratio", rg.inertia_ratio("_vt", "_vc", "_cov", "n", "_cd")).where(
        ~((miss_t > max_missing) & (miss_c > max_missing)))
    g = g.where(F.col("ratio").isNull() | ((F.col("ratio") <= 0) & (F.col("ratio") >= min_ratio)))
    slopes = leaf_slopes(components, ident)
    out = g.join(slopes, ident, "left")
    return out.withColumn("slope", F.when(F.col("ratio").isNotNull(), F.col("_slope"))).select(
        *ident, "n", "ratio", "slope", "t_mean", "c_mean", "x1", "x2", "y1", "y2")


def leaf_slopes(points: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Samples per channel after keeping one pixel per time (lowest channel), then one per
    channel (earliest time)."""
    once = points.groupBy(*ident, "time_idx").agg(F.min("channel_sample").alias("channel_sample"))
    once = once.groupBy(*ident, "channel_sample").agg(F.min("time_idx").alias("time_idx"))
    return once.groupBy(*ident).agg(
        F.when(F.count("*") > 1, F.var_samp("time_idx") / (F.covar_samp("time_idx", "channel_sample") + 1e-9)).alias("_slope"))


def merge_radius(clusters: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """1.5 times the median diagonal of the leaf boxes of an image."""
    dx, dy = F.col("x1") - F.col("x2"), F.col("y1") - F.col("y2")
    return clusters.groupBy(*keys).agg((1.5 * F.median(F.sqrt(dx * dx + dy * dy))).alias("eps"))


def merge_edges(clusters: DataFrame, keys: Sequence[str] = IMAGE, min_slope: float = MIN_SLOPE,
                spread: float = 0.3) -> DataFrame:
    """Leaf clusters of an image that continue each other.

    The line between the centroids must fall within the slope limits and agree with both leaf
    slopes (or one of them is unknown); the distance limit is the merge radius.
    """
    keys = list(keys)
    pts = with_cluster_id(clusters, keys).join(merge_radius(clusters, keys), keys)
    pairs = neighbour_pairs(pts, keys, ["t_mean", "c_mean"], F.col("eps"), "cid", ["slope"])
    v0 = (F.col("a_t_mean") - F.col("b_t_mean") + 1e-6) / (F.col("a_c_mean") - F.col("b_c_mean") + 1e-6)
    cv = rg.cv3(v0, F.col("a_slope"), F.col("b_slope"))
    return pairs.where((v0 <= 0) & (v0 >= min_slope)).where(
        F.col("a_slope").isNull() | F.col("b_slope").isNull() | (cv <= spread)).select(
        *keys, F.col("a_cid").alias("src"), F.col("b_cid").alias("dst"), "distance")


def with_cluster_id(clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A number per leaf cluster that is unique within its image."""
    return clusters.withColumn("cid", F.xxhash64("node", "leaf", "comp"))


def merged_groups(clusters: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Groups of at least two leaf clusters; a lone cluster of an image is kept as group 0."""
    keys = list(keys)
    c = with_cluster_id(clusters, keys)
    comp = connected_components(merge_edges(clusters, keys), keys).withColumnRenamed("node", "cid").withColumnRenamed(
        "component", "group_id")
    total = c.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (
        c.join(comp, keys + ["cid"], "left").join(total, keys)
        .withColumn("group_id", F.when(F.col("_n") == 1, F.lit(0).cast("bigint")).otherwise(F.col("group_id")))
        .where("group_id IS NOT NULL").drop("_n", "cid")
    )


def robust_lines(points: DataFrame, ident: Sequence[str], trials: int = 10, residual: float = 2.0) -> DataFrame:
    """Mark the pixels on the best of ``trials`` two-point lines time ~ channel (``inlier``).

    Trial points are the pixels with the lowest and the highest hash of the trial, two different
    ones wherever there are two, so the draw does not depend on row order or partitioning; most
    inliers wins, then the smaller squared error, then the first trial.  Points are spread over
    the draws and lines inside the task that combines them; what is shuffled is one row per
    (group, draw).  A group whose trials all draw one channel keeps its pixels, none an inlier.
    """
    ident = list(ident)
    pixel = F.struct(F.xxhash64("_k", "channel_sample", "time_idx").alias("h"), F.col("channel_sample").alias("c"), F.col("time_idx").alias("t"))
    drawn = points.select(*ident, "channel_sample", "time_idx", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("_k"))
    pairs = drawn.groupBy(*ident, "_k").agg(F.min(pixel).alias("_a"), F.max(pixel).alias("_z")).select(
        *ident, "_k", *[F.col(f"{side}.{v}").cast("double").alias(f"_{v}{i}") for i, side in enumerate(("_a", "_z")) for v in "ct"])
    lines = pairs.withColumn("_lm", F.try_divide(F.col("_t1") - F.col("_t0"), F.col("_c1") - F.col("_c0"))).select(
        *ident, "_k", "_lm", (F.col("_t0") - F.col("_lm") * F.col("_c0")).alias("_lb"))
    miss = F.abs(F.col("time_idx") - (F.col("_lm") * F.col("channel_sample") + F.col("_lb")))
    scored = points.select(*ident, "channel_sample", "time_idx").join(lines.where("_lm IS NOT NULL"), ident).withColumn(
        "_d", miss).where(F.col("_d") <= residual).groupBy(*ident, "_k", "_lm", "_lb").agg(
        F.count("*").alias("_n"), F.sum(F.col("_d") * F.col("_d")).alias("_e"))
    best = scored.groupBy(*ident).agg(F.max_by(F.struct("_lm", "_lb"), F.struct(
        F.col("_n"), -F.col("_e"), -F.col("_k"))).alias("_l")).select(*ident, "_l.*")
    return points.join(best, ident, "left").withColumn("inlier", F.coalesce(miss <= residual, F.lit(False))).drop("_lm", "_lb")


def streak_quality(points: DataFrame, ident: Sequence[str]) -> DataFrame:
    """Scores of point groups used by the validity rules."""
    c, t = F.col("channel_sample"), F.col("time_idx")
    s = points.groupBy(*ident).agg(
        *rg.sum_aggs(t, c), F.min(t).alias("_t0"), F.max(t).alias("_t1"), F.size(F.collect_set(t)).alias("_td"),
        F.min(c).alias("_c0"), F.max(c).alias("_c1"), F.size(F.collect_set(c)).alias("_cd"))
    f = rg.fit_of()
    return s.select(*ident, "n", f["r"].alias("r"), f["slope"].alias("slope"),
                    rg.missing_score_closed("_t0", "_t1", "_td", "n").alias("t_missing"),
                    rg.missing_score_closed("_c0", "_c1", "_cd", "n").alias("c_missing"))


def valid_streaks(quality: DataFrame, r_max: float = -0.99, p_max: float = 0.01, max_missing: float = 0.5) -> DataFrame:
    return quality.where(
        ~((F.col("t_missing") > max_missing) & (F.col("c_missing") > max_missing))
        & (F.col("r") <= r_max) & rg.p_value_gate("n", "r", p_max, abs(r_max)))


def validated_streaks(points: DataFrame, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Robust line per group; the pixels left over may form one further streak (label -g)."""
    ident = [*keys, "group_id"]
    first = cut(robust_lines(points, ident))
    good = valid_streaks(streak_quality(first.where("inlier"), ident)).select(*ident)
    one = first.where("inlier").join(good, ident).withColumn("streak", F.col("group_id"))
    rest = cut(first.where("NOT inlier").join(good, ident).drop("inlier"))
    enough = streak_quality(rest, ident).where((F.col("n") > 3) & (F.col("t_missing") < 2)).select(*ident)
    second = cut(robust_lines(rest.join(enough, ident), ident).where("inlier"))
    ok2 = valid_streaks(streak_quality(second, ident)).select(*ident)
    two = second.join(ok2, ident).withColumn("streak", -F.col("group_id"))
    return one.unionByName(two).drop("inlier")


def detect_streaks(pixels: DataFrame, beam_noise: DataFrame, n_channels: int, n_times: int,
                   keys: Sequence[str] = IMAGE, leaf: int = 40) -> DataFrame:
    """The whole detector over all images at once: pixels of every valid streak."""
    keys = list(keys)
    leaves = kd_partition(pixels.where("power > 0"), n_channels, n_times, leaf, keys)
    comps = cut(leaf_components(leaf_gate(leaves, beam_noise, keys), n_times, keys))
    groups = merged_groups(cut(leaf_clusters(comps, keys)), keys).select(*keys, "node", "leaf", "comp", "group_id")
    points = comps.join(groups, [*keys, "node", "leaf", "comp"]).select(
        *keys, "group_id", "channel_sample", "time_idx", "power")
    return validated_streaks(points, keys)

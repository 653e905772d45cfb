"""Detections, tracks and their association."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skysieve.functions import regression as rg, units
from skysieve.operators.graph import label_nodes
from skysieve.operators.sequences import previous, row_index, running

# Default Doppler-rate window in Hz/s, shallow end first.
GRADIENT = (-57.0, -291.47)


def to_detections(pixels: DataFrame, beam_noise: DataFrame, blocks: DataFrame, start_mhz: float, channel_mhz: float,
                  sampling_time: float, block_len: int = 160, obs: Sequence[str] = ()) -> DataFrame:
    """Cluster pixels in physical units: time, frequency, SNR and global sample number.

    ``beam_noise(obs, iter, beam_id, beam_noise)``, ``blocks(obs, iter, t0_us)``.
    """
    beam, block = [*obs, "iter", "beam_id"], [*obs, "iter"]
    j = pixels.join(beam_noise.select(*beam, "beam_noise"), beam).join(blocks.select(*block, "t0_us"), block)
    return (
        j.withColumn("time_sample", units.global_sample("iter", "time_idx", block_len))
        .withColumn("time_us", units.sample_micros("t0_us", "time_idx", sampling_time))
        .withColumn("channel", F.lit(start_mhz) + F.col("channel_sample") * channel_mhz)
        .withColumn("snr", units.snr_db("power", "beam_noise")).drop("t0_us", "beam_noise")
    )


def best_detections(points: DataFrame, keys: Sequence[str] = ("track_id", "time_sample", "beam_id"),
                    tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """Strongest detection per key.  An aggregate, so it combines before the shuffle."""
    rest = [c for c in points.columns if c not in keys]
    order = F.struct(F.col("snr"), *[(-F.col(t)).alias("n_" + t) for t in tie])
    best = points.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_b"))
    return best.select(*keys, *[F.col("_b").getField(c).alias(c) for c in rest])


def fits(points: DataFrame, keys: Sequence[str] = ("track_id",), x="time_sample", y="channel_sample",
         dt: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Mergeable sums and line fit of channel over time."""
    s = points.groupBy(*keys).agg(*rg.sum_aggs(F.col(x) * F.lit(dt), F.col(y) * F.lit(dy)))
    f = rg.fit_of()
    return s.select(*keys, *rg.SUMS, f["slope"].alias("slope"), f["intercept"].alias("intercept"),
                    f["r"].alias("r"), f["stderr"].alias("stderr"))


def summary(points: DataFrame, keys: Sequence[str] = ("track_id",), dt: float = 1.0, dy: float = 1.0) -> DataFrame:
    """Track attributes from one pass over its detections."""
    f = rg.fit_of("_f")
    s = points.groupBy(*keys).agg(
        *rg.sum_aggs(F.col("time_sample") * F.lit(dt), F.col("channel_sample") * F.lit(dy), "_f"),
        F.count_distinct("time_sample").alias("track_size"), F.count_distinct("channel_sample").alias("n_channels"),
        F.count_distinct("beam_id").alias("activated_beams"), F.min("time_sample").alias("first_sample"),
        F.max("time_sample").alias("last_sample"), F.avg("snr").alias("mean_snr"), F.max("snr").alias("psnr"))
    return s.select(*keys, F.col("_fn").alias("n"), "track_size", "n_channels", "activated_beams", "first_sample",
                    "last_sample", "mean_snr", "psnr", f["slope"].alias("gradient"), f["intercept"].alias("intercept"),
                    f["r"].alias("r"),
                    rg.missing_score_open("first_sample", "last_sample", "track_size", "_fn").alias("missing"))


def middle_row(points: DataFrame, keys: Sequence[str] = ("track_id",), order: Sequence[str] = ("time_sample", "event_id"),
               bucket: int = 1024) -> DataFrame:
    """Row number int(n / 2) of each track in time order: its reference point."""
    b = points.withColumn("_bucket", F.floor(F.col(order[0]) / bucket))
    n = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = row_index(b, keys, list(order), "_bucket", "_pos").join(n, list(keys))
    return ranked.where(F.col("_pos") - 1 == F.floor(F.col("_n") / 2)).drop("_pos", "_n", "_bucket")


def beam_size(points: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Distinct values over beam numbers and sample numbers taken together."""
    both = points.select(*keys, F.explode(F.array(F.col("beam_id").cast("bigint"), F.col("time_sample"))).alias("_v"))
    return both.groupBy(*keys).agg(F.count_distinct("_v").alias("beam_size"))


def validity(tracks: DataFrame, linearity: float = 0.99, gradient: tuple[float, float] = GRADIENT,
             max_missing: float = 0.25, min_samples: int = 5, sure_beams: int = 5) -> DataFrame:
    """Ordered validity rules with the first one that fails as ``reason``."""
    reason = (
        F.when(F.col("activated_beams") > sure_beams, F.lit(None))
        .when(F.col("activated_beams") < 1, F.lit("beams"))
        .when((F.col("n_channels") < min_samples) | (F.col("track_size") < min_samples), F.lit("samples"))
        .when(~F.coalesce(F.abs("r") >= linearity, F.lit(False)), F.lit("linearity"))
        .when(~F.coalesce(F.col("gradient").between(gradient[1], gradient[0]), F.lit(False)), F.lit("gradient"))
        .when(F.col("missing") > max_missing, F.lit("missing"))
    )
    return tracks.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def acceptance(n, r, slope, missing, gradient: tuple[float, float] = GRADIENT, max_missing: float = 1.0,
               r_max: float = -0.99, p_max: float = 0.01) -> Column:
    """Gate on the union of a track and a cluster."""
    return ((F.col(missing) <= max_missing) & (F.col(r) <= r_max) & rg.p_value_gate(n, r, p_max, abs(r_max))
            & F.col(slope).between(gradient[1], gradient[0]))


def post_validity(points: DataFrame, keys: Sequence[str] = ("track_id",), min_samples: int = 5, min_beams: int = 2) -> DataFrame:
    s = points.groupBy(*keys).agg(F.count_distinct("time_sample").alias("n_samples"), F.count_distinct("beam_id").alias("n_beams"))
    return s.withColumn("is_valid", (F.col("n_samples") >= min_samples) & (F.col("n_beams") >= min_beams))


def growth_notices(sizes: DataFrame, keys: Sequence[str] = ("track_id",), order: str = "iter", size: str = "track_size",
                   bucket: int = 1024) -> DataFrame:
    """Created / modified notices: first size, then growth above 10 % since the block before."""
    b = sizes.withColumn("_bucket", F.floor(F.col(order) / bucket))
    p = previous(b, keys, [order], "_bucket", {"_before": size}).drop("_bucket")
    kind = F.when(F.col("_before").isNull(), F.lit("created")).when(
        (F.col(size) - F.col("_before")) / F.col(size) > 0.10, F.lit("modified"))
    return p.withColumn("notice", kind).drop("_before").where("notice IS NOT NULL")


def life_cycle(tracks: DataFrame, block_end, last_time, expiry_s: float = 3.0) -> DataFrame:
    """Status of a track: cancelled when invalid, terminated when silent for ``expiry_s``."""
    status = F.when(~F.col("valid"), F.lit("cancelled")).when(
        F.col(block_end) > F.col(last_time) + expiry_s, F.lit("terminated")).otherwise(F.lit("pending"))
    return tracks.withColumn("status", status)


def status_split(tracks: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return tracks.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def left_active_set(before: DataFrame, now: DataFrame, key: str = "track_id") -> DataFrame:
    return before.join(now, key, "left_anti")


def sessions(points: DataFrame, keys: Sequence[str], time_s: str, gap_s: int = 3, bucket_s: int = 86400) -> DataFrame:
    """Stretches of detections without a gap of ``gap_s`` seconds or more."""
    b = points.withColumn("_bucket", F.floor(F.col(time_s) / bucket_s))
    keys = list(keys)
    d = b.select(*keys, time_s, "_bucket").groupBy(*keys, time_s, "_bucket").agg(F.count("*").alias("_n"))
    p = previous(d, keys, [time_s], "_bucket", {"_before": time_s})
    new = F.when(F.col("_before").isNull() | (F.col(time_s) - F.col("_before") >= gap_s), 1).otherwise(0)
    s = running(p, keys, [time_s], "_bucket", new, "session_no")
    return s.groupBy(*keys, "session_no").agg(F.min(time_s).alias("start_s"), F.max(time_s).alias("end_s"), F.sum("_n").alias("n"))


# --- association -----------------------------------------------------------------------------
def cluster_table(points: DataFrame, keys: Sequence[str], dt: float, dy: float,
                  tie: Sequence[str] = ("event_id",)) -> DataFrame:
    """One row per cluster with the mergeable sums of its strongest detections."""
    best = best_detections(points, [*keys, "time_sample", "beam_id"], tie)
    s = fits(best, keys, dt=dt, dy=dy)
    return s.where("slope IS NOT NULL AND intercept IS NOT NULL")


def similar_pairs(clusters: DataFrame, obs: Sequence[str], ident: str, block: str = "iter", max_cv: float = 0.1,
                  gradient: tuple[float, float] = GRADIENT) -> DataFrame:
    """Cluster pairs of the same or the next block that belong to one line.

    Slopes and intercepts of {a, b, a+b} must agree within ``max_cv`` and the merged slope must
    lie in the window; the merged fit comes from added sums.  Two values can only agree if
    their ratio is below (1+q)/(1-q), so both go into logarithmic cells of that width and the
    similarity join is an equality join on observation, block and cells.
    """
    obs = list(obs)
    q = 1.1 * max_cv * math.sqrt(1.5)
    width = math.log((1 + q) / (1 - q))

    def cell(x):
        return F.floor(F.log(F.abs(F.col(x))) / width)

    c = clusters.where("slope <> 0 AND intercept <> 0").withColumn("_gs", cell("slope")).withColumn(
        "_gi", cell("intercept")).withColumn("_ss", F.signum("slope")).withColumn("_si", F.signum("intercept"))
    cols = [ident, block, "slope", "intercept", *rg.SUMS]
    link = [*obs, "_blk", "_gs", "_gi", "_ss", "_si"]
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    b = c.withColumn("_blk", F.col(block)).select(*link, *[F.col(x).alias("b_" + x) for x in cols])
    a = c.withColumn("_blk", F.explode(F.array(F.col(block), F.col(block) + 1)))
    a = a.withColumn("_d1", F.explode(near)).withColumn("_gs", F.col("_gs") + F.col("_d1"))
    a = a.withColumn("_d2", F.explode(near)).withColumn("_gi", F.col("_gi") + F.col("_d2"))
    a = a.select(*link, *[F.col(x).alias("a_" + x) for x in cols])
    j = a.join(b, link).where((F.col("a_" + block) < F.col("b_" + block)) | (
        (F.col("a_" + block) == F.col("b_" + block)) & (F.col("a_" + ident) < F.col("b_" + ident))))
    m = rg.fit_merged("a_", "b_")
    j = j.withColumn("slope", m["slope"]).withColumn("intercept", m["intercept"])
    return j.where(
        (rg.cv3("a_slope", "b_slope", "slope") < max_cv) & (rg.cv3("a_intercept", "b_intercept", "intercept") < max_cv)
        & F.col("slope").between(gradient[1], gradient[0])).select(
        *obs, F.col("a_" + ident).alias("src"), F.col("b_" + ident).alias("dst"), "slope", "intercept")


def associate(clusters: DataFrame, obs: Sequence[str], ident: str, **kw) -> DataFrame:
    """Order-free association: clusters linked by similarity form one track."""
    edges = similar_pairs(clusters, obs, ident, **kw).select(*obs, "src", "dst")
    return label_nodes(clusters, edges, ident, obs).withColumnRenamed("component", "track")


def bounding_window(points: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """Extent of a track rounded outwards to tens, and its centre."""
    t, c = F.col("time_sample"), F.col("channel_sample")
    return points.groupBy(*keys).agg(
        (F.floor(F.min(t) / 10) * 10).alias("t_lo"), (F.ceil(F.max(t) / 10) * 10).alias("t_hi"),
        (F.floor(F.min(c) / 10) * 10).alias("c_lo"), (F.ceil(F.max(c) / 10) * 10).alias("c_hi"),
        F.avg(t).alias("t_mean"), F.avg(c).alias("c_mean"))


def upsert(existing: DataFrame, changes: DataFrame, key: str, version: str, deleted: str | None = None) -> DataFrame:
    """Table after applying keyed changes: newest change per key wins, deletions drop out."""
    rest = [c for c in changes.columns if c != key]
    latest = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(
        key, *[F.col("_r").getField(c).alias(c) for c in rest])
    kept = existing.join(latest.select(key), key, "left_anti")
    if deleted:
        latest = latest.where(~F.col(deleted)).drop(deleted)
    return kept.unionByName(latest)

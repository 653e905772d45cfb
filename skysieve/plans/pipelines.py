"""Named pipelines: fixed compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from skysieve.operators import beamform as bf, channelise as ch, correlate as co, dbscan as db, denoise as dn
from skysieve.operators import noise as nz, streaks as st, tracks as tr
from skysieve.session import cut


def power_pixels(voltages: DataFrame, weights: DataFrame, n_chans: int, n_taps: int, block_len: int) -> DataFrame:
    """Voltages -> beams -> spectra -> power per (block, beam, channel, time)."""
    beams = bf.beamform(voltages, weights)
    spec = ch.channelise(beams, n_chans, n_taps, ["beam_id"])
    return spec.select(F.floor(F.col("spectrum") / block_len).alias("iter"), "beam_id",
                       F.col("channel").alias("channel_sample"), (F.col("spectrum") % block_len).cast("int").alias("time_idx"),
                       bf.power().alias("power"))


def beam_strips(frames: DataFrame, weights: DataFrame, keys: Sequence[str] = ("obs_id", "iter")) -> DataFrame:
    """Dense frames ``(keys, sample, re[], im[])`` to one row per block and beam with arrays over samples.

    One matrix product per batch of frames, then one shuffle of runs of samples, which are put in
    order as wholes; a row is a block.
    """
    runs = bf.beam_slices(frames, weights, keys).groupBy(*keys, "beam_id").agg(
        F.array_sort(F.collect_list(F.struct("first", "re", "im"))).alias("_c"))
    return runs.select(*keys, "beam_id", F.flatten("_c.re").alias("re"), F.flatten("_c.im").alias("im"))


def dense_pixels(frames: DataFrame, weights: DataFrame, n_chans: int, n_taps: int, n_noise_blocks: int = 10,
                 obs: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """Frames of any number of observations to noise-free pixels and the noise table.

    Beams, spectra, power and noise stay arrays with one row per channel of a block; pixels are
    made last, with the noise of their row already in it.
    """
    strips = ch.channelise_strips(beam_strips(frames, weights, (obs, "iter")), n_chans, n_taps, (obs, "beam_id"))
    power = F.zip_with("re", "im", lambda re, im: bf.power(re, im))
    rows = cut(nz.strip_noise(strips.select(obs, "iter", "beam_id", F.col("channel").alias("channel_sample"), power.alias("power"))))
    noise = cut(nz.rolling_noise(rows.drop("power"), n_noise_blocks, (obs, "beam_id", "channel_sample")))
    channel = [obs, "iter", "beam_id", "channel_sample"]
    level = rows.join(noise.select(*channel, "channel_noise"), channel)
    above = F.transform("power", lambda p: p - F.col("channel_noise"))
    return level.select(*channel, F.posexplode(above).alias("time_idx", "power")), noise


def cleaned_pixels(pixels: DataFrame, n_channels: int, n_times: int, n_noise_blocks: int = 10,
                   filters: Sequence[str] = ("triangle", "pepper"), obs: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Noise estimate, subtraction and filters; returns the pixels and the noise table."""
    channel = [*obs, "iter", "beam_id", "channel_sample"]
    # the rolling step reads the block noise twice: write that small table, not the pixels, again
    noise = cut(nz.rolling_noise(cut(nz.channel_noise(pixels, channel)), n_noise_blocks, [*obs, "beam_id", "channel_sample"]))
    return filtered(nz.subtract_noise(pixels, noise, channel), noise, n_channels, n_times, filters, obs), noise


def filtered(pixels: DataFrame, noise: DataFrame, n_channels: int, n_times: int, filters: Sequence[str] = ("triangle", "pepper"),
             obs: Sequence[str] = ()) -> DataFrame:
    """Noise-free pixels through the filters, down to the sparse image."""
    keys = [*obs, "iter", "beam_id"]
    # thresholds read the pixels three times (range, histogram, gate): subtract the noise once
    image = cut(pixels)
    # filters before the first neighbourhood filter see the whole image, negative values included
    at = filters.index("pepper") if "pepper" in filters else len(filters)
    sparse = nz.sparse(dn.denoise(image, noise, n_channels, n_times, filters[:at], keys))
    return dn.denoise(sparse, noise, n_channels, n_times, filters[at:], keys)


def beam_level(noise: DataFrame, obs: Sequence[str] = ()) -> DataFrame:
    keys = [*obs, "iter", "beam_id"]
    return nz.beam_noise(noise, keys, "channel_noise").select(*keys, "beam_noise")


def streak_clusters(pixels: DataFrame, level: DataFrame, n_channels: int, n_times: int, keys: Sequence[str], channel_hz: float,
                    sampling_time: float, gradient=tr.GRADIENT) -> DataFrame:
    """Pixels of valid streaks as clusters; the streak rules know no physical units."""
    found = st.detect_streaks(pixels, level, n_channels, n_times, keys)
    return found.withColumn("cluster_id", F.col("streak").cast("bigint")).drop("streak", "group_id")


def density_clusters(pixels: DataFrame, level: DataFrame, n_channels: int, n_times: int, keys: Sequence[str],
                     channel_hz: float, sampling_time: float, gradient=tr.GRADIENT, linearity: float = 0.99) -> DataFrame:
    """Pixels of valid density clusters."""
    clusters = cut(db.dbscan(pixels, n_channels, n_times, keys=keys))
    ok = db.valid_clusters(db.cluster_fits(clusters, keys), channel_hz, sampling_time, linearity, gradient)
    return clusters.join(ok.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_semi")


DETECTORS: dict[str, Callable[..., DataFrame]] = {"streaks": streak_clusters, "dbscan": density_clusters}


def detections(pixels: DataFrame, noise: DataFrame, blocks: DataFrame, n_channels: int, n_times: int, start_mhz: float,
               channel_mhz: float, sampling_time: float, detector: str = "streaks", filters: Sequence[str] = ("triangle", "pepper"),
               gradient=tr.GRADIENT, obs: str = "obs_id", warm_up: int = 2, **options) -> DataFrame:
    """Noise-free pixels to detections of valid clusters in physical units, each block by itself.

    ``blocks(obs, iter, t0_us)`` has the start of each block.
    """
    keys = [obs, "iter", "beam_id"]
    level = cut(beam_level(noise, [obs]))
    # a detector reads the pixels several times: run the filters once
    clean = cut(nz.skip_warm_up(filtered(pixels, noise, n_channels, n_times, filters, [obs]), warm_up))
    clusters = DETECTORS[detector](clean, level, n_channels, n_times, keys, channel_mhz * 1e6, sampling_time, gradient, **options)
    return tr.to_detections(clusters, level, blocks, start_mhz, channel_mhz, sampling_time, n_times, [obs])


def track_points(pixels: DataFrame, noise: DataFrame, blocks: DataFrame, n_channels: int, n_times: int, start_mhz: float,
                 channel_mhz: float, sampling_time: float, gradient=tr.GRADIENT, obs: str = "obs_id", **options) -> DataFrame:
    """Noise-free pixels to detections that carry their observation's ``track``.

    Filters, detector, detections in physical units and order-free association, all keyed by the
    observation; ``options`` are those of :func:`detections`.
    """
    d = detections(pixels, noise, blocks, n_channels, n_times, start_mhz, channel_mhz, sampling_time, gradient=gradient, obs=obs, **options)
    return tracked(d, channel_mhz, sampling_time, gradient, obs)


def tracked(found: DataFrame, channel_mhz: float, sampling_time: float, gradient=tr.GRADIENT, obs: str = "obs_id") -> DataFrame:
    """Detections, of a batch or as a stream has landed them, with the ``track`` of their cluster."""
    d = cut(found.withColumn("cluster", F.concat_ws(":", "iter", "beam_id", "cluster_id")).withColumn(
        "event_id", F.col("channel_sample").cast("bigint")).withColumn("time", F.timestamp_micros("time_us")))
    table = cut(tr.cluster_table(d, [obs, "iter", "cluster"], sampling_time, channel_mhz * 1e6))
    tracks = tr.associate(table, [obs], "cluster", gradient=gradient).select(obs, "cluster", "track")
    return tr.best_detections(d.join(tracks, [obs, "cluster"]), (obs, "track", "time_sample", "beam_id"))


def track_table(points: DataFrame, blocks: DataFrame, sampling_time: float, channel_mhz: float, gradient=tr.GRADIENT,
                obs: str = "obs_id", **rules) -> DataFrame:
    """One row per track with its validity and life-cycle status at the end of the observation."""
    tracks = tr.validity(tr.summary(points, [obs, "track"], sampling_time, channel_mhz * 1e6), gradient=gradient, **rules)
    last = points.groupBy(obs, "track").agg((F.max("time_us") / 1e6).alias("last_s"))
    end = blocks.groupBy(obs).agg((F.max("t0_us") / 1e6).alias("end_s"))
    return tr.life_cycle(tracks.join(last, [obs, "track"]).join(end, obs), "end_s", "last_s")


def streak_detection(pixels: DataFrame, n_channels: int, n_times: int, **kw) -> DataFrame:
    """Streak detector on power pixels, from noise estimate to validated streaks."""
    clean, noise = cleaned_pixels(pixels, n_channels, n_times, **kw)
    return st.detect_streaks(cut(nz.skip_warm_up(clean)), beam_level(noise), n_channels, n_times)


def dbscan_detection(pixels: DataFrame, n_channels: int, n_times: int, channel_hz: float, sampling_time: float,
                     linearity: float = 0.99, gradient=tr.GRADIENT, **kw) -> DataFrame:
    """Density clustering on power pixels; pixels of valid clusters."""
    clean, _ = cleaned_pixels(pixels, n_channels, n_times, **kw)
    clusters = cut(db.dbscan(nz.skip_warm_up(clean), n_channels, n_times))
    ok = db.valid_clusters(db.cluster_fits(clusters, ["iter", "beam_id"]), channel_hz, sampling_time, linearity, gradient)
    return clusters.join(ok.select("iter", "beam_id", "cluster_id"), ["iter", "beam_id", "cluster_id"], "left_semi")


def standalone_beams(voltages: DataFrame, weights: DataFrame, n_samples: int) -> DataFrame:
    """Integrated, calibrated beam power."""
    return bf.calibrated_beam_power(bf.integrated_power(bf.beamform(voltages, weights), n_samples))


def correlation(voltages: DataFrame, n_ants: int, integration: int) -> DataFrame:
    return co.correlate_frames(bf.to_frames(voltages, n_ants), integration, n_ants)


def channelised_correlation(voltages: DataFrame, n_ants: int, n_chans: int, n_taps: int, integration: int,
                            channels: tuple[int, int]) -> DataFrame:
    """Channelise every antenna, keep a channel range, correlate per channel."""
    spec = ch.channelise(voltages, n_chans, n_taps, ["ant"])
    kept = co.channel_range(spec, *channels).withColumnRenamed("spectrum", "sample")
    frames = bf.to_frames(kept, n_ants, ["channel", "sample"])
    return co.correlate_frames(frames, integration, n_ants, ["channel"])


def truncate(voltages: DataFrame, first: int, last: int, column: str = "iter") -> DataFrame:
    """Copy of a block range."""
    return voltages.where(F.col(column).between(first, last))


PIPELINES: dict[str, Callable[..., DataFrame]] = {
    "streak_detection": streak_detection, "dbscan_detection": dbscan_detection, "standalone_beams": standalone_beams,
    "correlation": correlation, "channelised_correlation": channelised_correlation, "truncate": truncate,
    "power_pixels": power_pixels, "dense_pixels": dense_pixels, "track_points": track_points, "track_table": track_table,
}

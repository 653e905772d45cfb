"""Tracking data messages and track summaries as text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

# Constant lines of the message header and of each metadata block.
HEADER = ("CCSDS_TDM_VERS = 1.0",)
META_CONSTANT = ("PATH = 3,2,1", "ANGLE_TYPE = AZEL", "TRANSMIT_BAND = UHF", "RECEIVE_BAND = UHF",
                 "TIMETAG_REF = RECEIVE")
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def beam_metadata(points: DataFrame, beam_noise: DataFrame, keys: Sequence[str] = ("track_id",)) -> DataFrame:
    """First and last time of each (track, beam) with the noise of the beam."""
    m = points.groupBy(*keys, "beam_id").agg(F.min("time").alias("start_time"), F.max("time").alias("stop_time"),
                                             F.count("*").alias("n"))
    return m.join(beam_noise.select("beam_id", "beam_noise"), "beam_id", "left")


def data_lines(points: DataFrame, pointings: DataFrame, tx_mhz: float, keys: Sequence[str] = ("track_id",),
               channel: str = "channel") -> DataFrame:
    """Five lines per detection, numbered in message order inside (track, beam)."""
    t = F.date_format("time", TIME_FORMAT)
    j = points.join(pointings.select("beam_id", "az", "el"), "beam_id", "left")
    text = [
        F.format_string("ANGLE_1 = %s %.6f", t, F.col("az")),
        F.format_string("ANGLE_2 = %s %.6f", t, F.col("el")),
        F.format_string("PC_N0   = %s %.6f", t, F.col("snr")),
        F.format_string("TRANSMIT_FREQ_3 = %s %.3f", t, F.lit(tx_mhz * 1e6)),
        F.format_string("RECEIVE_FREQ_1 = %s %.3f", t, F.col(channel) * 1e6),
    ]
    return j.select(*keys, "beam_id", "time_sample", "event_id", F.posexplode(F.array(*text)).alias("line_no", "line"))


def messages(points: DataFrame, pointings: DataFrame, beam_noise: DataFrame, tx_mhz: float, target: str,
             integration_s: float, keys: Sequence[str] = ("track_id",), channel: str = "channel",
             originator: str = "SURVEY", comments: Sequence[str] = ()) -> DataFrame:
    """All lines of the message of every track with their order columns.

    The creation date is the time of the track's last detection, so that a message made again is
    the same; ``comments`` are lines of the header.  The order is (beam, section, time, detection, line); writing sorts inside a track only.
    """
    keys = list(keys)
    t = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    meta = beam_metadata(points, beam_noise, keys)
    start = [F.lit("META_START"), F.format_string("COMMENT beam_id=%d", F.col("beam_id")),
             F.format_string("COMMENT noise_power=%.6f", F.coalesce(F.col("beam_noise"), F.lit(0.0))), F.lit("TIME_SYSTEM = UTC"),
             F.concat(F.lit("START_TIME = "), F.date_format("start_time", t)),
             F.concat(F.lit("STOP_TIME  = "), F.date_format("stop_time", t)),
             F.lit("PARTICIPANT_1 = RX"), F.lit(f"PARTICIPANT_2 = {target}"), F.lit("PARTICIPANT_3 = TX"),
             *[F.lit(x) for x in META_CONSTANT], F.lit(f"INTEGRATION_INTERVAL = {integration_s}"),
             F.lit("RANGE_UNITS = km"), F.lit("DATA_QUALITY = RAW"), F.lit("META_STOP"), F.lit("DATA_START")]

    def fixed(df, section, lines):
        return df.select(*keys, "beam_id", F.lit(section).alias("section"), F.lit(0).cast("bigint").alias("time_sample"),
                         F.lit(0).cast("bigint").alias("event_id"), F.posexplode(F.array(*lines)).alias("line_no", "line"))

    head = points.groupBy(*keys).agg(F.max("time").alias("created")).withColumn("beam_id", F.lit(-1))
    head = fixed(head, 0, [*[F.lit(x) for x in HEADER], *[F.lit(f"COMMENT {x}") for x in comments],
                           F.concat(F.lit("CREATION_DATE = "), F.date_format("created", t)), F.lit(f"ORIGINATOR = {originator}")])
    body = data_lines(points, pointings, tx_mhz, keys, channel).select(
        *keys, "beam_id", F.lit(2).alias("section"), "time_sample", "event_id", "line_no", "line")
    return head.unionByName(fixed(meta, 1, start)).unionByName(body).unionByName(fixed(meta, 3, [F.lit("DATA_STOP")]))


def track_summary(points: DataFrame, tx_mhz: float, keys: Sequence[str] = ("track_id",), channel: str = "channel") -> DataFrame:
    """One summary row per track: peak, means, beams and blocks seen."""
    dopp = (F.col(channel) - F.lit(tx_mhz)) * 1e6
    peak = F.struct(F.col("snr"), -F.col("event_id"))
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return points.groupBy(*keys).agg(
        F.max_by(dopp, peak).alias("psnr_doppler"), F.max_by("time_sample", peak).alias("psnr_sample"),
        F.max("snr").alias("psnr"), F.avg("snr").alias("mean_snr"), join("beam_id").alias("activated_beams"),
        F.count("*").alias("n"), F.corr("channel_sample", "time_sample").alias("r_value"), join("iter").alias("iterations"))

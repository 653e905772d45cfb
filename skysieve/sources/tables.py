"""Table and text scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

_NUMBER = r"[+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?"
COMPLEX_TEXT = rf"^\(?({_NUMBER})([+-][0-9.]+(?:[eE][+-]?[0-9]+)?)j\)?$"


def parse_complex(df: DataFrame, column: str) -> DataFrame:
    """Split ``a+bj`` text into ``re`` and ``im``; unreadable lines give nulls."""
    text = F.trim(F.col(column))
    return df.withColumn("re", F.regexp_extract(text, COMPLEX_TEXT, 1).try_cast("double")).withColumn(
        "im", F.regexp_extract(text, COMPLEX_TEXT, 2).try_cast("double"))


def image_window(pixels: DataFrame, c0: int, c1: int, t0: int, n_times: int) -> DataFrame:
    """Channel and time window of stored images, renumbered from zero.

    The window is a range predicate on stored columns, so it reaches the scan.
    """
    c, t = F.col("channel_sample"), F.col("time_idx")
    return (
        pixels.where((c >= c0) & (c < c1) & (t >= t0) & (t < t0 + n_times))
        .withColumn("channel_sample", c - c0).withColumn("time_idx", t - t0)
    )


def _where(df: DataFrame, *conditions) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def observations(df: DataFrame, status: str | None = None, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    """Observations by status and start time; unset arguments add no predicate."""
    return _where(df, None if status is None else F.col("status") == status,
                  None if from_s is None else F.col("start_s") >= from_s, None if to_s is None else F.col("start_s") <= to_s)


def tracks(df: DataFrame, obs_id=None, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    return _where(df, None if obs_id is None else F.col("obs_id") == obs_id,
                  None if from_s is None else F.col("created_s") >= from_s, None if to_s is None else F.col("created_s") <= to_s)


def events(df: DataFrame, from_s: int | None = None, to_s: int | None = None) -> DataFrame:
    return _where(df, None if from_s is None else F.col("created_s") >= from_s, None if to_s is None else F.col("created_s") <= to_s)


def beam_candidates(df: DataFrame, obs_id=None, beam_id=None, from_t=None, to_t=None, min_channel=None, max_channel=None) -> DataFrame:
    """Candidates of one observation, or, without one, by beam, time and channel range."""
    if obs_id is not None:
        return df.where(F.col("obs_id") == obs_id)
    return _where(df, None if beam_id is None else F.col("beam_id") == beam_id,
                  None if from_t is None else F.col("min_t") >= from_t, None if to_t is None else F.col("max_t") <= to_t,
                  None if min_channel is None else F.col("min_channel") >= min_channel,
                  None if max_channel is None else F.col("max_channel") <= max_channel)


SCHEDULE_SCHEMA = ("name string, pipeline string, config_parameters struct<beamformer: struct<reference_declination: double>, "
                   "start_s: bigint, duration: double>")


def parse_schedule(df: DataFrame, column: str, required=("name", "pipeline", "start_s")) -> DataFrame:
    """Schedule entries from JSON text, with a flag for entries that lack a required field."""
    keep = [c for c in df.columns if c != column]
    p = df.select(*keep, F.from_json(column, SCHEDULE_SCHEMA).alias("_e")).select(
        *keep, "_e.name", "_e.pipeline", F.col("_e.config_parameters.start_s").alias("start_s"),
        F.col("_e.config_parameters.duration").alias("duration"),
        F.col("_e.config_parameters.beamformer.reference_declination").alias("declination"))
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return p.withColumn("ok", ok)


def schedule_file(spark, path: str) -> DataFrame:
    """Schedule array file, entry by entry: one bad entry does not spoil the others.

    The file is one JSON array, written by hand; tables of requests use :func:`parse_schedule`.
    """
    text = spark.read.text(path, wholetext=True)
    return parse_schedule(text.select(F.explode(F.from_json("value", "array<string>")).alias("json")), "json")


def beam_csv(spark, path: str, schema) -> DataFrame:
    """Beam power CSV with its null marker."""
    return spark.read.schema(schema).option("header", True).option("nullValue", "NULL").csv(path)

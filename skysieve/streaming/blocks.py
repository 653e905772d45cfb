"""Streams of landed blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def block_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """Rows of block files as they land; event time is their ``ts``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def voltage_stream(spark: SparkSession, path: str, n_ants: int, block_samples: int, observations: bool = False) -> DataFrame:
    """Frames of raw recordings, block by block as their files grow; see ``sources.raw``."""
    from skysieve.sources.raw import register

    return register(spark).readStream.format("voltage_raw").option("path", path).option("nants", n_ants).option(
        "blocksamples", block_samples).option("observations", str(observations).lower()).load()


def stamped(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows without a usable time get the arrival time, and are marked as late."""
    return df.withColumn("late", F.col(ts).isNull()).withColumn(ts, F.coalesce(F.col(ts), F.current_timestamp()))

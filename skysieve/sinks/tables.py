"""Table and text sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def gain_lines(gains: DataFrame, stage: str, keys: Sequence[str] = (), digits: int = 16) -> DataFrame:
    """Gains as complex text, one line per antenna, labelled with the solution stage."""
    line = F.format_string(f"%.{digits}e%+.{digits}ej", F.col("re"), F.col("im"))
    return gains.select(F.lit(stage).alias("stage"), *keys, "ant", line.alias("line"))


def csv_lines(df: DataFrame, columns: Sequence[tuple[str, str]], null: str = "NULL") -> DataFrame:
    """Rows as CSV text with a fixed printf format per column and a marker for nulls."""
    parts = [F.coalesce(F.when(F.col(c).isNotNull(), F.format_string(f, F.col(c))), F.lit(null))
             for c, f in columns]
    return df.select(F.concat_ws(",", *parts).alias("line"))


def raw_voltages(frames: DataFrame, path: str, blocks_per_file: int = 4) -> None:
    """Flat raw files, a new one every ``blocks_per_file`` blocks."""
    from skysieve.sources.raw import register

    register(frames.sparkSession)
    f = frames.select("iter", "sample", "re", "im").withColumn("_f", F.floor(F.col("iter") / blocks_per_file))
    f.repartition("_f").sortWithinPartitions("_f", "sample").drop("_f").write.format("voltage_raw").option(
        "path", path).option("blocksperfile", blocks_per_file).mode("append").save()


def raw_voltage_stream(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Frames of a stream to flat raw files, one for each run of blocks a task holds; an epoch's files appear together."""
    from skysieve.sources.raw import register

    register(frames.sparkSession)
    return frames.select("iter", "sample", "re", "im").repartition("iter").writeStream.format("voltage_raw").option("path", path).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def beam_power_stream(beams: DataFrame, path: str, checkpoint: str, times_per_file: int = 160) -> StreamingQuery:
    """Rows ``(time_idx, channel, power[])`` of a stream to flat files, each a run of times.

    A task holds the rows of its runs in one epoch.
    """
    from skysieve.sources.raw import register

    register(beams.sparkSession)
    rows = beams.select("time_idx", "channel", "power").repartition(F.floor(F.col("time_idx") / times_per_file))
    return rows.writeStream.format("beam_raw").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        "append").trigger(availableNow=True).start()


def beam_table(beams: DataFrame, beam_range: tuple[int, int], channel_range: tuple[int, int] | None = None,
               as_power: bool = True, warm_up: int = 2) -> DataFrame:
    """Rows of the beam sink: inclusive beam and channel ranges after the filter warm-up."""
    out = beams.where(F.col("iter") > warm_up).where(F.col("beam_id").between(*beam_range))
    if channel_range:
        out = out.where(F.col("channel").between(*channel_range))
    if as_power:
        out = out.withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im")).drop("re", "im")
    return out


def visibility_table(vis: DataFrame, block_start_s: float, integration_s: float) -> DataFrame:
    """Visibilities with the time of each integration."""
    return vis.withColumn("time_s", F.lit(block_start_s) + F.col("t_idx") * integration_s)


def image_table(beams: DataFrame, beam_ids: Sequence[int], header: dict[str, object], blocks_per_file: int = 10) -> DataFrame:
    """Power image rows of selected beams with header columns and their file number."""
    out = beams.where(F.col("beam_id").isin(list(beam_ids))).withColumn("file_no", F.floor(F.col("iter") / blocks_per_file))
    return out.withColumns({k: F.lit(v) for k, v in header.items()})


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (), files_per_value: int = 1) -> None:
    """Append to a Parquet table.

    Rows of one partition value go to ``files_per_value`` tasks, so a hot value is not
    written by a single one when more are asked for.
    """
    if partition_by:
        if files_per_value > 1:
            df = df.repartition(*partition_by, (F.rand(7) * files_per_value).cast("int"))
        else:
            df = df.repartition(*partition_by)
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def snapshot(df: DataFrame, path: str, name: str) -> None:
    """Stage dump, partitioned by block."""
    append(df, f"{path}/{name}", ["iter"])


def message_files(lines: DataFrame, path: str, keys: Sequence[str] = ("track_id",)) -> None:
    """One text folder per track; lines are sorted inside the task that writes the track."""
    order = [*keys, "beam_id", "section", "time_sample", "event_id", "line_no"]
    lines.repartition(*keys).sortWithinPartitions(*order).select(*keys, F.col("line").alias("value")).write.partitionBy(
        *keys).text(path)

"""Monitoring reads: illumination table, prediction overlays, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skysieve.operators.sequences import small


def prediction_overlay(pixels: DataFrame, targets: DataFrame, before: int, after: int, channels: int,
                       cell: int = 64) -> DataFrame:
    """Pixels within (transit - before, transit + after) and +-channels of a predicted target.

    ``targets(target, iter, transit, channel)``.  Each target is listed in the time cells its
    window touches, so the range join is an equality join on (block, cell).
    """
    t = targets.withColumn("_lo", F.col("transit") - before).withColumn("_hi", F.col("transit") + after)
    t = t.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo") / cell), F.floor(F.col("_hi") / cell))))
    p = pixels.withColumn("_cell", F.floor(F.col("time_idx") / cell))
    hit = p.join(small(t), ["iter", "_cell"])
    return hit.where((F.col("time_idx") >= F.col("_lo")) & (F.col("time_idx") <= F.col("_hi")) & (
        F.abs(F.col("channel_sample") - F.col("channel")) <= channels)).drop("_lo", "_hi", "_cell")


def illumination(points: DataFrame, beams: list[int], keys=("obs_id",), time: str = "time_sample") -> DataFrame:
    """Time by beam table of SNR (``S<beam>``) and channel (``C<beam>``), with the strongest beam.

    One conditional aggregate per beam over the given list; the strongest beam's tie goes to
    the lowest beam.
    """
    aggs = []
    for b in beams:
        row = F.max_by(F.struct("snr", "channel_sample"), F.when(F.col("beam_id") == b, F.struct("snr", -F.col("channel_sample"))))
        aggs.append(row.alias(f"_b{b}"))
    t = points.groupBy(*keys, time).agg(*aggs)
    t = t.select(*keys, time, *[F.col(f"_b{b}.snr").alias(f"S{b}") for b in beams],
                 *[F.col(f"_b{b}.channel_sample").alias(f"C{b}") for b in beams])
    best = F.array_max(F.filter(F.array(*[F.struct(F.col(f"S{b}").alias("s"), F.lit(-b).alias("b")) for b in beams]),
                                lambda x: x["s"].isNotNull()))
    return t.withColumn("max_snr", best["s"]).withColumn("max_beam", -best["b"])


def strongest_runs(table: DataFrame, keys=("obs_id",), time: str = "time_sample", value: str = "max_beam",
                   bucket: int = 1024) -> DataFrame:
    """Runs of consecutive samples with the same strongest beam that are longer than one."""
    from skysieve.operators.sequences import previous, running

    keys = list(keys)
    b = table.withColumn("_bucket", F.floor(F.col(time) / bucket))
    p = previous(b, keys, [time], "_bucket", {"_pv": value, "_pt": time})
    new = F.when(F.col("_pv").isNull() | (F.col("_pv") != F.col(value)), 1).otherwise(0)
    r = running(p, keys, [time], "_bucket", new, "run_id").withColumn(
        "dt", F.coalesce(F.col(time) - F.col("_pt"), F.lit(0))).drop("_pv", "_pt", "_bucket")
    size = r.groupBy(*keys, "run_id").agg(F.count("*").alias("consecutive"))
    return r.join(size.where("consecutive > 1"), keys + ["run_id"])


def last_points(metrics: DataFrame, keys=("ant",), order=("ts_us", "event_id"), n: int = 90) -> DataFrame:
    """The newest ``n`` points per key.

    Spark keeps only the running top ``n`` of each key before the shuffle (window group
    limit), so a hot key sends ``n`` rows per task.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*[F.col(o).desc() for o in order])
    return metrics.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def page(df: DataFrame, order, page_no: int, per_page: int) -> DataFrame:
    """One page of a newest-first listing, with the total number of rows."""
    total = df.count()
    return df.orderBy(*order).offset((page_no - 1) * per_page).limit(per_page).withColumn(
        "total", F.lit(total).cast("bigint"))


def nearest(df: DataFrame, keys, value: str, target) -> DataFrame:
    """Row value closest to ``target`` per key; the lower value wins a tie."""
    return df.groupBy(*keys).agg(F.min_by(value, F.struct(F.abs(F.col(value) - target), F.col(value))).alias(value))


def latest_per(df: DataFrame, keys, order) -> DataFrame:
    """Newest row of each key, such as the configuration in force; an aggregate, so it combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_n"))
    return newest.select(*keys, *[F.col("_n").getField(c).alias(c) for c in rest])


def first_per(df: DataFrame, keys, order) -> DataFrame:
    """First record per key in the given order."""
    rest = [c for c in df.columns if c not in keys]
    f = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return f.select(*keys, *[F.col("_r").getField(c).alias(c) for c in rest])


def max_hold(spectra: DataFrame, keys=("bin",), order: str = "capture", value: str = "level", bucket: int = 1024) -> DataFrame:
    """Running maximum and minimum per bin over the captures."""
    from skysieve.operators.sequences import running

    b = spectra.withColumn("_bucket", F.floor(F.col(order) / bucket))
    hi = running(b, list(keys), [order], "_bucket", F.col(value), "max_hold", F.max)
    return running(hi, list(keys), [order], "_bucket", F.col(value), "min_hold", F.min).drop("_bucket")

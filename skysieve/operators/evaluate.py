"""Scoring of filters and detectors against truth masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

CELL = ("channel_sample", "time_idx")


def confusion(truth: DataFrame, predicted: DataFrame, keys: Sequence[str], cells: int) -> DataFrame:
    """TP, FP, FN and TN per image from two sparse pixel sets of images with ``cells`` cells."""
    keys = list(keys)
    t = truth.select(*keys, *CELL).distinct().withColumn("_t", F.lit(1))
    p = predicted.select(*keys, *CELL).distinct().withColumn("_p", F.lit(1))
    both = t.join(p, [*keys, *CELL], "full_outer")
    return both.groupBy(*keys).agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_p").isNull()).alias("fn"),
    ).withColumn("tn", F.lit(cells) - F.col("tp") - F.col("fp") - F.col("fn"))


def scores(counts: DataFrame, cells: int) -> DataFrame:
    """Scores of the confusion counts; precision of an empty prediction is zero."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    sens, spec = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    out = counts.withColumn("precision", F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)))
    return (
        out.withColumn("recall", sens).withColumn("specificity", spec).withColumn("fpr", 1 - spec)
        .withColumn("accuracy", (tp + tn) / cells)
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))
        .withColumn("jaccard", F.try_divide(tp, tp + fp + fn))
        .withColumn("mse", (fp + fn) / cells)
        .withColumn("n_px", (tp + fp).cast("bigint"))
        .withColumn("reduction", (1 - (fp + tp) / cells) * 100.0)
        .withColumn("score", F.try_divide(2 * sens * spec, sens + spec))
    )


def roll_up(results: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("snr", "name")) -> DataFrame:
    """Mean and sample deviation of each metric per group."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_samp(m).alias(f"{m}_std")]
    return results.groupBy(*by).agg(*aggs)


def compare_detectors(clusters: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Cluster sizes and spans of several detectors side by side."""
    out = None
    for name, df in clusters.items():
        one = df.select(F.lit(name).alias("algorithm"), *keys, "cluster_id", *CELL)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("algorithm", *keys, "cluster_id").agg(
        F.count("*").alias("n"), F.count_distinct("time_idx").alias("n_times"),
        F.count_distinct("channel_sample").alias("n_channels"))

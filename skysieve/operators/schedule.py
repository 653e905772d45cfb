"""Observation requests: validation, pending lists, conflicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def checked_requests(requests: DataFrame, now_s: int, required: Sequence[str] = ("name", "start_s", "end_s", "pipeline")) -> DataFrame:
    """Requests with the reason of the first rule they break (null when accepted).

    Times are whole epoch seconds; an open end is allowed only where ``end_s`` is not required.
    """
    reason = None
    for c in required:
        cond, text = F.col(c).isNull(), F.lit(f"{c} not specified")
        reason = F.when(cond, text) if reason is None else reason.when(cond, text)
    reason = reason.when(F.col("start_s") - F.lit(now_s) < 1, F.lit("start time is not in the future"))
    reason = reason.when(F.col("start_s") > F.col("end_s"), F.lit("start time is after end time"))
    return requests.withColumn("reason", reason).withColumn("ok", F.col("reason").isNull())


def pending(observations: DataFrame, now_s: int, grace_s: int = 300) -> DataFrame:
    """Pending observations that start no more than ``grace_s`` seconds ago, by start time."""
    return observations.where((F.col("status") == "pending") & (F.col("start_s") >= now_s - grace_s)).orderBy("start_s", "obs_id")


def conflicts(new: DataFrame, scheduled: DataFrame, keys: Sequence[str] = (), bucket_s: int = 86400) -> DataFrame:
    """Pairs (new, scheduled) that cannot both run.

    Closed intervals conflict when they overlap.  If either end is open, the scheduled one
    conflicts when it is open and starts earlier, the new one when it is open and starts
    earlier.  ``new(keys, new_id, start_s, end_s)``, ``scheduled(keys, obs_id, start_s, end_s)``.

    Bounded intervals are listed once per day they touch and meet by equality; a pair is
    reported only in the first day both touch.  Open ends are not spread over days: such a row
    meets the rows of its own keys by start time alone, and every such pair is a result.
    """
    keys = list(keys)
    a = new.select(*keys, "new_id", F.col("start_s").alias("a0"), F.col("end_s").alias("a1"))
    b = scheduled.select(*keys, "obs_id", F.col("start_s").alias("b0"), F.col("end_s").alias("b1"))

    def days(df, lo, hi):
        return df.where(F.col(hi).isNotNull() & (F.col(lo) <= F.col(hi))).withColumn("_day", F.explode(F.sequence(
            F.floor(F.col(lo) / bucket_s), F.floor(F.col(hi) / bucket_s))))

    first = F.floor(F.greatest("a0", "b0") / bucket_s)
    closed = days(a, "a0", "a1").join(days(b, "b0", "b1"), keys + ["_day"]).where(
        (F.col("a0") <= F.col("b1")) & (F.col("b0") <= F.col("a1")) & (F.col("_day") == first)).drop("_day")
    open_b = a.join(b.where("b1 IS NULL"), keys).where("b0 < a0")
    open_a = a.where("a1 IS NULL").join(b, keys).where("a0 < b0")
    cols = [*keys, "new_id", "obs_id"]
    return closed.select(*cols).unionByName(open_b.select(*cols)).unionByName(open_a.select(*cols))


def slew_feasibility(schedule: DataFrame, keys: Sequence[str] = ("station",), bucket_s: int = 30 * 86400) -> DataFrame:
    """Time needed to move between consecutive observations and whether the gap allows it."""
    from skysieve.functions.units import slew_seconds
    from skysieve.operators.sequences import previous

    b = schedule.withColumn("_bucket", F.floor(F.col("start_s") / bucket_s))
    p = previous(b, list(keys), ["start_s", "obs_id"], "_bucket", {"_pd": "declination", "_pe": "end_s"}).drop("_bucket")
    return p.withColumn("slew_s", slew_seconds(F.col("declination") - F.col("_pd"))).withColumn(
        "feasible", F.coalesce(F.col("start_s") - F.col("_pe") >= F.col("slew_s"), F.lit(True))).drop("_pd", "_pe")

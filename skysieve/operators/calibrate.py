"""Antenna gain solutions, geometric phases and calibration look-ups."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from skysieve.functions.cplx import cabs, carg, cdiv, cmul, cmul_conj
from skysieve.functions.units import antenna_label, to_db
from skysieve.operators.sequences import small


def geometric_phase(gains: DataFrame, weights: DataFrame, remove: bool, divide: bool = False) -> DataFrame:
    """Gains times steering weights (add) or times their conjugate (remove).

    ``divide`` gives the older removal by complex division.
    """
    w = small(weights.select("ant", F.col("re").alias("w_re"), F.col("im").alias("w_im")))
    op = cdiv if (remove and divide) else cmul_conj if remove else cmul
    re, im = op("re", "im", "w_re", "w_im")
    return gains.join(w, "ant").withColumn("_re", re).withColumn("im", im).withColumn(
        "re", F.col("_re")).drop("_re", "w_re", "w_im")


def _both_ends(vis: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """Each pair value listed once for either antenna."""
    return vis.select(*keys, value.alias("_v"), F.explode(F.array("ant1", "ant2")).alias("ant"))


def _reset_outliers(gains: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Values beyond two population standard deviations of the solution become 1."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    m, s = F.avg(column).over(w), F.stddev_pop(column).over(w)
    return gains.withColumn("_o", F.abs(F.col(column) - m) > 2 * s)


def solve_gain_amplitudes(vis: DataFrame, n_ants: int, keys: Sequence[str] = ("t_idx",)) -> DataFrame:
    """Log-linear amplitude solution of a complete pair set, in closed form.

    With S_i the sum of the log amplitudes of pairs touching antenna i and B the sum over all
    pairs, x_i = (S_i - B / (n - 1)) / (n - 2); the gain is 10^x, and outliers become 1.  A
    solution that lacks a pair, or has one without a positive real part, has null gains.
    """
    keys = list(keys)
    ends = _both_ends(vis, keys, F.log(F.when(F.col("re") > 0, F.col("re"))))
    s = ends.groupBy(*keys, "ant").agg(F.sum("_v").alias("_s"), F.count("_v").alias("_n"))
    # a solution has one row per antenna: the window below is bounded by the array size
    w = Window.partitionBy(*keys)
    x = (F.col("_s") - F.sum("_s").over(w) / 2 / (n_ants - 1)) / (n_ants - 2)
    complete = (F.min("_n").over(w) == n_ants - 1) & (F.count(F.lit(1)).over(w) == n_ants)
    g = s.withColumn("gain", F.when(complete, F.pow(F.lit(10.0), x)))
    out = _reset_outliers(g, keys, "gain")
    return out.select(*keys, "ant", F.when(F.col("_o"), F.lit(1.0)).otherwise(F.col("gain")).alias("gain"))


def solve_reference_phases(vis: DataFrame, keys: Sequence[str] = ("t_idx",), reference: int = 0) -> DataFrame:
    """Coefficients from the pairs of one reference antenna: conj(max V / V), outliers reset.

    Complex values are ordered by real part, then imaginary part.
    """
    keys = list(keys)
    top = vis.groupBy(*keys).agg(F.max(F.struct("re", "im")).alias("_top"))
    base = vis.where((F.col("ant1") == reference) | (F.col("ant2") == reference)).join(top, keys)
    qre, qim = cdiv(F.col("_top.re"), F.col("_top.im"), F.col("re"), F.col("im"))
    other = F.when(F.col("ant1") == reference, F.col("ant2")).otherwise(F.col("ant1"))
    flip = F.when(F.col("ant2") == reference, F.lit(1.0)).otherwise(F.lit(-1.0))
    solved = base.select(*keys, other.alias("ant"), qre.alias("re"), (qim * flip).alias("im"))
    ref = top.select(*keys, F.lit(reference).alias("ant"), F.lit(1.0).alias("re"), F.lit(0.0).alias("im"))
    allg = solved.unionByName(ref)
    w = Window.partitionBy(*keys)
    mre, mim = F.avg("re").over(w), F.avg("im").over(w)
    sd = F.sqrt(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im")).over(w) - mre * mre - mim * mim)
    here = F.struct(F.col("re"), F.col("im"))
    low, high = F.struct((mre - 2 * sd).alias("re"), mim.alias("im")), F.struct(
        (mre + 2 * sd).alias("re"), mim.alias("im"))
    out = allg.withColumn("_o", (low > here) | (high < here))
    return out.select(*keys, "ant", F.when(F.col("_o"), F.lit(1.0)).otherwise(F.col("re")).alias("re"),
                      F.when(F.col("_o"), F.lit(0.0)).otherwise(F.col("im")).alias("im"))


def solve_gains(vis: DataFrame, n_ants: int, keys: Sequence[str] = ("t_idx",),
                max_iterations: int = 800, tolerance: float = 1e-20) -> DataFrame:
    """Iterative gain solution per snapshot (alternating per-antenna least squares).

    Pair sums of one snapshot become one array row; a task then solves its whole batch of
    snapshots together.  A group is one snapshot, bounded by the array size.  Pairs that are
    missing stay out of the equations; an antenna without any pair has a gain of zero.
    """
    keys = list(keys)
    cells = F.array_sort(F.collect_list(F.struct("ant1", "ant2", "re", "im")))
    snap = vis.groupBy(*keys).agg(cells.alias("_c")).select(*keys, *[F.col(f"_c.{c}").alias(c) for c in ("ant1", "ant2", "re", "im")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            m, known = np.zeros((len(b), n_ants, n_ants), dtype=complex), np.zeros((len(b), n_ants, n_ants))
            at = np.repeat(np.arange(len(b)), [len(x) for x in b["re"]])
            p, q, re, im = (np.concatenate(b[c].to_list()) for c in ("ant1", "ant2", "re", "im"))
            m[at, p, q], known[at, p, q] = re + 1j * im, 1.0
            m += m.conj().transpose(0, 2, 1)
            known += known.transpose(0, 2, 1)
            g = _alternate(m, known, max_iterations, tolerance)
            inv = np.divide(1, g, out=np.zeros_like(g), where=g != 0)
            out = b[keys].loc[b.index.repeat(n_ants)].reset_index(drop=True)
            out["ant"] = np.tile(np.arange(n_ants, dtype="int32"), len(b))
            out["re"], out["im"] = inv.real.ravel(), inv.imag.ravel()
            yield out

    fields = [vis.schema[k] for k in keys] + [
        T.StructField("ant", T.IntegerType()), T.StructField("re", T.DoubleType()),
        T.StructField("im", T.DoubleType())]
    return snap.mapInPandas(run, T.StructType(fields))


def _alternate(m: np.ndarray, known: np.ndarray, max_iterations: int, tolerance: float) -> np.ndarray:
    """Fixed point of g_p = <m_p, g> / |g|^2 over the known pairs of p, for a batch of matrices.

    Even steps are averaged with the step before; a snapshot stops once its relative change
    falls below the tolerance, and its result is the iterate before the last.
    """
    g = np.ones(m.shape[:2], dtype=complex)
    result, active = g.copy(), np.ones(len(m), dtype=bool)
    for i in range(1, max_iterations):
        denom = np.einsum("kpq,kq->kp", known, np.abs(g) ** 2)
        numer = np.einsum("kqp,kq->kp", m.conj(), g)
        new = np.divide(numer, denom, out=np.zeros_like(g), where=denom != 0)
        result[active] = g[active]
        if i % 2 == 0:
            size = np.linalg.norm(new, axis=1)
            change = np.divide(np.linalg.norm(new - g, axis=1), size, out=np.zeros_like(size), where=size > 0)
            active &= change >= tolerance
            if not active.any():
                break
            new = (new + g) / 2
        g = new
    return result


def gain_statistics(gains: DataFrame) -> DataFrame:
    """Amplitude, dB, phase, label and deviation from the antenna mean over calibrations."""
    amp, phase = cabs("re", "im"), F.degrees(carg("re", "im"))
    df = gains.withColumn("amplitude", amp).withColumn("phase", phase)
    mean = df.groupBy("ant").agg(F.avg("amplitude").alias("_ma"), F.avg("phase").alias("_mp"))
    return (
        df.join(small(mean), "ant")
        .withColumn("amplitude_db", to_db("amplitude"))
        .withColumn("antenna_id", antenna_label("ant"))
        .withColumn("d_amplitude", F.col("amplitude") - F.col("_ma"))
        .withColumn("d_phase", F.col("phase") - F.col("_mp"))
        .drop("_ma", "_mp")
    )


def latest_calibration(observations: DataFrame, calibrations: DataFrame, keys: Sequence[str],
                       bucket_days: int = 30) -> DataFrame:
    """As-of look-up: the newest calibration started at or before each observation.

    ``observations(keys, obs_id, t)`` and ``calibrations(keys, calib_id, t, created)``, times
    as whole seconds.  Ties on time go to the calibration created first.  Time is cut into
    buckets; inside a bucket both kinds of row are sorted together, and the newest
    calibration of earlier buckets comes from one summary row per bucket.
    """
    keys, width = list(keys), bucket_days * 86400
    best = F.struct(F.col("t").alias("ct"), (-F.col("created")).alias("nc"), (-F.col("calib_id")).alias("ni"))
    c = calibrations.select(*keys, "t", best.alias("c"))
    o = observations.select(*keys, "t", "obs_id")
    rows = (
        c.select(*keys, "t", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("obs_id"), "c")
        .unionByName(o.select(*keys, "t", F.lit(1).alias("kind"), "obs_id",
                              F.lit(None).cast(c.schema["c"].dataType).alias("c")))
        .withColumn("_b", F.floor(F.col("t") / width))
    )
    carry = rows.groupBy(*keys, "_b").agg(F.max("c").alias("_m"))
    w0 = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = carry.withColumn("_prev", F.max("_m").over(w0)).drop("_m")
    w1 = Window.partitionBy(*keys, "_b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_in", F.max("c").over(w1)).where("kind = 1").join(carry, [*keys, "_b"])
    pick = F.coalesce("_in", "_prev")
    return found.select(*keys, "obs_id", "t", (-pick.getField("ni")).alias("calib_id"),
                        pick.getField("ct").alias("calib_t"))


def match_calibrator(pointings: DataFrame, sources: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Calibrator within ``tolerance`` degrees of the declination, first in list order.

    ``sources(source_id, name, dec)``.  Declinations fall into cells as wide as the
    tolerance; each source is listed in its own and the two neighbouring cells, so the band
    join is an equality join.  No match gives a null name.
    """
    s = sources.withColumn("_cell", F.explode(F.sequence(
        F.floor(F.col("dec") / tolerance) - 1, F.floor(F.col("dec") / tolerance) + 1)))
    p = pointings.withColumn("_cell", F.floor(F.col("declination") / tolerance))
    hits = p.join(small(s), "_cell").where(F.abs(F.col("declination") - F.col("dec")) < tolerance)
    cols = pointings.columns
    first = hits.groupBy(*cols).agg(F.min(F.struct("source_id", "name")).alias("_s"))
    return pointings.join(first, cols, "left").select(
        *cols, F.col("_s.source_id").alias("source_id"), F.col("_s.name").alias("source"),
        F.col("_s").isNull().alias("failed"))


# Source keys looked for in observation names, in order.
SOURCE_KEYS = ("cas", "cyg", "tau", "vir")


def source_of(name, source_keys=SOURCE_KEYS) -> Column:
    """Key of the calibrator named in an observation name; null when none is."""
    text = F.lower(F.col(name) if isinstance(name, str) else name)
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in source_keys])


def calibrator_windows(requests: DataFrame, transits: DataFrame, before_s: int, after_s: int,
                       bucket_s: int = 86400) -> DataFrame:
    """Transits that fall strictly inside (from + before, to - after) of a request.

    ``requests(request_id, from_s, to_s)``, ``transits(source, transit_s)``.  Per source the
    latest transit before the end is the candidate.  Requests are listed once per day they
    touch.  Of the days before the last one only the latest transit of each source counts; on the
    last day requests and transits are put in order of time, and the transit before a request's end
    is the answer, so the work does not grow with the transits of a day.
    """
    r = requests.withColumn("_lo", F.col("from_s") + before_s).withColumn("_hi", F.col("to_s") - after_s).where("_lo < _hi")
    last = F.floor(F.col("_hi") / bucket_s)
    t = transits.where("transit_s IS NOT NULL").select("source", "transit_s", F.floor(F.col("transit_s") / bucket_s).alias("_day")).distinct()
    days = t.groupBy("source", "_day").agg(F.max("transit_s").alias("transit_s"))
    earlier = r.withColumn("_day", F.explode(F.filter(F.sequence(F.floor(F.col("_lo") / bucket_s), last), lambda d: d < last))).join(
        days, "_day").select("request_id", "source", "_lo", "transit_s")
    ends = r.withColumn("_day", last).join(days.select("source", "_day"), "_day").select(
        "source", "_day", F.col("_hi").alias("_at"), F.lit(False).alias("_transit"), "request_id", "_lo", F.lit(None).cast(
            t.schema["transit_s"].dataType).alias("transit_s"))
    seen = t.select("source", "_day", F.col("transit_s").alias("_at"), F.lit(True).alias("_transit"), *[
        F.lit(None).cast(r.schema[c].dataType).alias(c) for c in ("request_id", "_lo")], "transit_s")
    # at the same second the request comes first: a transit must lie before the end
    order = Window.partitionBy("source", "_day").orderBy("_at", "_transit").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ends.unionByName(seen).withColumn("transit_s", F.last("transit_s", ignorenulls=True).over(order)).where(
        "NOT _transit").select("request_id", "source", "_lo", "transit_s")
    return earlier.unionByName(before).where("transit_s > _lo").groupBy("request_id", "source").agg(F.max("transit_s").alias("transit_s"))

"""Detections, tracks, association, messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import add_view, query
from skysieve.checks.signal import r, rounded
from skysieve.functions import regression as rg, units
from skysieve.operators import association as an, monitor as mo, noise as nz, tdm, tracks as tr
from skysieve.operators.streaks import CHANNEL_HZ, SAMPLING_TIME

TX = 410.0

add_view("vx_points", """
    SELECT *, CAST(FLOOR(time_sample / 160) AS BIGINT) AS iter, 410e0 + channel_sample * 0.00001e0 AS channel
    FROM fx_detections""", ["fx_detections"])
add_view("vx_beam_info", """
    SELECT beam_id, beam_id * 1.5e0 AS az, 45 + beam_id * 0.25e0 AS el, COUNT(*) / 8e0 AS beam_noise
    FROM fx_detections GROUP BY beam_id""", ["fx_detections"])
add_view("vx_best", """
    SELECT * FROM vx_points QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id, time_sample, beam_id
                                                       ORDER BY snr DESC, event_id) = 1""", ["vx_points"])
# clusters: per track, beam group and block
add_view("vx_cluster_points", """
    SELECT track_id, event_id % 4 AS beam_id, time_sample, channel_sample, snr, event_id,
           CAST(FLOOR(time_sample / 160) AS BIGINT) AS iter,
           CAST(FLOOR(time_sample / 160) * 4 + event_id % 4 AS BIGINT) AS cluster_id FROM fx_detections""", ["fx_detections"])
_KEY = ["track_id", "iter", "beam_id", "cluster_id"]


@query("w4_best_snr", "vx_points", """
    SELECT track_id, time_sample, beam_id, channel_sample, snr, event_id FROM vx_best""", "vx_best")
def _(p):
    return tr.best_detections(p).select("track_id", "time_sample", "beam_id", "channel_sample", "snr", "event_id")


@query("w4_best_snr_two_pass", "vx_points", """
    SELECT track_id, channel_sample, beam_id, time_sample, snr, event_id FROM vx_best
    QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id, channel_sample, beam_id ORDER BY snr DESC, event_id) = 1""", "vx_best")
def _(p):
    b = tr.best_detections(tr.best_detections(p), ["track_id", "channel_sample", "beam_id"])
    return b.select("track_id", "channel_sample", "beam_id", "time_sample", "snr", "event_id")


@query("a10_linear_fit", "vx_points", """
    SELECT track_id, COUNT(*) AS n, ROUND(REGR_SLOPE(channel_sample, time_sample), 5) AS slope,
           ROUND(REGR_INTERCEPT(channel_sample, time_sample), 4) AS intercept,
           ROUND(CORR(channel_sample, time_sample), 6) AS r,
           ROUND(SQRT((1 - POWER(CORR(channel_sample, time_sample), 2)) * VAR_POP(channel_sample)
                 / VAR_POP(time_sample) / (COUNT(*) - 2)), 6) AS stderr
    FROM vx_points GROUP BY 1 HAVING COUNT(*) > 2""")
def _(p):
    f = tr.fits(p).where("n > 2")
    return rounded(rounded(rounded(f, "slope"), "intercept", 4), "r stderr", 6).select("track_id", "n", "slope", "intercept", "r", "stderr")


@query("a11_pearson_gate", "vx_points", """
    WITH s AS (SELECT track_id, time_sample // 48 AS span, COUNT(*) AS n, CORR(channel_sample, time_sample) AS r
               FROM vx_points GROUP BY 1, 2)
    SELECT track_id, span, n, ROUND(r, 6) AS r, (n = 3 AND 1 - 2 * ASIN(LEAST(ABS(r), 1)) / PI() <= 0.05)
        OR (n = 4 AND 1 - ABS(r) <= 0.05) OR (n >= 5 AND ABS(r) >= 0.9) AS passes
    FROM s WHERE n >= 3 AND r IS NOT NULL AND NOT ISNAN(r)""")
def _(p):
    f = tr.fits(p.withColumn("span", F.floor(F.col("time_sample") / 48)), ["track_id", "span"]).where("n >= 3 AND r IS NOT NULL")
    return f.select("track_id", "span", "n", r("r", 6).alias("r"), rg.p_value_gate("n", "r", 0.05, 0.9).alias("passes"))


@query("a12_missing_scores", "vx_points", """
    SELECT track_id, ROUND((MAX(time_sample) - MIN(time_sample) + 1 - COUNT(DISTINCT time_sample)) / COUNT(*), 6) AS closed,
           ROUND((MAX(time_sample) - MIN(time_sample) - (COUNT(DISTINCT time_sample) - 1) + 1) / COUNT(*), 6) AS half_open
    FROM vx_points GROUP BY 1""")
def _(p):
    g = p.groupBy("track_id").agg(F.min("time_sample").alias("lo"), F.max("time_sample").alias("hi"),
                                  F.count_distinct("time_sample").alias("d"), F.count("*").alias("n"))
    return g.select("track_id", r(rg.missing_score_closed("lo", "hi", "d", "n"), 6).alias("closed"),
                    r(rg.missing_score_open("lo", "hi", "d", "n"), 6).alias("half_open"))


@query("u3_missing_samples", "vx_points", """
    SELECT b.track_id, t.v AS time_sample FROM (SELECT track_id, MIN(time_sample) AS lo, MAX(time_sample) AS hi FROM vx_points GROUP BY 1) b,
      LATERAL (SELECT UNNEST(RANGE(b.lo, b.hi + 1)) AS v) t
    WHERE NOT EXISTS (SELECT 1 FROM vx_points p WHERE p.track_id = b.track_id AND p.time_sample = t.v)""")
def _(p):
    """The samples of the full range that a track does not have."""
    ends = p.groupBy("track_id").agg(F.min("time_sample").alias("lo"), F.max("time_sample").alias("hi"))
    full = ends.select("track_id", F.explode(F.sequence("lo", "hi")).alias("time_sample"))
    return full.join(p.select("track_id", "time_sample"), ["track_id", "time_sample"], "left_anti")


@query("a13_track_summary", "vx_points", """
    SELECT track_id, COUNT(*) AS n, COUNT(DISTINCT time_sample) AS track_size, COUNT(DISTINCT channel_sample) AS n_channels,
           COUNT(DISTINCT beam_id) AS activated_beams, MIN(time_sample) AS first_sample, MAX(time_sample) AS last_sample,
           ROUND(AVG(snr), 5) AS mean_snr, MAX(snr) AS psnr, ROUND(REGR_SLOPE(channel_sample, time_sample), 5) AS gradient,
           ROUND(CORR(channel_sample, time_sample), 6) AS r,
           ROUND((MAX(time_sample) - MIN(time_sample) - (COUNT(DISTINCT time_sample) - 1) + 1) / COUNT(*), 6) AS missing
    FROM vx_points GROUP BY 1""")
def _(p):
    return rounded(rounded(tr.summary(p), "mean_snr gradient"), "r missing", 6).drop("intercept")


@query("a14_beam_size", "vx_points", """
    SELECT track_id, COUNT(DISTINCT v) AS beam_size FROM (
      SELECT track_id, beam_id AS v FROM vx_points UNION ALL SELECT track_id, time_sample FROM vx_points) GROUP BY 1""")
def _(p):
    return tr.beam_size(p)


@query("w9_middle_row", "vx_points", """
    SELECT track_id, event_id, time_sample, ROUND((channel - 410) * 1e6, 4) AS doppler FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY time_sample, event_id) - 1 AS k,
             COUNT(*) OVER (PARTITION BY track_id) AS n FROM vx_points) WHERE k = FLOOR(n / 2)""")
def _(p):
    m = tr.middle_row(p, bucket=64)
    return m.select("track_id", "event_id", "time_sample", r(units.doppler_hz("channel", F.lit(TX)), 4).alias("doppler"))


_SUMMARY = """
    WITH s AS (SELECT track_id, COUNT(*) AS n, COUNT(DISTINCT time_sample) AS ts, COUNT(DISTINCT channel_sample) AS nc,
      COUNT(DISTINCT beam_id) AS nb, CORR(channel_sample, time_sample) AS r, REGR_SLOPE(channel_sample, time_sample) AS m,
      (MAX(time_sample) - MIN(time_sample) - (COUNT(DISTINCT time_sample) - 1) + 1) / COUNT(*) AS miss, MAX(time_sample) AS last
      FROM vx_points GROUP BY 1),
    v AS (SELECT *, CASE WHEN nb > 60 THEN NULL WHEN nb < 1 THEN 'beams'
      WHEN nc < 5 OR ts < 5 THEN 'samples' WHEN r IS NULL OR ISNAN(r) OR ABS(r) < 0.99 THEN 'linearity'
      WHEN NOT m BETWEEN -0.51 AND -0.49 THEN 'gradient' WHEN miss > 9 THEN 'missing' END AS reason FROM s)"""


def judged(p):
    return tr.validity(tr.summary(p), 0.99, (-0.49, -0.51), 9.0, 5, 60)


@query("p19_track_validity", "vx_points", _SUMMARY + " SELECT track_id, reason, reason IS NULL AS valid FROM v")
def _(p):
    return judged(p).select("track_id", "reason", "valid")


@query("p20_association_gate", "vx_cluster_points", """
    WITH s AS (SELECT track_id, iter, COUNT(*) AS n, CORR(channel_sample, time_sample) AS r, REGR_SLOPE(channel_sample, time_sample) AS m,
      (MAX(time_sample) - MIN(time_sample) - (COUNT(DISTINCT time_sample) - 1) + 1) / COUNT(*) AS miss FROM vx_cluster_points GROUP BY 1, 2)
    SELECT track_id, iter, n, ROUND(r, 6) AS r FROM s WHERE miss <= 20 AND r <= -0.99 AND m BETWEEN -0.52 AND -0.45
      AND (n >= 5 OR (n = 4 AND 1 - ABS(r) <= 0.01) OR (n = 3 AND 1 - 2 * ASIN(LEAST(ABS(r), 1)) / PI() <= 0.01))""")
def _(p):
    s = tr.summary(p.withColumn("snr", F.lit(0.0)), ["track_id", "iter"])
    ok = s.where(tr.acceptance("n", "r", "gradient", "missing", (-0.45, -0.52), 20.0))
    return ok.select("track_id", "iter", "n", r("r", 6).alias("r"))


@query("p21_post_validity", "vx_points", """
    SELECT track_id, COUNT(DISTINCT time_sample) AS n_samples, COUNT(DISTINCT beam_id) AS n_beams,
           COUNT(DISTINCT time_sample) >= 70 AND COUNT(DISTINCT beam_id) >= 28 AS is_valid FROM vx_best GROUP BY 1""", "vx_best")
def _(p):
    return tr.post_validity(tr.best_detections(p), min_samples=70, min_beams=28)


@query("c16_life_cycle", "vx_points", _SUMMARY + """
    SELECT track_id, CASE WHEN reason IS NOT NULL THEN 'cancelled' WHEN 640 > last + 3 THEN 'terminated' ELSE 'pending' END AS status FROM v""")
def _(p):
    t = judged(p).withColumn("block_end", F.lit(640.0))
    return tr.life_cycle(t, "block_end", "last_sample").select("track_id", "status")


@query("u4_status_split", "vx_points", _SUMMARY + """,
    c AS (SELECT CASE WHEN reason IS NOT NULL THEN 'cancelled' WHEN 640 > last + 3 THEN 'terminated' ELSE 'pending' END AS status FROM v)
    SELECT status, COUNT(*) AS n FROM c GROUP BY 1""")
def _(p):
    return tr.status_split(tr.life_cycle(judged(p).withColumn("block_end", F.lit(640.0)), "block_end", "last_sample"))


@query("j17_left_active_set", "vx_points", """
    SELECT DISTINCT track_id, iter FROM vx_points a WHERE NOT EXISTS (
      SELECT 1 FROM vx_points b WHERE b.track_id = a.track_id AND b.iter = a.iter + 1)""")
def _(p):
    """Tracks seen in a block and not in the next one."""
    seen = p.select("track_id", "iter").distinct()
    nxt = seen.withColumn("iter", F.col("iter") - 1)
    return tr.left_active_set(seen, nxt, ["track_id", "iter"])


@query("w11_growth_notices", "vx_points", """
    WITH g AS (SELECT track_id, iter, SUM(COUNT(DISTINCT time_sample)) OVER (PARTITION BY track_id ORDER BY iter) AS sz
               FROM vx_points GROUP BY 1, 2),
    l AS (SELECT *, LAG(sz) OVER (PARTITION BY track_id ORDER BY iter) AS b FROM g)
    SELECT track_id, iter, CAST(sz AS BIGINT) AS track_size, CASE WHEN b IS NULL THEN 'created' ELSE 'modified' END AS notice
    FROM l WHERE b IS NULL OR (sz - b) / sz > 0.10""")
def _(p):
    from skysieve.operators.sequences import running
    g = p.groupBy("track_id", "iter").agg(F.count_distinct("time_sample").alias("_d")).withColumn(
        "_bucket", F.floor(F.col("iter") / 64))
    g = running(g, ["track_id"], ["iter"], "_bucket", F.col("_d"), "track_size").select("track_id", "iter", "track_size")
    return tr.growth_notices(g)


@query("x6_sessions", "vx_points", """
    WITH d AS (SELECT DISTINCT track_id, time_sample FROM vx_points),
    l AS (SELECT *, CASE WHEN time_sample - LAG(time_sample) OVER w < 3 THEN 0 ELSE 1 END AS f FROM d
          WINDOW w AS (PARTITION BY track_id ORDER BY time_sample)),
    s AS (SELECT *, SUM(f) OVER (PARTITION BY track_id ORDER BY time_sample) AS session_no FROM l)
    SELECT s.track_id, CAST(session_no AS BIGINT) AS session_no, MIN(s.time_sample) AS start_s, MAX(s.time_sample) AS end_s,
           COUNT(*) AS n FROM s JOIN vx_points p ON p.track_id = s.track_id AND p.time_sample = s.time_sample GROUP BY 1, 2""")
def _(p):
    return tr.sessions(p, ["track_id"], "time_sample", 3, 100)


@query("x6_session_window", "vx_points", """
    WITH l AS (SELECT *, CASE WHEN time - LAG(time) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM vx_points
          WINDOW w AS (PARTITION BY track_id ORDER BY time)),
    s AS (SELECT *, SUM(f) OVER (PARTITION BY track_id ORDER BY time) AS session_no FROM l)
    SELECT track_id, COUNT(*) AS n, MAX(snr) AS psnr FROM s GROUP BY track_id, session_no""")
def _(p):
    """The same as a time session window; it runs unchanged on a stream."""
    ts = p.withColumn("time", F.col("time").cast("timestamp"))
    return ts.groupBy("track_id", F.session_window("time", "6 hours")).agg(
        F.count("*").alias("n"), F.max("snr").alias("psnr")).drop("session_window")


add_view("vx_cluster_best", """
    SELECT * FROM vx_cluster_points QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id, cluster_id, iter, time_sample, beam_id
                                                               ORDER BY snr DESC, event_id) = 1""", ["vx_cluster_points"])
add_view("vx_clusters", """
    SELECT track_id, iter, beam_id, cluster_id, COUNT(*) AS n, SUM(time_sample) AS sx, SUM(channel_sample) AS sy,
      SUM(time_sample * time_sample) AS sxx, SUM(time_sample * channel_sample) AS sxy,
      (COUNT(*) * SUM(time_sample * channel_sample) - SUM(time_sample) * SUM(channel_sample))
        / NULLIF(COUNT(*) * SUM(time_sample * time_sample) - SUM(time_sample) * SUM(time_sample), 0) AS slope
    FROM vx_cluster_best GROUP BY 1, 2, 3, 4""", ["vx_cluster_best"])
_PAIRS = """
    c AS (SELECT *, (sy - slope * sx) / n AS icpt FROM vx_clusters WHERE slope IS NOT NULL AND slope <> 0),
    m AS (SELECT a.track_id, a.cluster_id AS src, b.cluster_id AS dst, a.slope AS s1, b.slope AS s2, a.icpt AS i1, b.icpt AS i2,
            a.n + b.n AS n, a.sx + b.sx AS sx, a.sy + b.sy AS sy,
            ((a.n + b.n) * (a.sxy + b.sxy) - (a.sx + b.sx) * (a.sy + b.sy))
              / ((a.n + b.n) * (a.sxx + b.sxx) - (a.sx + b.sx) * (a.sx + b.sx)) AS s3
          FROM c a JOIN c b ON a.track_id = b.track_id AND b.iter - a.iter IN (0, 1)
           AND (a.iter < b.iter OR a.cluster_id < b.cluster_id)),
    m2 AS (SELECT *, (sy - s3 * sx) / n AS i3 FROM m),
    e AS (SELECT * FROM m2 WHERE STDDEV_3(s1, s2, s3) < 0.1 AND STDDEV_3(i1, i2, i3) < 0.1 AND s3 BETWEEN -0.6 AND -0.4)"""


def _cv(a, b, c):
    mu = f"(({a} + {b} + {c}) / 3)"
    return f"(SQRT((({a} - {mu}) * ({a} - {mu}) + ({b} - {mu}) * ({b} - {mu}) + ({c} - {mu}) * ({c} - {mu})) / 3) / ABS({mu}))"


_PAIRS = _PAIRS.replace("STDDEV_3(s1, s2, s3)", _cv("s1", "s2", "s3")).replace("STDDEV_3(i1, i2, i3)", _cv("i1", "i2", "i3"))


def cluster_rows(p):
    return tr.cluster_table(p, _KEY, 1.0, 1.0)


@query("j11_similar_pairs", "vx_cluster_points", "WITH " + _PAIRS + """
    SELECT track_id, src, dst, ROUND(s3, 5) AS slope, ROUND(i3, 3) AS intercept FROM e""", "vx_clusters")
def _(p):
    e = tr.similar_pairs(cluster_rows(p), ["track_id"], "cluster_id", gradient=(-0.4, -0.6))
    return rounded(rounded(e, "slope"), "intercept", 3)


@query("c17_batch_association", "vx_cluster_points", "WITH RECURSIVE " + _PAIRS + """,
    sym AS (SELECT track_id, src, dst FROM e UNION ALL SELECT track_id, dst, src FROM e),
    cc(track_id, p, comp) USING KEY (track_id, p) AS (
      SELECT track_id, cluster_id, cluster_id FROM vx_clusters WHERE slope IS NOT NULL
      UNION
      SELECT s.track_id, s.dst, MIN(cc.comp) FROM cc JOIN sym s ON cc.track_id = s.track_id AND s.src = cc.p
      JOIN recurring.cc cur ON cur.track_id = s.track_id AND cur.p = s.dst WHERE cc.comp < cur.comp GROUP BY s.track_id, s.dst)
    SELECT track_id, p AS cluster_id, comp AS track FROM cc""", "vx_clusters")
def _(p):
    from skysieve.session import cut
    return tr.associate(cut(cluster_rows(p)), ["track_id"], "cluster_id", gradient=(-0.4, -0.6)).select(
        "track_id", "cluster_id", "track")


# --- first match, by recursion over the clusters of an observation in order; a step extends all observations by a cluster
LIMITS = {"gradient": (-0.4, -0.6), "linearity": 0.9, "expiry_s": 60.0, "merge_missing": 40.0, "valid_missing": 40.0}


def _fit(p: str, q: str = "", x: str = "") -> tuple[str, str]:
    """Slope and intercept from sums with prefix ``x`` of ``p``, or of ``p`` and ``q`` together."""
    n, sx, sy, sxx, sxy = (f"({p}.{x}{c} + {q}.{x}{c})" if q else f"{p}.{x}{c}" for c in ("n", "sx", "sy", "sxx", "sxy"))
    slope = f"(({n} * {sxy} - {sx} * {sy}) / nullif({n} * {sxx} - {sx} * {sx}, 0))"
    return slope, f"(({sy} - {slope} * {sx}) / {n})"


def _r(p: str, q: str = "") -> str:
    n, sx, sy, sxx, sxy, syy = (f"({p}.{c} + {q}.{c})" if q else f"{p}.{c}" for c in ("n", "sx", "sy", "sxx", "sxy", "syy"))
    return f"(({n} * {sxy} - {sx} * {sy}) / nullif(sqrt(({n} * {sxx} - {sx} * {sx}) * ({n} * {syy} - {sy} * {sy})), 0))"


def _like(*v: str) -> str:
    mean = f"(({' + '.join(v)}) / 3)"
    return f"(abs(sqrt(({' + '.join(f'({x} - {mean}) * ({x} - {mean})' for x in v)}) / 3) / nullif({mean}, 0)) < 0.1)"


def _accepted(p: str, q: str = "") -> str:
    n = f"({p}.n + {q}.n)" if q else f"{p}.n"
    seen = f"len(list_distinct(list_concat({p}.ts, {q}.ts)))" if q else f"len({p}.ts)"
    lo, hi = (f"least({p}.t0, {q}.t0)", f"greatest({p}.t1, {q}.t1)") if q else (f"{p}.t0", f"{p}.t1")
    r, slope = _r(p, q), _fit(p, q)[0]
    return f"""coalesce({r} <= -0.99 AND ({n} >= 5 OR ({n} = 4 AND 1 - abs({r}) <= 0.01)
        OR ({n} = 3 AND 1 - 2 * asin(least(abs({r}), 1)) / pi() <= 0.01))
        AND {slope} BETWEEN -0.6 AND -0.4 AND ({hi} - {lo} - ({seen} - 1) + 1) / {n} <= 40, false)"""


def first_match_sql(final: str, out: str) -> str:
    """SQL over ``run``: tracks and events of all observations; ``final`` is the time after their last blocks."""
    sums = ("n", "sx", "sy", "sxx", "sxy", "syy", "bn", "bsx", "bsy", "bsxx", "bsxy")
    lists = ("ts", "cs", "bs")
    kind = (f"STRUCT(no BIGINT, status VARCHAR, seen BIGINT, t0 BIGINT, t1 BIGINT, {', '.join(f'{c} DOUBLE' for c in sums)}, "
            "ts BIGINT[], cs DOUBLE[], bs BIGINT[])")
    merged = ", ".join(["'no': t.no", "'status': t.status", "'seen': t.seen", "'t0': least(t.t0, c.t0)", "'t1': greatest(t.t1, c.t1)",
                        *[f"'{x}': t.{x} + c.{x}" for x in sums], *[f"'{x}': list_distinct(list_concat(t.{x}, c.{x}))" for x in lists]])
    fresh = ", ".join(["'no': CAST(len(tracks) AS BIGINT)", "'status': 'pending'", "'seen': CAST(0 AS BIGINT)", "'t0': c.t0", "'t1': c.t1",
                       *[f"'{x}': c.{x}" for x in (*sums, *lists)]])

    def changed(**new: str) -> str:
        return "{" + ", ".join(f"'{x}': {new.get(x, 't.' + x)}" for x in ("no", "status", "seen", "t0", "t1", *sums, *lists)) + "}"

    (s1, i1), (s2, i2), (s3, i3) = _fit("t", x="b"), _fit("c", x="b"), _fit("t", "c", x="b")
    fits = f"coalesce({_like(s1, s2, s3)} AND {_like(i1, i2, i3)} AND {s3} BETWEEN -0.6 AND -0.4, false) AND {_accepted('t', 'c')}"
    valid = f"""(len(t.bs) > 5 OR coalesce(len(t.cs) >= 5 AND len(t.ts) >= 5 AND abs({_r('t')}) >= 0.9
        AND {_fit('t')[0]} BETWEEN -0.6 AND -0.4 AND (t.t1 - t.t0 - (len(t.ts) - 1) + 1) / t.n <= 40, false))"""
    told = lambda event, status="t.status": (
        f"{{'no': t.no, 'status': {status}, 'n': CAST(t.n AS BIGINT), 't0': t.t0, 't1': t.t1, 'gradient': {_fit('t')[0]}, "
        f"'r': {_r('t')}, 'event': {event}}}")
    grown = "CASE WHEN t.seen = 0 THEN 'created' ELSE 'modified' END"
    event = ("STRUCT(no BIGINT, status VARCHAR, n BIGINT, t0 BIGINT, t1 BIGINT, gradient DOUBLE, r DOUBLE, event VARCHAR)")
    return f"""WITH RECURSIVE best AS (
          SELECT * FROM vx_cluster_points QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id, iter, beam_id, cluster_id, time_sample
            ORDER BY snr DESC, channel_sample) = 1),
        b AS (SELECT track_id, iter, beam_id, cluster_id, COUNT(*) AS bn, SUM(time_sample) AS bsx, SUM(channel_sample) AS bsy,
            SUM(time_sample * time_sample) AS bsxx, SUM(time_sample * channel_sample) AS bsxy FROM best GROUP BY ALL),
        a AS (SELECT track_id, iter, beam_id, cluster_id, COUNT(*) AS n, SUM(time_sample) AS sx, SUM(channel_sample) AS sy,
            SUM(time_sample * time_sample) AS sxx, SUM(time_sample * channel_sample) AS sxy, SUM(channel_sample * channel_sample) AS syy,
            list(DISTINCT time_sample) AS ts, list(DISTINCT channel_sample) AS cs, list(DISTINCT CAST(beam_id AS BIGINT)) AS bs,
            MIN(time_sample) AS t0, MAX(time_sample) AS t1 FROM vx_cluster_points GROUP BY track_id, iter, beam_id, cluster_id),
        k AS (SELECT *, ROW_NUMBER() OVER w AS k, LEAD(iter) OVER w AS nxt FROM a JOIN b USING (track_id, iter, beam_id, cluster_id)
            WINDOW w AS (PARTITION BY track_id ORDER BY iter, beam_id, t0, cluster_id)),
        run AS (
          SELECT DISTINCT track_id, CAST(0 AS BIGINT) AS k, CAST([] AS {kind}[]) AS tracks, CAST([] AS {event}[]) AS events FROM k
          UNION ALL
          SELECT track_id, k, CASE WHEN ended THEN list_transform(open, lambda t: {changed(
              status="CASE WHEN t.status = 'pending' AND after > t.t1 + 60 THEN 'terminated' ELSE t.status END",
              seen="CASE WHEN t.status = 'pending' THEN CAST(len(t.ts) AS BIGINT) ELSE t.seen END")}) ELSE open END AS tracks,
            CASE WHEN ended THEN list_concat(events, list_concat(closed, list_concat(
              list_transform(list_filter(open, lambda t: t.status = 'pending' AND (t.seen = 0 OR (len(t.ts) - t.seen) / len(t.ts) > 0.10)),
                lambda t: {told(grown)}),
              list_transform(list_filter(open, lambda t: t.status = 'pending' AND after > t.t1 + 60),
                lambda t: {told("'transit'", "'terminated'")})))) ELSE events END AS events
          FROM (SELECT track_id, k, ended, after, events, CASE WHEN ended THEN list_transform(taken, lambda t: {changed(
                  status=f"CASE WHEN t.status <> 'pending' THEN t.status WHEN NOT {valid} THEN 'cancelled' "
                         "WHEN block_end > t.t1 + 60 THEN 'terminated' ELSE 'pending' END")}) ELSE taken END AS open,
                CASE WHEN ended THEN list_transform(list_filter(taken, lambda t: t.status = 'pending' AND
                    (NOT {valid} OR block_end > t.t1 + 60)), lambda t: {told(
                      f"CASE WHEN NOT {valid} THEN 'deleted' ELSE 'transit' END",
                      f"CASE WHEN NOT {valid} THEN 'cancelled' ELSE 'terminated' END")}) END AS closed
            FROM (SELECT track_id, k, nxt IS NULL OR nxt <> iter AS ended, (iter + 1) * 160 AS block_end,
                  CASE WHEN nxt IS NULL THEN {final} ELSE nxt * 160 END AS after, events,
                  CASE WHEN hit IS NOT NULL THEN list_transform(tracks, lambda t: CASE WHEN t.no = hit THEN {{{merged}}} ELSE t END)
                       WHEN {_accepted('c')} THEN list_append(tracks, {{{fresh}}}) ELSE tracks END AS taken
              FROM (SELECT c, c.track_id, c.k, c.nxt, c.iter, run.tracks, run.events,
                    list_filter(run.tracks, lambda t: t.status = 'pending' AND {fits})[1].no AS hit
                    FROM run JOIN k AS c ON c.track_id = run.track_id AND c.k = run.k + 1)))),
        done AS (SELECT * FROM run QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY k DESC) = 1)
        {out}"""


@query("c15_first_match_association", "vx_cluster_points", first_match_sql("(iter + 1) * 160", f"""
    SELECT track_id, t.no AS track_no, t.status, CAST(t.n AS BIGINT) AS n, t.t0 AS first_sample, t.t1 AS last_sample,
           ROUND({_fit('t')[0]}, 5) AS gradient, ROUND({_r('t')}, 5) AS r
    FROM (SELECT track_id, UNNEST(tracks) AS t FROM done)"""))
def _(p):
    """Order-dependent association, folded by parts."""
    return rounded(an.associate_first_match(p, "track_id", 1.0, 1.0, **LIMITS), "gradient r", 5)


@query("c15_part_sizes", "vx_cluster_points", """
    SELECT track_id, COUNT(DISTINCT (iter, beam_id, cluster_id)) AS clusters FROM vx_cluster_points GROUP BY 1""")
def _(p):
    """Clusters of each observation, added up over the parts that are folded apart."""
    parts = an.association_parts(p, "track_id", an.Rules(1.0, 1.0, **LIMITS))
    return an.part_sizes(parts, "track_id").groupBy("track_id").agg(F.sum("clusters").alias("clusters"))


@query("c13_detections", "fx_streaks", """
    WITH b AS (SELECT iter, beam_id, AVG(power) AS bn FROM fx_streaks GROUP BY 1, 2)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.iter * 160 + p.time_idx AS time_sample,
           1700000000000000 + p.iter * 15339168 + CAST(FLOOR(CAST(p.time_idx AS BIGINT) * 95869805 / 1000) AS BIGINT) AS time_us,
           ROUND(410.0 + channel_sample * 0.00001043e0, 8) AS channel, ROUND(10 * LOG10(power / bn), 5) AS snr
    FROM fx_streaks p JOIN b ON p.iter = b.iter AND p.beam_id = b.beam_id""")
def _(p):
    noise = p.groupBy("iter", "beam_id").agg(F.avg("power").alias("beam_noise"))
    blocks = p.select("iter").distinct().withColumn("t0_us", F.lit(1700000000000000) + F.col("iter") * 15339168)
    d = tr.to_detections(p, noise, blocks, 410.0, 0.00001043, SAMPLING_TIME)
    return rounded(rounded(d, "channel", 8), "snr").select(
        "iter", "beam_id", "channel_sample", "time_idx", "time_sample", "time_us", "channel", "snr")


@query("c18_bounding_window", "vx_points", """
    SELECT track_id, CAST(FLOOR(MIN(time_sample) / 10) * 10 AS BIGINT) AS t_lo, CAST(CEIL(MAX(time_sample) / 10) * 10 AS BIGINT) AS t_hi,
           CAST(FLOOR(MIN(channel_sample) / 10) * 10 AS BIGINT) AS c_lo, CAST(CEIL(MAX(channel_sample) / 10) * 10 AS BIGINT) AS c_hi,
           ROUND(AVG(time_sample), 5) AS t_mean, ROUND(AVG(channel_sample), 5) AS c_mean FROM vx_points GROUP BY 1""")
def _(p):
    return rounded(tr.bounding_window(p), "t_mean c_mean")


@query("c20_track_profiles", "vx_points", """
    SELECT track_id, beam_id, time_sample, ROUND(AVG(snr), 5) AS snr, ROUND(AVG((channel - 410) * 1e6), 3) AS doppler
    FROM vx_points GROUP BY 1, 2, 3""")
def _(p):
    return p.groupBy("track_id", "beam_id", "time_sample").agg(
        r(F.avg("snr")).alias("snr"), r(F.avg(units.doppler_hz("channel", F.lit(TX))), 3).alias("doppler"))


_BEAMS = list(range(32))
_ILL = "WITH b AS (SELECT track_id AS obs_id, time_sample, " + ", ".join(
    f"MAX(snr) FILTER (beam_id = {b}) AS S{b}, ARG_MAX(channel_sample, (snr, -channel_sample)) FILTER (beam_id = {b}) AS C{b}"
    for b in _BEAMS) + """ FROM vx_points GROUP BY 1, 2),
    i AS (SELECT *, GREATEST(""" + ", ".join(f"S{b}" for b in _BEAMS) + """) AS max_snr FROM b),
    t AS (SELECT *, CAST(CASE """ + " ".join(f"WHEN S{b} = max_snr THEN {b}" for b in _BEAMS) + " END AS INT) AS max_beam FROM i)"


@query("j12_illumination", "vx_points", _ILL + " SELECT * FROM t")
def _(p):
    return mo.illumination(p.withColumnRenamed("track_id", "obs_id"), _BEAMS)


@query("w5_strongest_runs", "vx_points", _ILL + """,
    l AS (SELECT *, CASE WHEN max_beam = LAG(max_beam) OVER w THEN 0 ELSE 1 END AS f,
                 COALESCE(time_sample - LAG(time_sample) OVER w, 0) AS dt FROM t WHERE max_beam IS NOT NULL
          WINDOW w AS (PARTITION BY obs_id ORDER BY time_sample)),
    g AS (SELECT *, SUM(f) OVER (PARTITION BY obs_id ORDER BY time_sample) AS run_id FROM l),
    c AS (SELECT *, COUNT(*) OVER (PARTITION BY obs_id, run_id) AS consecutive FROM g)
    SELECT obs_id, time_sample, max_beam, CAST(run_id AS BIGINT) AS run_id, dt, consecutive FROM c WHERE consecutive > 1""")
def _(p):
    t = mo.illumination(p.withColumnRenamed("track_id", "obs_id"), _BEAMS).where("max_beam IS NOT NULL")
    return mo.strongest_runs(t, bucket=64).select("obs_id", "time_sample", "max_beam", "run_id", "dt", "consecutive")


@query("a28_first_per_beam", "vx_points", """
    SELECT beam_id, track_id, event_id, snr FROM vx_points
    QUALIFY ROW_NUMBER() OVER (PARTITION BY beam_id ORDER BY time_sample, event_id) = 1""")
def _(p):
    return mo.first_per(p, ["beam_id"], ["time_sample", "event_id"]).select("beam_id", "track_id", "event_id", "snr")


@query("t4_arg_max", "vx_points", """
    SELECT track_id, ARG_MAX(time_sample, (snr, -event_id)) AS t, ARG_MAX(beam_id, (snr, -event_id)) AS beam_id, MAX(snr) AS psnr
    FROM vx_points GROUP BY 1""")
def _(p):
    k = F.struct("snr", -F.col("event_id"))
    return p.groupBy("track_id").agg(F.max_by("time_sample", k).alias("t"), F.max_by("beam_id", k).alias("beam_id"),
                                     F.max("snr").alias("psnr"))


@query("t5_nearest", "vx_points", """
    SELECT track_id, ARG_MIN(channel_sample, (ABS(channel_sample - 450), channel_sample)) AS channel_sample FROM vx_points GROUP BY 1""")
def _(p):
    return mo.nearest(p, ["track_id"], "channel_sample", 450)


@query("u2_append_clusters", "vx_cluster_points", """
    SELECT track_id, COUNT(*) AS n FROM (SELECT * FROM vx_cluster_points WHERE iter < 2 UNION ALL
      SELECT * FROM vx_cluster_points WHERE iter >= 2) GROUP BY 1""")
def _(p):
    return p.where("iter < 2").unionByName(p.where("iter >= 2")).groupBy("track_id").agg(F.count("*").alias("n"))


@query("j15_channel_lookup", "vx_points vx_beam_info", """
    SELECT p.event_id, ROUND(410 + p.channel_sample * 0.00001e0, 8) AS frequency, b.az, b.el, b.beam_noise
    FROM vx_points p JOIN vx_beam_info b ON p.beam_id = b.beam_id""")
def _(p, b):
    from skysieve.operators.sequences import small
    return p.join(small(b), "beam_id").select(
        "event_id", r(F.lit(410.0) + F.col("channel_sample") * 0.00001, 8).alias("frequency"), "az", "el", "beam_noise")


@query("j15_track_counts", "fx_blocks vx_points", """
    SELECT b.obs_id, COUNT(DISTINCT p.track_id) AS n_tracks FROM fx_blocks b LEFT JOIN vx_points p ON p.time_sample = b.obs_id GROUP BY 1""")
def _(b, p):
    t = p.select(F.col("time_sample").alias("obs_id"), "track_id").distinct().groupBy("obs_id").agg(F.count("*").alias("n"))
    return b.select("obs_id").join(t, "obs_id", "left").select("obs_id", F.coalesce("n", F.lit(0)).alias("n_tracks"))


# --- messages ------------------------------------------------------------------------------
_T = "strftime(time, '%Y-%m-%dT%H:%M:%S.%f')"


@query("k5_tdm_lines", "vx_points vx_beam_info", f"""
    SELECT p.track_id, p.beam_id, p.time_sample, p.event_id, CAST(l.k AS INT) AS line_no, CASE l.k
      WHEN 0 THEN printf('ANGLE_1 = %s %.6f', {_T}, az) WHEN 1 THEN printf('ANGLE_2 = %s %.6f', {_T}, el)
      WHEN 2 THEN printf('PC_N0   = %s %.6f', {_T}, snr) WHEN 3 THEN printf('TRANSMIT_FREQ_3 = %s %.3f', {_T}, 410000000.0::DOUBLE)
      ELSE printf('RECEIVE_FREQ_1 = %s %.3f', {_T}, channel * 1e6) END AS line
    FROM vx_best p JOIN vx_beam_info b ON p.beam_id = b.beam_id, (SELECT UNNEST(RANGE(0, 5)) AS k) l""", "vx_best")
def _(p, b):
    return tdm.data_lines(tr.best_detections(p), b, TX)


@query("k5_tdm_message_sizes", "vx_points vx_beam_info", """
    WITH d AS (SELECT track_id, COUNT(*) AS n, COUNT(DISTINCT beam_id) AS nb FROM vx_best GROUP BY 1)
    SELECT track_id, CAST(4 + nb * 20 + 5 * n AS BIGINT) AS lines FROM d""", "vx_best")
def _(p, b):
    """Line count of every whole message."""
    m = tdm.messages(tr.best_detections(p), b, b, TX, "TARGET", SAMPLING_TIME, comments=("survey track",))
    return m.groupBy("track_id").agg(F.count("*").alias("lines"))


@query("k6_tdm_metadata", "vx_points vx_beam_info", f"""
    SELECT p.track_id, p.beam_id, strftime(MIN(time), '%Y-%m-%dT%H:%M:%S.%f') AS start_time,
           strftime(MAX(time), '%Y-%m-%dT%H:%M:%S.%f') AS stop_time, COUNT(*) AS n, MAX(beam_noise) AS beam_noise
    FROM vx_points p JOIN vx_beam_info b ON p.beam_id = b.beam_id GROUP BY 1, 2""")
def _(p, b):
    m = tdm.beam_metadata(p, b)
    return m.withColumn("start_time", F.date_format("start_time", tdm.TIME_FORMAT)).withColumn(
        "stop_time", F.date_format("stop_time", tdm.TIME_FORMAT))


@query("k7_track_summary_rows", "vx_points", """
    SELECT track_id, ROUND(ARG_MAX((channel - 410) * 1e6, (snr, -event_id)), 3) AS psnr_doppler,
           ARG_MAX(time_sample, (snr, -event_id)) AS psnr_sample, MAX(snr) AS psnr, ROUND(AVG(snr), 5) AS mean_snr,
           array_to_string(list_sort(list(DISTINCT beam_id)), ',') AS activated_beams, COUNT(*) AS n,
           ROUND(CORR(channel_sample, time_sample), 6) AS r_value, array_to_string(list_sort(list(DISTINCT iter)), ',') AS iterations
    FROM vx_points GROUP BY 1""")
def _(p):
    return rounded(rounded(rounded(tdm.track_summary(p, TX), "psnr_doppler", 3), "mean_snr"), "r_value", 6)


@query("k8_detection_csv", "vx_points", """
    SELECT printf('%d,%d,%d,%.1f,%.4f,%d', track_id, beam_id, time_sample, channel_sample, snr, event_id) AS line FROM vx_points""")
def _(p):
    from skysieve.sinks.tables import csv_lines
    return csv_lines(p, [("track_id", "%d"), ("beam_id", "%d"), ("time_sample", "%d"), ("channel_sample", "%.1f"),
                         ("snr", "%.4f"), ("event_id", "%d")])


@query("f3_snr", "fx_pixels", """
    WITH n AS (SELECT iter, beam_id, channel_sample, MEDIAN(power) AS noise FROM fx_pixels GROUP BY 1, 2, 3)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, ROUND(10 * LOG10(power / noise), 5) AS snr,
           ROUND(CASE WHEN power > noise THEN 10 * LOG10((power - noise) / noise) END, 5) AS snr_excess
    FROM fx_pixels p JOIN n ON p.iter = n.iter AND p.beam_id = n.beam_id AND p.channel_sample = n.channel_sample""")
def _(p):
    j = p.join(nz.channel_noise(p).select("iter", "beam_id", "channel_sample", "noise"), ["iter", "beam_id", "channel_sample"])
    return j.select("iter", "beam_id", "channel_sample", "time_idx", r(units.snr_db("power", "noise")).alias("snr"),
                    r(units.snr_excess_db("power", "noise")).alias("snr_excess"))


@query("f4_doppler", "vx_points", "SELECT event_id, ROUND((channel - 410) * 1e6, 3) AS doppler FROM vx_points")
def _(p):
    return p.select("event_id", r(units.doppler_hz("channel", F.lit(TX)), 3).alias("doppler"))


@query("f10_doppler_rate", "vx_points", f"""
    SELECT track_id, ROUND(REGR_SLOPE(channel_sample, time_sample) * {CHANNEL_HZ!r} / {SAMPLING_TIME!r}, 4) AS rate,
           ROUND(REGR_SLOPE(channel_sample, time_sample), 6) AS slope FROM vx_points GROUP BY 1 HAVING COUNT(*) > 1""")
def _(p):
    f = tr.fits(p).where("n > 1").withColumn("rate", units.pixel_slope_to_rate("slope", SAMPLING_TIME, CHANNEL_HZ))
    return f.select("track_id", r("rate", 4).alias("rate"),
                    r(units.rate_to_pixel_slope("rate", SAMPLING_TIME, CHANNEL_HZ), 6).alias("slope"))


@query("f11_line_through", "vx_points", """
    SELECT track_id, CASE WHEN x1 = x2 THEN NULL WHEN y1 = y2 THEN 0 ELSE ROUND((y2 - y1) / (x2 - x1), 6) END AS slope,
           CASE WHEN x1 = x2 OR y1 = y2 THEN 0 ELSE ROUND(y1 - (y2 - y1) / (x2 - x1) * x1, 4) END AS intercept
    FROM (SELECT track_id, MIN(time_sample) AS x1, MAX(time_sample) AS x2, MAX(channel_sample) AS y1, MIN(channel_sample) AS y2
          FROM vx_points GROUP BY 1)""")
def _(p):
    """Vertical lines (infinite slope) are shown as null."""
    g = p.groupBy("track_id").agg(F.min("time_sample").alias("x1"), F.max("time_sample").alias("x2"),
                                  F.max("channel_sample").alias("y1"), F.min("channel_sample").alias("y2"))
    m, c = units.line_through("x1", "y1", "x2", "y2")
    return g.select("track_id", F.when(m != float("inf"), F.round(m, 6)).alias("slope"), F.round(c, 4).alias("intercept"))


@query("f16_state_text", "vx_points", """
    SELECT track_id, printf('%d detections at %d times in %d beams; mean %.2f dB, peak %.2f dB', COUNT(*), COUNT(DISTINCT time_sample),
           COUNT(DISTINCT beam_id), FLOOR(AVG(snr) * 100) / 100 + 0.001, MAX(snr)) AS line FROM vx_points GROUP BY 1""")
def _(p):
    """Status line; the mean is cut to two digits first so that both text formatters agree."""
    s = tr.summary(p)
    return s.select("track_id", F.format_string(
        "%d detections at %d times in %d beams; mean %.2f dB, peak %.2f dB", F.col("n"), F.col("track_size"),
        F.col("activated_beams"), F.floor(F.col("mean_snr") * 100) / 100 + 0.001, F.col("psnr")).alias("line"))


@query("f5_sample_time", "vx_points", """
    SELECT event_id, iter * 160 + beam_id AS time_sample, 1700000000000000 + CAST(FLOOR(CAST(beam_id AS BIGINT) * 95869805 / 1000) AS BIGINT) AS time_us
    FROM vx_points""")
def _(p):
    return p.select("event_id", units.global_sample("iter", "beam_id").alias("time_sample"),
                    units.sample_micros(F.lit(1700000000000000), "beam_id", SAMPLING_TIME).alias("time_us"))


@query("f12_p_value_gate", "vx_cluster_points", """
    WITH s AS (SELECT track_id, cluster_id, COUNT(*) AS n, CORR(channel_sample, time_sample) AS r FROM vx_cluster_points GROUP BY 1, 2)
    SELECT track_id, cluster_id, n, (n = 3 AND 1 - 2 * ASIN(LEAST(ABS(r), 1)) / PI() <= 0.01) OR (n = 4 AND 1 - ABS(r) <= 0.01)
           OR (n >= 5 AND ABS(r) >= 0.99) AS passes
    FROM s WHERE n >= 3 AND r IS NOT NULL AND NOT ISNAN(r)""")
def _(p):
    f = tr.fits(p, ["track_id", "cluster_id"]).where("n >= 3 AND r IS NOT NULL")
    return f.select("track_id", "cluster_id", "n", rg.p_value_gate("n", "r").alias("passes"))


@query("u1_union_of_beams", "vx_cluster_points", """
    SELECT iter, COUNT(*) AS n, COUNT(DISTINCT beam_id) AS beams FROM vx_cluster_points GROUP BY 1""")
def _(p):
    """Per-beam cluster tables put together again by name."""
    out = None
    for b in range(4):
        one = p.where(F.col("beam_id") == b)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("iter").agg(F.count("*").alias("n"), F.count_distinct("beam_id").alias("beams"))


@query("s13_track_scan", "vx_points", """
    SELECT track_id, event_id FROM vx_points WHERE track_id = 5 AND time_sample BETWEEN 100 AND 500""")
def _(p):
    from skysieve.sources import tables
    t = p.withColumn("obs_id", F.col("track_id")).withColumn("created_s", F.col("time_sample"))
    return tables.tracks(t, 5, 100, 500).select("track_id", "event_id")


@query("s13_event_scan", "vx_points", """
    SELECT event_id FROM vx_points WHERE time_sample >= 300""")
def _(p):
    from skysieve.sources import tables
    return tables.events(p.withColumn("created_s", F.col("time_sample")), from_s=300).select("event_id")

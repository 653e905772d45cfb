"""Noise, thresholds, filters and scoring on sparse images."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import add_view, query
from skysieve.checks.signal import r, rounded
from skysieve.operators import denoise as dn, evaluate as ev, image, noise as nz, thresholds as th
from skysieve.session import cut

NC, NT = 64, 160

add_view("vx_noise", """
    SELECT iter, beam_id, channel_sample, MEDIAN(power) AS noise, STDDEV_POP(power) AS noise_std
    FROM fx_pixels GROUP BY 1, 2, 3""", ["fx_pixels"])
_ROLL = """
    SELECT iter, beam_id, channel_sample,
           MEDIAN(noise) OVER w AS channel_noise, MEDIAN(noise_std) OVER w AS channel_noise_std
    FROM vx_noise WINDOW w AS (PARTITION BY beam_id, channel_sample ORDER BY iter
                               ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"""


def rolled(p):
    return nz.rolling_noise(cut(nz.channel_noise(p)))


@query("a1_channel_noise", "fx_pixels", """
    SELECT iter, beam_id, channel_sample, MEDIAN(power) AS noise, ROUND(STDDEV_POP(power), 3) AS noise_std
    FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    return rounded(nz.channel_noise(p), "noise_std", 3)


@query("a1_strip_noise", "fx_pixels", """
    SELECT iter, beam_id, channel_sample, MEDIAN(power) AS noise, ROUND(STDDEV_POP(power), 3) AS noise_std
    FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    strips = p.groupBy("iter", "beam_id", "channel_sample").agg(F.collect_list("power").alias("power"))
    return rounded(nz.strip_noise(strips).drop("power"), "noise_std", 3)


@query("a2_beam_noise", "fx_pixels", """
    SELECT iter, beam_id, ROUND(AVG(noise), 5) AS beam_noise, MEDIAN(noise) AS beam_median
    FROM vx_noise GROUP BY 1, 2""", "vx_noise")
def _(p):
    return rounded(nz.beam_noise(nz.channel_noise(p)), "beam_noise")


@query("a2_overall_noise", "fx_pixels", "SELECT iter, MEDIAN(noise) AS mean_noise FROM vx_noise GROUP BY 1", "vx_noise")
def _(p):
    return nz.overall_noise(nz.channel_noise(p))


@query("w1_rolling_noise", "fx_pixels", f"""
    SELECT iter, beam_id, channel_sample, channel_noise, ROUND(channel_noise_std, 3) AS channel_noise_std
    FROM ({_ROLL})""", "vx_noise")
def _(p):
    return rounded(rolled(p), "channel_noise_std", 3).select(
        "iter", "beam_id", "channel_sample", "channel_noise", "channel_noise_std")


@query("k11_noise_summary", "fx_pixels", f"""
    WITH o AS ({_ROLL})
    SELECT iter, beam_id, MEDIAN(channel_noise) AS noise_beam,
           (SELECT MEDIAN(channel_noise) FROM o WHERE iter = 5) AS noise_mean
    FROM o WHERE iter = 5 GROUP BY 1, 2""", "vx_noise")
def _(p):
    return nz.observation_noise_summary(rolled(p), 5)


@query("w2_moving_chunk_average", "fx_pixels", """
    WITH c AS (SELECT iter, beam_id, CAST(FLOOR(time_idx / 32) AS BIGINT) AS chunk, AVG(power) AS m, STDDEV_POP(power) AS s
               FROM fx_pixels GROUP BY 1, 2, 3)
    SELECT iter, beam_id, chunk, ROUND(AVG(m) OVER w, 4) AS avg_mean, ROUND(AVG(s) OVER w, 4) AS avg_std
    FROM c WINDOW w AS (PARTITION BY iter, beam_id ORDER BY chunk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(p):
    keys = ["iter", "beam_id"]
    out = nz.moving_chunk_average(nz.chunk_statistics(p, keys), keys)
    return rounded(out.drop("mean", "std"), "avg_mean avg_std", 4)


@query("w2_moving_channel_average", "fx_pixels", """
    WITH c AS (SELECT iter, beam_id, channel_sample, CAST(FLOOR(time_idx / 32) AS BIGINT) AS chunk, AVG(power) AS m,
                      STDDEV_POP(power) AS s FROM fx_pixels GROUP BY 1, 2, 3, 4)
    SELECT iter, beam_id, channel_sample, chunk, ROUND(AVG(m) OVER w, 6) AS avg_mean, ROUND(AVG(s) OVER w, 6) AS avg_std
    FROM c WINDOW w AS (PARTITION BY iter, beam_id, channel_sample ORDER BY chunk
                        ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def _(p):
    keys = ["iter", "beam_id", "channel_sample"]
    out = nz.moving_chunk_average(nz.chunk_statistics(p, keys), keys)
    return rounded(out.drop("mean", "std"), "avg_mean avg_std", 6)


@query("w3_chunked_threshold", "fx_pixels", """
    SELECT iter, beam_id, CAST(FLOOR(time_idx / 32) AS BIGINT) AS chunk,
           ROUND(AVG(power) + 3 * STDDEV_POP(power), 4) AS threshold FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    return rounded(th.chunked(th.mean_sigma)(p), "threshold", 4)


@query("p1_doppler_window", "fx_pixels", """
    WITH f AS (SELECT *, 410.0 + channel_sample * 0.00001043e0 AS channel FROM fx_pixels),
    k AS (SELECT * FROM f WHERE channel > 410.0002e0 AND channel < 410.0005e0)
    SELECT iter, beam_id, channel_sample - (SELECT MIN(channel_sample) FROM k) AS channel_sample,
           ROUND(channel, 8) AS channel, COUNT(*) AS n FROM k GROUP BY 1, 2, 3, 4""")
def _(p):
    out = nz.doppler_window(p, 410.0, 0.00001043, 410.0, 200.0, 500.0)
    return out.groupBy("iter", "beam_id", "channel_sample", r("channel", 8).alias("channel")).agg(
        F.count("*").alias("n"))


@query("p2_power", "fx_voltages", """
    SELECT ant, sample, ROUND(re * re + im * im + 1e-14, 4) AS power FROM fx_voltages""")
def _(v):
    from skysieve.operators.beamform import power
    return v.select("ant", "sample", r(power(), 4).alias("power"))


@query("p3_subtract_noise", "fx_pixels", f"""
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power - o.channel_noise AS power
    FROM fx_pixels p JOIN ({_ROLL}) o ON p.iter = o.iter AND p.beam_id = o.beam_id
     AND p.channel_sample = o.channel_sample""", "vx_noise")
def _(p):
    return nz.subtract_noise(p, rolled(p))


@query("p4_sparse_pixels", "fx_pixels", """
    SELECT p.iter, p.beam_id, COUNT(*) AS n, SUM(p.power - n.noise) AS power
    FROM fx_pixels p JOIN vx_noise n ON p.iter = n.iter AND p.beam_id = n.beam_id
     AND p.channel_sample = n.channel_sample WHERE p.power - n.noise > 0 GROUP BY 1, 2""", "vx_noise")
def _(p):
    out = nz.sparse(nz.subtract_noise(p, nz.channel_noise(p), column="noise"))
    return out.groupBy("iter", "beam_id").agg(F.count("*").alias("n"), F.sum("power").alias("power"))


@query("p5_sigma_clip", "fx_pixels", f"""
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power
    FROM fx_pixels p JOIN ({_ROLL}) o ON p.iter = o.iter AND p.beam_id = o.beam_id
     AND p.channel_sample = o.channel_sample
    WHERE p.power > 3 * o.channel_noise_std + o.channel_noise""", "vx_noise")
def _(p):
    return dn.background(p, rolled(p), 3.0, None)


@query("p6_background_filter", "fx_pixels", f"""
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx,
           CASE WHEN p.power <= 2 * o.channel_noise_std + o.channel_noise THEN -50 ELSE p.power END AS power
    FROM fx_pixels p JOIN ({_ROLL}) o ON p.iter = o.iter AND p.beam_id = o.beam_id
     AND p.channel_sample = o.channel_sample""", "vx_noise")
def _(p):
    return dn.background(p, rolled(p), 2.0, -50.0)


def _hist(n, image="iter, beam_id"):
    j = " AND ".join(f"p.{k.strip()} = g.{k.strip()}" for k in image.split(","))
    k = ", ".join("g." + c.strip() for c in image.split(","))
    return f"""
    g AS (SELECT {image}, MIN(power) AS lo, MAX(power) AS hi FROM fx_pixels GROUP BY {image}),
    c AS (SELECT {k}, CAST(LEAST({n - 1}, FLOOR((power - lo) / (hi - lo) * {n})) AS INT) AS bin, COUNT(*) AS k
          FROM fx_pixels p JOIN g ON {j} WHERE hi > lo GROUP BY ALL),
    h AS (SELECT {k}, lo, hi, CAST(b.bin AS INT) AS bin, COALESCE(c.k, 0) AS n
          FROM (SELECT * FROM g WHERE hi > lo) g CROSS JOIN (SELECT UNNEST(RANGE(0, {n})) AS bin) b
          LEFT JOIN c ON c.bin = b.bin AND {j.replace('p.', 'c.')})"""


_CUM = """
    m AS (SELECT *, SUM(n) OVER u AS c, SUM(n * bin) OVER u AS cb, SUM(n * n) OVER u AS sq,
                 SUM(n) OVER w AS tc, SUM(n * bin) OVER w AS tcb, SUM(n * n) OVER w AS tsq
          FROM h WINDOW u AS (PARTITION BY iter, beam_id ORDER BY bin ROWS UNBOUNDED PRECEDING),
                        w AS (PARTITION BY iter, beam_id))"""


def _pick(score, value, cond="TRUE", tie="bin"):
    return f"""
    SELECT iter, beam_id, ROUND({value}, 6) AS threshold FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY iter, beam_id ORDER BY {score} DESC, {tie}) AS rn
      FROM m WHERE {cond}) WHERE rn = 1"""


def _mid(n):
    return f"lo + (bin + 0.5) * (hi - lo) / {n}"


_TRIANGLE = "WITH " + _hist(1024) + """,
    t AS (SELECT *, MIN(CASE WHEN n > 0 THEN bin END) OVER w AS a, MAX(CASE WHEN n > 0 THEN bin END) OVER w AS z,
                 MAX(n) OVER w AS pk FROM h WINDOW w AS (PARTITION BY iter, beam_id)),
    t2 AS (SELECT *, MIN(CASE WHEN n = pk THEN bin END) OVER (PARTITION BY iter, beam_id) AS p FROM t),
    t3 AS (SELECT *, CASE WHEN p - a < z - p THEN z - p ELSE p - a END AS width,
                  CASE WHEN p - a < z - p THEN z - bin ELSE bin - a END AS x FROM t2),
    m AS (SELECT * FROM t3 WHERE x >= 0 AND x < width),
    thr AS (""" + _pick("pk * x - width * n", _mid(1024), tie="x") + """)"""


@query("c2_triangle", "fx_pixels", _TRIANGLE + """
    SELECT g.iter, g.beam_id, COALESCE(thr.threshold, 1.0) AS threshold
    FROM g LEFT JOIN thr ON g.iter = thr.iter AND g.beam_id = thr.beam_id""")
def _(p):
    return rounded(th.triangle(p), "threshold", 6)


@query("p7_triangle_filter", "fx_pixels", _TRIANGLE + """
    SELECT p.iter, p.beam_id, channel_sample, time_idx, power FROM fx_pixels p
    JOIN thr ON p.iter = thr.iter AND p.beam_id = thr.beam_id WHERE power >= threshold""")
def _(p):
    return dn.triangle_gate(p)


@query("p8_triangle_fallback", "fx_pixels", _TRIANGLE + f""",
    kept AS (SELECT p.* FROM fx_pixels p JOIN thr ON p.iter = thr.iter AND p.beam_id = thr.beam_id
             WHERE power >= threshold),
    l AS (SELECT iter, COUNT(*) AS n FROM kept WHERE power > 0 GROUP BY 1),
    o AS ({_ROLL})
    SELECT k.iter, k.beam_id, k.channel_sample, k.time_idx, k.power
    FROM kept k JOIN l ON k.iter = l.iter JOIN o ON k.iter = o.iter AND k.beam_id = o.beam_id
     AND k.channel_sample = o.channel_sample
    WHERE l.n <= 150 OR k.power > 3 * o.channel_noise_std + o.channel_noise""", "vx_noise")
def _(p):
    """The overload limit is set low enough for some blocks to exceed it."""
    return dn.triangle_with_fallback(p, rolled(p), 150)


@query("c2_otsu", "fx_pixels", "WITH " + _hist(256) + "," + _CUM + _pick(
    "c * (tc - c) * (cb / c - (tcb - cb) / (tc - c)) * (cb / c - (tcb - cb) / (tc - c))", _mid(256), "c < tc"))
def _(p):
    return rounded(th.otsu(p), "threshold", 6)


@query("c2_yen", "fx_pixels", "WITH " + _hist(1024) + "," + _CUM + _pick(
    "(CAST(c AS DOUBLE) * (tc - c)) * (CAST(c AS DOUBLE) * (tc - c)) / (CAST(sq AS DOUBLE) * CAST(tsq - sq AS DOUBLE))",
    _mid(1024), "c < tc"))
def _(p):
    return rounded(th.yen(p), "threshold", 6)


_ISO = "((cb / c + (tcb - cb) / (tc - c)) / 2 - bin)"


@query("c2_isodata", "fx_pixels", "WITH " + _hist(1024) + "," + _CUM + _pick(
    "-bin", _mid(1024), f"c < tc AND {_ISO} >= 0 AND {_ISO} < 1"))
def _(p):
    return rounded(th.isodata(p), "threshold", 6)


@query("c2_kittler", "fx_pixels", "WITH " + _hist(1024) + """,
    k AS (SELECT *, lo + bin * (hi - lo) / 1024 AS g FROM h),
    k2 AS (SELECT *, SUM(n) OVER u AS c, SUM(n * g) OVER u AS mm, SUM(n * g * g) OVER u AS s,
                  SUM(n) OVER w AS tc, SUM(n * g) OVER w AS tm, SUM(n * g * g) OVER w AS ts
           FROM k WINDOW u AS (PARTITION BY iter, beam_id ORDER BY bin ROWS UNBOUNDED PRECEDING),
                         w AS (PARTITION BY iter, beam_id)),
    k3 AS (SELECT *, s / c - (mm / c) * (mm / c) AS vf, (ts - s + 1e-6) / (tc - c + 1e-6)
              - ((tm - mm + 1e-6) / (tc - c + 1e-6)) * ((tm - mm + 1e-6) / (tc - c + 1e-6)) AS vb,
              c / tc AS p FROM k2),
    m AS (SELECT *, p * LN(SQRT(vf) + 1e-6) + (1 - p) * LN(SQRT(vb) + 1e-6) - p * LN(p) - (1 - p) * LN(1 - p) AS v
          FROM k3 WHERE vf >= 0 AND vb >= 0 AND p < 1)""" + _pick("-v", "g"))
def _(p):
    return rounded(th.kittler(p), "threshold", 6)


@query("c2_minimum", "fx_pixels")
def _(p):
    """Iterated smoothing of the histogram; tested against a direct loop."""
    return rounded(th.minimum(p), "threshold", 6)


@query("c3_global_mask", "fx_pixels", """
    WITH t AS (SELECT iter, beam_id, AVG(power) + 3 * STDDEV_POP(power) AS thr FROM fx_pixels GROUP BY 1, 2)
    SELECT p.iter, p.beam_id, ROUND(MAX(thr), 4) AS threshold, COUNT(*) FILTER (power < thr) AS below,
           COUNT(*) FILTER (power >= thr) AS above
    FROM fx_pixels p JOIN t ON p.iter = t.iter AND p.beam_id = t.beam_id GROUP BY 1, 2""")
def _(p):
    t = th.THRESHOLDS["global"](p)
    return p.join(t, ["iter", "beam_id"]).groupBy("iter", "beam_id").agg(
        r(F.max("threshold"), 4).alias("threshold"), F.count_if(F.col("power") < F.col("threshold")).alias("below"),
        F.count_if(F.col("power") >= F.col("threshold")).alias("above"))


@query("c3_local_mask", "fx_pixels", """
    WITH t AS (SELECT iter, beam_id, channel_sample, AVG(power) + 3 * STDDEV_POP(power) AS thr FROM fx_pixels GROUP BY 1, 2, 3)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power
    FROM fx_pixels p JOIN t ON p.iter = t.iter AND p.beam_id = t.beam_id AND p.channel_sample = t.channel_sample
    WHERE p.power > thr""")
def _(p):
    keys = ["iter", "beam_id", "channel_sample"]
    return th.above(p, th.THRESHOLDS["local"](p), keys, strict=True)


@query("c3_running_mask", "fx_pixels", """
    WITH c AS (SELECT iter, beam_id, CAST(FLOOR(time_idx / 32) AS BIGINT) AS chunk, AVG(power) AS m, STDDEV_POP(power) AS s
               FROM fx_pixels GROUP BY 1, 2, 3),
    t AS (SELECT iter, beam_id, chunk, AVG(m) OVER w + 3 * AVG(s) OVER w AS thr FROM c
          WINDOW w AS (PARTITION BY iter, beam_id ORDER BY chunk ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT p.iter, p.beam_id, chunk, COUNT(*) AS n FROM fx_pixels p
    JOIN t ON p.iter = t.iter AND p.beam_id = t.beam_id AND FLOOR(p.time_idx / 32) = t.chunk
    WHERE power > thr GROUP BY 1, 2, 3""")
def _(p):
    keys = ["iter", "beam_id"]
    t = nz.moving_chunk_average(nz.chunk_statistics(p, keys), keys).withColumn(
        "threshold", F.col("avg_mean") + 3 * F.col("avg_std"))
    q = p.withColumn("chunk", F.floor(F.col("time_idx") / 32))
    return th.above(q, t, [*keys, "chunk"], strict=True).groupBy(*keys, "chunk").agg(F.count("*").alias("n"))


def _clip_sql(rounds, lower, upper, centre, key="iter, beam_id"):
    on = " AND ".join(f"p.{k.strip()} = b.{k.strip()}" for k in key.split(","))
    pk = ", ".join("p." + k.strip() for k in key.split(","))
    parts = [f"b1 AS (SELECT {key}, {centre} - {lower} * STDDEV_POP(power) AS lo, "
             f"{centre} + {upper} * STDDEV_POP(power) AS hi FROM src GROUP BY ALL)"]
    for i in range(2, rounds + 1):
        parts.append(
            f"b{i} AS (SELECT {pk}, GREATEST(MAX(lo), {centre} - {lower} * STDDEV_POP(power)) AS lo, "
            f"LEAST(MAX(hi), {centre} + {upper} * STDDEV_POP(power)) AS hi "
            f"FROM src p JOIN b{i - 1} b ON {on} WHERE power BETWEEN lo AND hi GROUP BY ALL)")
    return ", ".join(parts)


@query("c4_sigma_clip_median", "fx_pixels", "WITH src AS (SELECT * FROM fx_pixels), " + _clip_sql(
    3, 70, 3, "MEDIAN(power)") + " SELECT iter, beam_id, ROUND(lo, 3) AS low, ROUND(hi, 3) AS high FROM b3")
def _(p):
    return rounded(th.sigma_clip(p, 3, 70.0, 3.0, True), "low high", 3)


@query("c4_sigma_clip_mean", "fx_pixels", "WITH src AS (SELECT * FROM fx_pixels), " + _clip_sql(
    5, 10, 4, "AVG(power)") + " SELECT iter, beam_id, ROUND(lo, 3) AS low, ROUND(hi, 3) AS high FROM b5")
def _(p):
    return rounded(th.sigma_clip(p, 5, 10.0, 4.0, False), "low high", 3)


@query("c5_tile_background", "fx_pixels",
       "WITH src AS (SELECT *, CAST(channel_sample // 50 AS BIGINT) AS tile_c, CAST(time_idx // 50 AS BIGINT) AS tile_t "
       "FROM fx_pixels), " + _clip_sql(3, 10, 3, "AVG(power)", "iter, beam_id, tile_c, tile_t") + """
    SELECT p.iter, p.beam_id, p.tile_c, p.tile_t, MEDIAN(power) AS background, ROUND(STDDEV_POP(power), 4) AS rms,
           ROUND(MEDIAN(power) + 3 * STDDEV_POP(power), 4) AS threshold
    FROM src p JOIN b3 b ON p.iter = b.iter AND p.beam_id = b.beam_id AND p.tile_c = b.tile_c AND p.tile_t = b.tile_t
    WHERE power BETWEEN lo AND hi GROUP BY 1, 2, 3, 4""")
def _(p):
    return rounded(th.tile_background(p), "rms threshold", 4)


_FOLD = """
    k AS (SELECT UNNEST(RANGE(-100, 101)) AS k),
    kw AS (SELECT k, EXP(-0.5 * (k / 25.0) * (k / 25.0)) / SUM(EXP(-0.5 * (k / 25.0) * (k / 25.0))) OVER () AS w FROM k),
    ft AS (SELECT o, CASE WHEN s >= 160 THEN 319 - s ELSE s END AS s, SUM(w) AS w FROM (
             SELECT o, ((o + k) % 320 + 320) % 320 AS s, w FROM kw, (SELECT UNNEST(RANGE(0, 160)) AS o)) GROUP BY 1, 2),
    fc AS (SELECT o, CASE WHEN s >= 64 THEN 127 - s ELSE s END AS s, SUM(w) AS w FROM (
             SELECT o, ((o + k) % 128 + 128) % 128 AS s, w FROM kw, (SELECT UNNEST(RANGE(0, 64)) AS o)) GROUP BY 1, 2)"""


@query("c6_adaptive_threshold", "fx_pixels", "WITH " + _FOLD + """,
    a AS (SELECT iter, beam_id, channel_sample AS c, ft.o AS t, SUM(power * w) AS v
          FROM fx_pixels JOIN ft ON time_idx = ft.s GROUP BY 1, 2, 3, 4)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power, ROUND(SUM(a.v * fc.w), 3) AS threshold
    FROM fx_pixels p JOIN fc ON p.channel_sample = fc.o
    JOIN a ON a.iter = p.iter AND a.beam_id = p.beam_id AND a.t = p.time_idx AND a.c = fc.s
    GROUP BY 1, 2, 3, 4, 5""")
def _(p):
    return rounded(image.adaptive_threshold(p, NC, NT), "threshold", 3)


@query("c7_opening", "fx_pixels", """
    WITH b AS (SELECT a.iter, a.beam_id, a.channel_sample AS c, a.time_idx AS t FROM fx_pixels a
      JOIN fx_pixels x ON x.iter = a.iter AND x.beam_id = a.beam_id AND x.channel_sample = a.channel_sample + 1 AND x.time_idx = a.time_idx
      JOIN fx_pixels y ON y.iter = a.iter AND y.beam_id = a.beam_id AND y.channel_sample = a.channel_sample AND y.time_idx = a.time_idx + 1
      JOIN fx_pixels z ON z.iter = a.iter AND z.beam_id = a.beam_id AND z.channel_sample = a.channel_sample + 1 AND z.time_idx = a.time_idx + 1),
    f AS (SELECT DISTINCT iter, beam_id, c + dc AS channel_sample, t + dt AS time_idx
          FROM b, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dc, dt))
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power FROM fx_pixels p JOIN f
    ON p.iter = f.iter AND p.beam_id = f.beam_id AND p.channel_sample = f.channel_sample AND p.time_idx = f.time_idx""")
def _(p):
    return image.opening(p, NC, NT)


@query("c21_median_filter", "fx_pixels")
def _(p):
    """Per-channel mean + 2 sigma gate, then the 20 x 20 median; tested against a direct loop."""
    t = th.mean_sigma(p, 2.0, ["iter", "beam_id", "channel_sample"])
    gated = p.join(t, ["iter", "beam_id", "channel_sample"]).withColumn(
        "power", F.when(F.col("power") >= F.col("threshold"), F.col("power")).otherwise(0.0))
    return image.median_filter(gated.drop("threshold"), NC, NT)


@query("j7_pepper_filter", "fx_pixels", """
    SELECT DISTINCT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power
    FROM (SELECT *, UNNEST([-1, 0, 1]) AS dc FROM fx_pixels) p JOIN fx_pixels q
      ON q.iter = p.iter AND q.beam_id = p.beam_id AND q.channel_sample = p.channel_sample + dc
     AND q.time_idx BETWEEN p.time_idx - 1 AND p.time_idx + 1 AND NOT (dc = 0 AND q.time_idx = p.time_idx)""")
def _(p):
    return image.remove_isolated(p, NC, NT, 1)


@query("p9_pepper_5x5", "fx_pixels", """
    SELECT DISTINCT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power
    FROM (SELECT *, UNNEST([-2, -1, 0, 1, 2]) AS dc FROM fx_pixels) p JOIN fx_pixels q
      ON q.iter = p.iter AND q.beam_id = p.beam_id AND q.channel_sample = p.channel_sample + dc
     AND q.time_idx BETWEEN p.time_idx - 2 AND p.time_idx + 2 AND NOT (dc = 0 AND q.time_idx = p.time_idx)""")
def _(p):
    return image.remove_isolated(p, NC, NT, 2)


@query("p10_rfi_peaks", "fx_pixels", """
    WITH s AS (SELECT iter, beam_id, channel_sample, SUM(power) AS s FROM fx_pixels GROUP BY 1, 2, 3),
    t AS (SELECT iter, AVG(s) + 2 * STDDEV_POP(s) AS t FROM s GROUP BY 1),
    b AS (SELECT DISTINCT s.iter, channel_sample FROM s JOIN t ON s.iter = t.iter WHERE s > t)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, CASE WHEN b.iter IS NULL THEN power ELSE -100 END AS power
    FROM fx_pixels p LEFT JOIN b ON p.iter = b.iter AND p.channel_sample = b.channel_sample""")
def _(p):
    return dn.rfi_peaks(p, 2.0)


@query("p11_rfi_persistent", "fx_pixels", """
    WITH n AS (SELECT iter, beam_id, AVG(noise) AS bn FROM vx_noise GROUP BY 1, 2),
    s AS (SELECT p.iter, p.beam_id, channel_sample, SUM(power) AS s, COUNT(*) FILTER (power > bn) AS k
          FROM fx_pixels p JOIN n ON p.iter = n.iter AND p.beam_id = n.beam_id GROUP BY 1, 2, 3),
    t AS (SELECT iter, beam_id, AVG(s) + STDDEV_POP(s) AS t FROM s GROUP BY 1, 2),
    b AS (SELECT s.iter, s.beam_id, channel_sample, bn FROM s JOIN t ON s.iter = t.iter AND s.beam_id = t.beam_id
          JOIN n ON n.iter = s.iter AND n.beam_id = s.beam_id WHERE s > t AND k > 0.6 * 20)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, ROUND(COALESCE(bn, power), 4) AS power
    FROM fx_pixels p LEFT JOIN b ON p.iter = b.iter AND p.beam_id = b.beam_id AND p.channel_sample = b.channel_sample""", "vx_noise")
def _(p):
    bn = nz.beam_noise(nz.channel_noise(p))
    return rounded(dn.rfi_persistent(p, bn, 20, 1.0), "power", 4)


@query("p12_rfi_mean_fill", "fx_pixels", """
    WITH s AS (SELECT iter, beam_id, channel_sample, SUM(power) AS s, COUNT(*) AS n FROM fx_pixels GROUP BY 1, 2, 3),
    t AS (SELECT iter, beam_id, AVG(s) + 2 * STDDEV_POP(s) AS t, SUM(s) / SUM(n) AS m FROM s GROUP BY 1, 2)
    SELECT p.iter, p.beam_id, p.channel_sample, p.time_idx, ROUND(CASE WHEN s.s > t.t THEN t.m ELSE p.power END, 4) AS power
    FROM fx_pixels p JOIN s ON p.iter = s.iter AND p.beam_id = s.beam_id AND p.channel_sample = s.channel_sample
    JOIN t ON p.iter = t.iter AND p.beam_id = t.beam_id""")
def _(p):
    return rounded(dn.rfi_mean_fill(p, 2.0), "power", 4)


@query("p14_skip_warm_up", "fx_pixels", "SELECT iter, COUNT(*) AS n FROM fx_pixels WHERE iter >= 2 GROUP BY 1")
def _(p):
    return nz.skip_warm_up(p).groupBy("iter").agg(F.count("*").alias("n"))


@query("w6_cfar_peaks", "fx_pixels", """
    WITH g AS (SELECT i.iter, i.beam_id, CAST(c AS INT) AS channel_sample, CAST(t AS INT) AS time_idx, COALESCE(p.power, 0) AS x
               FROM (SELECT DISTINCT iter, beam_id, time_idx AS t FROM fx_pixels) i
               CROSS JOIN (SELECT UNNEST(RANGE(0, 64)) AS c) LEFT JOIN fx_pixels p
               ON p.iter = i.iter AND p.beam_id = i.beam_id AND p.channel_sample = c AND p.time_idx = t),
    w AS (SELECT *, MAX(x) OVER (k ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS pre,
                 MAX(x) OVER (k ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING) AS post,
                 SUM(x) OVER (k ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) - SUM(x) OVER (k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS tr
          FROM g WINDOW k AS (PARTITION BY iter, beam_id, time_idx ORDER BY channel_sample))
    SELECT iter, beam_id, channel_sample, time_idx, x AS power FROM w
    WHERE channel_sample BETWEEN 6 AND 57 AND x > pre AND x >= post AND x > 10 * (POWER(1e-3, -0.1) - 1) * tr / 10""")
def _(p):
    return image.cfar_peaks(p, NC, NT)


@query("a24_bandpass", "fx_pixels", """
    SELECT iter, beam_id, channel_sample, SUM(power) AS power FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    return nz.bandpass(p)


@query("a24_total_power", "fx_pixels", """
    SELECT iter, beam_id, time_idx, ROUND(10 * LOG10(AVG(power)), 5) AS power_db FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    return rounded(nz.total_power_db(p), "power_db")


@query("s11_image_window", "fx_pixels", """
    SELECT iter, beam_id, channel_sample - 16 AS channel_sample, time_idx - 40 AS time_idx, power FROM fx_pixels
    WHERE channel_sample BETWEEN 16 AND 47 AND time_idx BETWEEN 40 AND 119""")
def _(p):
    from skysieve.sources.tables import image_window
    return image_window(p, 16, 48, 40, 80)


# truth: pixels above the global gate in beam b, prediction: the same cells of the next beam
_TP = """
    t AS (SELECT iter, beam_id, channel_sample, time_idx FROM fx_pixels WHERE power > 2000),
    q AS (SELECT iter, (beam_id + 7) % 8 AS beam_id, channel_sample, time_idx FROM fx_pixels WHERE power > 1500),
    f AS (SELECT COALESCE(t.iter, q.iter) AS iter, COALESCE(t.beam_id, q.beam_id) AS beam_id,
                 COUNT(*) FILTER (t.iter IS NOT NULL AND q.iter IS NOT NULL) AS tp,
                 COUNT(*) FILTER (t.iter IS NULL) AS fp, COUNT(*) FILTER (q.iter IS NULL) AS fn
          FROM t FULL JOIN q ON t.iter = q.iter AND t.beam_id = q.beam_id AND t.channel_sample = q.channel_sample
           AND t.time_idx = q.time_idx GROUP BY 1, 2)"""


def _confusion(p):
    t = p.where("power > 2000")
    q = p.where("power > 1500").withColumn("beam_id", (F.col("beam_id") + 7) % 8)
    return ev.confusion(t, q, ["iter", "beam_id"], NC * NT)


@query("j13_confusion", "fx_pixels", f"WITH {_TP} SELECT *, {NC * NT} - tp - fp - fn AS tn FROM f")
def _(p):
    return _confusion(p)


_SCORE_COLS = "precision recall specificity fpr accuracy f1 jaccard mse reduction score".split()
_SCORED = f"""WITH {_TP}, n AS (SELECT *, {NC * NT} - tp - fp - fn AS tn FROM f),
    s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, tp / NULLIF(tp + fn, 0) AS recall,
                 tn / NULLIF(tn + fp, 0) AS specificity, 1 - tn / NULLIF(tn + fp, 0) AS fpr,
                 (tp + tn) / {NC * NT} AS accuracy, 2 * tp / NULLIF(2 * tp + fp + fn, 0) AS f1,
                 tp / NULLIF(tp + fp + fn, 0) AS jaccard, (fp + fn) / {NC * NT} AS mse, tp + fp AS n_px,
                 (1 - (fp + tp) / {NC * NT}) * 100 AS reduction FROM n),
    z AS (SELECT *, 2 * recall * specificity / NULLIF(recall + specificity, 0) AS score FROM s)"""


@query("a16_scores", "fx_pixels", _SCORED + " SELECT iter, beam_id, tp, fp, fn, tn, n_px, " + ", ".join(
    f"ROUND({c}, 6) AS {c}" for c in _SCORE_COLS) + " FROM z")
def _(p):
    return rounded(ev.scores(_confusion(p), NC * NT), " ".join(_SCORE_COLS), 6)


@query("a17_score_roll_up", "fx_pixels", _SCORED + """
    SELECT beam_id AS snr, 'gate' AS name, ROUND(AVG(recall), 6) AS recall_mean, ROUND(STDDEV_SAMP(recall), 6) AS recall_std,
           ROUND(AVG(score), 6) AS score_mean, ROUND(STDDEV_SAMP(score), 6) AS score_std FROM z GROUP BY 1""")
def _(p):
    s = ev.scores(_confusion(p), NC * NT).withColumn("name", F.lit("gate")).withColumnRenamed("beam_id", "snr")
    return rounded(ev.roll_up(s, ["recall", "score"]), "recall_mean recall_std score_mean score_std", 6)


@query("k14_evaluation_export", "fx_pixels", _SCORED + """
    SELECT CAST(beam_id AS VARCHAR) || ',gate,' || printf('%.6f', AVG(score)) AS line FROM z GROUP BY beam_id""")
def _(p):
    from skysieve.sinks.tables import csv_lines
    s = ev.scores(_confusion(p), NC * NT).withColumn("name", F.lit("gate")).withColumnRenamed("beam_id", "snr")
    return csv_lines(ev.roll_up(s, ["score"]), [("snr", "%d"), ("name", "%s"), ("score_mean", "%.6f")])


@query("e2_filter_chain", "fx_pixels", _TRIANGLE + """,
    k AS (SELECT p.* FROM fx_pixels p JOIN thr ON p.iter = thr.iter AND p.beam_id = thr.beam_id WHERE power >= threshold)
    SELECT DISTINCT p.iter, p.beam_id, p.channel_sample, p.time_idx, p.power
    FROM (SELECT *, UNNEST([-1, 0, 1]) AS dc FROM k) p JOIN k q
      ON q.iter = p.iter AND q.beam_id = p.beam_id AND q.channel_sample = p.channel_sample + dc
     AND q.time_idx BETWEEN p.time_idx - 1 AND p.time_idx + 1 AND NOT (dc = 0 AND q.time_idx = p.time_idx)""", "vx_noise")
def _(p):
    """The enabled filter list, triangle then pepper, by name."""
    return dn.denoise(p, rolled(p), NC, NT)


@query("e3_thresholds_by_name", "fx_pixels", """
    SELECT iter, beam_id, 'global' AS name, ROUND(AVG(power) + 3 * STDDEV_POP(power), 4) AS threshold
    FROM fx_pixels GROUP BY 1, 2
    UNION ALL SELECT iter, beam_id, 'local', ROUND(AVG(t), 4) FROM (
      SELECT iter, beam_id, channel_sample, AVG(power) + 3 * STDDEV_POP(power) AS t FROM fx_pixels GROUP BY 1, 2, 3)
    GROUP BY 1, 2""")
def _(p):
    out = None
    for name in ("global", "local"):
        one = th.THRESHOLDS[name](p).groupBy("iter", "beam_id").agg(F.avg("threshold").alias("threshold")).select(
            "iter", "beam_id", F.lit(name).alias("name"), r("threshold", 4).alias("threshold"))
        out = one if out is None else out.unionByName(one)
    return out

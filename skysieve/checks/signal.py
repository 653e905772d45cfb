"""Voltages, beams, visibilities and gains."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import add_view, query
from skysieve.functions import cplx, pointing
from skysieve.operators import beamform as bf, calibrate as cal, correlate as co

LAT, REF_DEC, START_MHZ, BW_MHZ = 44.5208, 40.0, 410.0, 0.078125


def r(col, digits=5):
    return F.round(col, digits)


def rounded(df, columns, digits=5):
    for c in columns.split():
        df = df.withColumn(c, F.round(F.col(c), digits))
    return df


# --- beams ---------------------------------------------------------------------------------
add_view("vx_beams", """
    SELECT v.sample, w.beam_id, SUM(v.re * w.re - v.im * w.im) AS re, SUM(v.re * w.im + v.im * w.re) AS im
    FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id""",
         ["fx_voltages", "fx_weights"])


@query("j1_beamform", "fx_voltages fx_weights", """
    SELECT v.sample, w.beam_id, ROUND(SUM(v.re * w.re - v.im * w.im), 4) AS re,
           ROUND(SUM(v.re * w.im + v.im * w.re), 4) AS im
    FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id""")
def _(v, w):
    return rounded(bf.beamform(v, w), "re im", 4).select("sample", "beam_id", "re", "im")


@query("j1_beamform_frames", "fx_voltages fx_weights", """
    SELECT v.sample, w.beam_id, ROUND(SUM(v.re * w.re - v.im * w.im), 4) AS re,
           ROUND(SUM(v.re * w.im + v.im * w.re), 4) AS im
    FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id""")
def _(v, w):
    out = bf.beamform_frames(bf.to_frames(v, 8), w)
    return out.select("sample", F.posexplode(F.arrays_zip("re", "im"))).select(
        "sample", F.col("pos").alias("beam_id"), r(F.col("col.re"), 4).alias("re"),
        r(F.col("col.im"), 4).alias("im"))


@query("a4_integrated_power", "fx_voltages fx_weights", """
    WITH b AS (SELECT v.sample, w.beam_id, SUM(v.re * w.re - v.im * w.im) AS re,
                      SUM(v.re * w.im + v.im * w.re) AS im
               FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id)
    SELECT beam_id, CAST(FLOOR(sample / 100) AS BIGINT) AS chunk, ROUND(SUM(re * re + im * im), 3) AS power
    FROM b GROUP BY 1, 2""")
def _(v, w):
    return rounded(bf.integrated_power(bf.beamform(v, w), 100), "power", 3)


A19_SQL = """
    WITH b AS (SELECT v.sample, w.beam_id, SUM(v.re * w.re - v.im * w.im) AS re,
                      SUM(v.re * w.im + v.im * w.re) AS im
               FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id),
    c AS (SELECT beam_id, CAST(FLOOR(sample / 10) AS BIGINT) AS chunk, SUM(re * re + im * im) AS power
          FROM b GROUP BY 1, 2),
    p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY beam_id ORDER BY chunk) AS up,
                 ROW_NUMBER() OVER (PARTITION BY beam_id ORDER BY chunk DESC) AS down FROM c),
    n AS (SELECT beam_id, SUM(power) / COUNT(*) AS noise FROM (
            SELECT beam_id, power FROM p WHERE up <= 100
            UNION ALL SELECT beam_id, power FROM p WHERE down <= 50) GROUP BY beam_id)
    SELECT c.beam_id, c.chunk, ROUND(c.power, 3) AS power,
           ROUND(CASE WHEN c.power > n.noise THEN 10 * LOG10(c.power - n.noise) END, 5) AS power_db,
           ROUND(10 * LOG10(n.noise), 5) AS noise_db
    FROM c JOIN n ON c.beam_id = n.beam_id"""


@query("a19_beam_power_scan", "fx_voltages fx_weights", A19_SQL)
def beam_power_scan(v, w):
    """The offline scan end to end: weights, beams, integrated power, noise and dB."""
    out = bf.calibrated_beam_power(bf.integrated_power(bf.beamform(v, w), 10))
    out = rounded(rounded(out, "power", 3), "power_db noise_db", 5)
    return out.select("beam_id", "chunk", "power", "power_db", "noise_db")


@query("a3_antenna_rms", "fx_voltages", """
    SELECT ant, ROUND(SQRT(AVG(re * re + im * im)), 6) AS rms,
           ROUND(SQRT(SUM(re * re + im * im)), 5) AS rms_sum
    FROM fx_voltages GROUP BY ant""")
def _(v):
    a = bf.antenna_rms(v)
    b = bf.antenna_rms(v, normalise=False).withColumnRenamed("rms", "rms_sum")
    return rounded(rounded(a.join(b, "ant"), "rms", 6), "rms_sum", 5)


@query("p15_disabled_antennas", "fx_weights", """
    SELECT beam_id, ant, ROUND(CASE WHEN ant IN (2, 5) THEN 0 ELSE re END, 8) AS re,
           ROUND(CASE WHEN ant IN (2, 5) THEN 0 ELSE im END, 8) AS im FROM fx_weights""")
def _(w):
    return rounded(bf.disable_antennas(w, [2, 5]), "re im", 8)


@query("p24_antenna_subset", "fx_voltages", """
    SELECT ant, COUNT(*) AS n, ROUND(SUM(re), 5) AS re FROM fx_voltages WHERE ant < 4 GROUP BY ant""")
def _(v):
    return bf.first_antennas(v, 4).groupBy("ant").agg(F.count("*").alias("n"), r(F.sum("re")).alias("re"))


@query("p25_block_sampling", "fx_pixels", """
    SELECT iter, beam_id, COUNT(*) AS n, SUM(power) AS power FROM fx_pixels
    WHERE iter % 3 = 0 GROUP BY 1, 2""")
def _(p):
    return bf.every_kth(p, "iter", 3).groupBy("iter", "beam_id").agg(
        F.count("*").alias("n"), F.sum("power").alias("power"))


# --- pointing ------------------------------------------------------------------------------
add_view("vx_pointings", """
    SELECT CAST(s_suppkey AS BIGINT) AS beam_id, CAST(s_nationkey % 5 AS INT) AS array_id,
           (s_acctbal - 4500) / 1000 AS ha, CAST(s_nationkey - 12 AS DOUBLE) AS ddec FROM supplier""",
         ["supplier"])
add_view("vx_antennas", """
    SELECT CAST(n_regionkey AS INT) AS array_id, CAST(n_nationkey AS INT) AS ant,
           CAST(n_nationkey % 4 AS DOUBLE) * 5.67 AS east, CAST(n_nationkey AS DOUBLE) * 2.0 AS north,
           CAST(n_regionkey AS DOUBLE) * 0.1 AS up, COS(0.3 * n_nationkey) AS gain_re,
           SIN(0.3 * n_nationkey) AS gain_im FROM nation""", ["nation"])

# alt/az with the snap rules, as SQL over (ha, dec) in degrees
_ALTAZ = """
    {name}_a AS (SELECT *, ASIN(SIN(RADIANS({dec})) * SIN(RADIANS(44.5208))
                   + COS(RADIANS({dec})) * COS(RADIANS(44.5208)) * COS(RADIANS({ha}))) AS {p}alt FROM {src}),
    {name}_b AS (SELECT *, (SIN(RADIANS({dec})) - SIN({p}alt) * SIN(RADIANS(44.5208)))
                   / (COS({p}alt) * COS(RADIANS(44.5208))) AS {p}q FROM {name}_a),
    {name} AS (SELECT *, CASE WHEN ABS(44.5208 - ({dec})) < 0.01 THEN 0
                 WHEN SIN(RADIANS({ha})) >= 0 THEN 2 * PI() - {p}z ELSE {p}z END AS {p}az
               FROM (SELECT *, ACOS(CASE WHEN {p}q < 0 AND {p}q + 1 < 0.0001 THEN -1
                     WHEN {p}q > 0 THEN 1 ELSE {p}q END) AS {p}z FROM {name}_b))"""
_POINTED = _ALTAZ.format(name="axis", src="vx_pointings", dec="40.0", ha="0.0", p="x_") + """,
    turned AS (SELECT *, COS(RADIANS(h)) * COS(RADIANS(ddec)) AS vx, -SIN(RADIANS(h)) * COS(RADIANS(ddec)) AS vy,
                 SIN(RADIANS(ddec)) AS vz, COS(x_az) AS ca, -SIN(x_az) AS sa, COS(x_alt) AS cp, -SIN(x_alt) AS sp
               FROM (SELECT *, CASE WHEN ha < 0 THEN ha + 360 WHEN ha < 0.0001 THEN 0.0001 ELSE ha END AS h
                     FROM axis)),
    aimed AS (SELECT *, -ATAN2(cp * sa * vx + ca * vy + sp * sa * vz,
                               cp * ca * vx - sa * vy + sp * ca * vz) AS az,
                     ASIN(-sp * vx + cp * vz) AS el FROM turned)"""


@query("f6_altitude_azimuth", "vx_pointings", "WITH " + _ALTAZ.format(
    name="t", src="vx_pointings", dec="40.0 + ddec", ha="ha", p="") + """
    SELECT beam_id, ROUND(DEGREES(alt), 6) AS alt, ROUND(DEGREES(az), 5) AS az FROM t""")
def _(p):
    alt, az = pointing.altitude_azimuth("ha", F.lit(REF_DEC) + F.col("ddec"), LAT)
    return p.select("beam_id", r(F.degrees(alt), 6).alias("alt"), r(F.degrees(az)).alias("az"))


@query("f7_beam_az_el", "vx_pointings", "WITH " + _POINTED + """
    SELECT beam_id, ROUND(DEGREES(az), 6) AS az, ROUND(DEGREES(el), 6) AS el FROM aimed""")
def _(p):
    az, el = pointing.beam_azimuth_elevation(REF_DEC, "ha", "ddec", LAT)
    return p.select("beam_id", r(F.degrees(az), 6).alias("az"), r(F.degrees(el), 6).alias("el"))


@query("f9_scaled_pointing", "vx_pointings", "WITH s AS (SELECT beam_id, ddec, ha / COS(RADIANS(40.0 + ddec)) AS h0 "
       "FROM vx_pointings), s2 AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 WHEN h0 < 0.0001 THEN 0.0001 "
       "ELSE h0 END AS ha FROM s), " + _ALTAZ.format(name="t", src="s2", dec="40.0 + ddec", ha="ha", p="") + """
    SELECT beam_id, ROUND(DEGREES(alt), 6) AS alt, ROUND(DEGREES(az), 5) AS az FROM t""")
def _(p):
    alt, az = pointing.scaled_hour_angle_pointing(REF_DEC, "ha", "ddec", LAT)
    return p.select("beam_id", r(F.degrees(alt), 6).alias("alt"), r(F.degrees(az)).alias("az"))


@query("f8_weights", "vx_pointings vx_antennas", "WITH " + _POINTED + """,
    k AS (SELECT a.*, n.ant, n.gain_re, n.gain_im, s.sub,
            2 * PI() / 299792458.0 * (410.0 + s.sub * 0.078125 / 2) * 1e6
            * (SIN(az) * COS(el) * east + COS(az) * COS(el) * north + SIN(el) * up) AS ph
          FROM aimed a JOIN vx_antennas n ON a.array_id = n.array_id
          JOIN (SELECT UNNEST([0, 1]) AS sub) s ON TRUE)
    SELECT array_id, CAST(sub AS INT) AS sub, beam_id, ant,
           ROUND(COS(ph) * gain_re + SIN(ph) * gain_im, 5) AS re,
           ROUND(COS(ph) * gain_im - SIN(ph) * gain_re, 5) AS im FROM k""")
def _(p, a):
    return rounded(bf.weights_for(p, a, "array_id", REF_DEC, LAT, START_MHZ, BW_MHZ, 2), "re im")


@query("s16_pointing_grid", "supplier", """
    SELECT CAST(s_suppkey AS BIGINT) AS station, CAST(h * 9 + d AS INT) AS beam_id,
           ROUND(-3e0 + h * 0.5e0, 6) AS ha, ROUND(-2e0 + d * 0.5e0, 6) AS ddec
    FROM supplier, (SELECT UNNEST(RANGE(0, 13)) AS h) a, (SELECT UNNEST(RANGE(0, 9)) AS d) b""")
def _(s):
    """13 x 9 grid of hour angle and declination offsets per station."""
    g = s.select(F.col("s_suppkey").alias("station"), F.explode(F.sequence(F.lit(0), F.lit(12))).alias("h"))
    g = g.withColumn("d", F.explode(F.sequence(F.lit(0), F.lit(8))))
    return g.select("station", (F.col("h") * 9 + F.col("d")).alias("beam_id"),
                    r(F.lit(-3.0) + F.col("h") * 0.5, 6).alias("ha"),
                    r(F.lit(-2.0) + F.col("d") * 0.5, 6).alias("ddec"))


# --- visibilities --------------------------------------------------------------------------
add_view("vx_vis", """
    SELECT CAST(FLOOR(a.sample / 50) AS BIGINT) AS t_idx, a.ant AS ant1, b.ant AS ant2,
           CAST(a.ant * 8 - FLOOR(a.ant * (a.ant + 1) / 2) + b.ant - a.ant - 1 AS INT) AS baseline,
           SUM(a.re * b.re + a.im * b.im) AS re, SUM(a.im * b.re - a.re * b.im) AS im
    FROM fx_voltages a JOIN fx_voltages b ON a.sample = b.sample AND a.ant < b.ant
    GROUP BY 1, 2, 3, 4""", ["fx_voltages"])
add_view("vx_gains", """
    SELECT CAST(c_custkey % 8 AS INT) AS ant, CAST(FLOOR(c_custkey / 8) AS BIGINT) AS calib_id,
           1 + SUM(c_acctbal) / 20011.7e0 AS re, CAST(SUM(c_nationkey - 12) AS DOUBLE) / 41.3e0 AS im
    FROM customer GROUP BY 1, 2""", ["customer"])


def visibilities(v, integration=50):
    return co.correlate_frames(bf.to_frames(v, 8), integration, 8)


@query("j2_correlate", "fx_voltages", """
    SELECT CAST(FLOOR(a.sample / 50) AS BIGINT) AS t_idx, a.ant AS ant1, b.ant AS ant2,
           CAST(a.ant * 8 - FLOOR(a.ant * (a.ant + 1) / 2) + b.ant - a.ant - 1 AS INT) AS baseline,
           ROUND(SUM(a.re * b.re + a.im * b.im), 4) AS re, ROUND(SUM(a.im * b.re - a.re * b.im), 4) AS im
    FROM fx_voltages a JOIN fx_voltages b ON a.sample = b.sample AND a.ant < b.ant
    GROUP BY 1, 2, 3, 4""")
def _(v):
    return rounded(visibilities(v), "re im", 4).select("t_idx", "ant1", "ant2", "baseline", "re", "im")


@query("j2_polarisations", "fx_voltages", """
    SELECT CAST(FLOOR(a.sample / 50) AS BIGINT) AS t_idx, CAST(a.ant // 2 AS INT) AS ant1, CAST(b.ant // 2 AS INT) AS ant2,
           CAST(a.ant % 2 AS INT) AS pol1, CAST(b.ant % 2 AS INT) AS pol2,
           ROUND(SUM(a.re * b.re + a.im * b.im), 4) AS re, ROUND(SUM(a.im * b.re - a.re * b.im), 4) AS im
    FROM fx_voltages a JOIN fx_voltages b ON a.sample = b.sample AND a.ant // 2 < b.ant // 2 GROUP BY 1, 2, 3, 4, 5""")
def _(v):
    """Four products of two polarisations for each pair of four antennas."""
    out = co.correlate_frames(bf.to_frames(v, 8), 50, 4, n_pols=2)
    return rounded(out, "re im", 4).select("t_idx", "ant1", "ant2", "pol1", "pol2", "re", "im")


@query("x2_tumbling_integration", "fx_voltages", """
    SELECT CAST(FLOOR(sample / 32) AS BIGINT) AS win, ant, COUNT(*) AS n, ROUND(SUM(re), 5) AS re,
           ROUND(SUM(im), 5) AS im FROM fx_voltages GROUP BY 1, 2""")
def _(v):
    return v.groupBy(F.floor(F.col("sample") / 32).alias("win"), "ant").agg(
        F.count("*").alias("n"), r(F.sum("re")).alias("re"), r(F.sum("im")).alias("im"))


@query("d10_baselines", "fx_voltages", """
    SELECT DISTINCT CAST(a.ant * 8 - FLOOR(a.ant * (a.ant + 1) / 2) + b.ant - a.ant - 1 AS INT) AS baseline,
           a.ant AS ant1, b.ant AS ant2
    FROM fx_voltages a JOIN fx_voltages b ON a.sample = b.sample AND a.ant < b.ant""")
def _(v):
    ants = v.groupBy().agg(F.max("ant").alias("top"))
    p = ants.select(F.explode(F.sequence(F.lit(0), F.col("top") - 1)).alias("ant1"), "top").select(
        "ant1", F.explode(F.sequence(F.col("ant1") + 1, F.col("top"))).alias("ant2"))
    return p.select(co.baseline_index("ant1", "ant2", 8).alias("baseline"), "ant1", "ant2")


@query("j3_apply_gains", "fx_voltages vx_gains", """
    SELECT v.t_idx, v.baseline,
      ROUND(v.re * (a.re * b.re + a.im * b.im) - v.im * (a.im * b.re - a.re * b.im), 3) AS re,
      ROUND(v.re * (a.im * b.re - a.re * b.im) + v.im * (a.re * b.re + a.im * b.im), 3) AS im
    FROM vx_vis v JOIN vx_gains a ON a.ant = v.ant1 AND a.calib_id = v.t_idx
    JOIN vx_gains b ON b.ant = v.ant2 AND b.calib_id = v.t_idx""", "vx_vis")
def _(v, g):
    """A gain set per snapshot: calibration number = snapshot number."""
    out = co.apply_gains(visibilities(v), g.withColumnRenamed("calib_id", "t_idx"), ["t_idx"])
    return rounded(out, "re im", 3).select("t_idx", "baseline", "re", "im")


@query("j18_geometric_phase", "vx_gains fx_weights", """
    SELECT g.calib_id, g.ant, ROUND(g.re * w.re + g.im * w.im, 5) AS rem_re, ROUND(g.im * w.re - g.re * w.im, 5) AS rem_im,
           ROUND(g.re * w.re - g.im * w.im, 5) AS add_re, ROUND(g.re * w.im + g.im * w.re, 5) AS add_im,
           ROUND((g.re * w.re + g.im * w.im) / (w.re * w.re + w.im * w.im), 5) AS div_re,
           ROUND((g.im * w.re - g.re * w.im) / (w.re * w.re + w.im * w.im), 5) AS div_im
    FROM vx_gains g JOIN fx_weights w ON g.ant = w.ant AND w.beam_id = 2""")
def _(g, w):
    w = w.where("beam_id = 2")
    out = None
    for p, kw in (("rem", {"remove": True}), ("add", {"remove": False}), ("div", {"remove": True, "divide": True})):
        one = rounded(cal.geometric_phase(g, w, **kw), "re im").select(
            "calib_id", "ant", F.col("re").alias(p + "_re"), F.col("im").alias(p + "_im"))
        out = one if out is None else out.join(one, ["calib_id", "ant"])
    return out


@query("a18_transit_peak", "fx_voltages", """
    WITH a AS (SELECT baseline, t_idx, SQRT(re * re + im * im) AS amp FROM vx_vis),
    e AS (SELECT baseline, MIN(t_idx) AS lo, MAX(t_idx) AS hi FROM a WHERE amp > 0 GROUP BY 1),
    s AS (SELECT a.baseline, AVG(amp) AS m, STDDEV_POP(amp) AS sd, MIN(t_idx) AS lo
          FROM a JOIN e ON a.baseline = e.baseline AND t_idx BETWEEN lo AND hi GROUP BY 1),
    c AS (SELECT a.baseline, t_idx - lo AS pos, CASE WHEN ABS(amp - m) < 2 * sd THEN amp ELSE m END AS v
          FROM a JOIN s ON a.baseline = s.baseline),
    k AS (SELECT baseline, pos, ROW_NUMBER() OVER (PARTITION BY baseline ORDER BY v DESC, pos) AS rn FROM c)
    SELECT CAST(baseline AS INT) AS baseline, CAST(pos AS BIGINT) AS peak FROM k WHERE rn = 1""", "vx_vis")
def _(v):
    return co.transit_peaks(visibilities(v))


@query("a18_transit_mean", "fx_voltages", """
    WITH a AS (SELECT baseline, t_idx, SQRT(re * re + im * im) AS amp FROM vx_vis),
    s AS (SELECT baseline, AVG(amp) AS m, STDDEV_POP(amp) AS sd, MIN(t_idx) AS lo FROM a GROUP BY 1),
    c AS (SELECT a.baseline, t_idx - lo AS pos, CASE WHEN ABS(amp - m) < 2 * sd THEN amp ELSE m END AS v
          FROM a JOIN s ON a.baseline = s.baseline),
    k AS (SELECT baseline, pos, ROW_NUMBER() OVER (PARTITION BY baseline ORDER BY v DESC, pos) AS rn FROM c)
    SELECT CAST(FLOOR(AVG(pos)) AS BIGINT) AS vis_peak FROM k WHERE rn = 1""", "vx_vis")
def _(v):
    return co.transit_peak(visibilities(v))


@query("a29_trim_zero_padding", "fx_voltages", """
    WITH p AS (SELECT ant, sample, CASE WHEN sample > 3 * ant AND re > -60 THEN re ELSE 0 END AS re, 0.0 AS im
               FROM fx_voltages),
    e AS (SELECT ant, MIN(sample) AS lo, MAX(sample) AS hi FROM p WHERE re <> 0 GROUP BY ant)
    SELECT p.ant, COUNT(*) AS n, MIN(sample) AS lo, MAX(sample) AS hi
    FROM p JOIN e ON p.ant = e.ant AND sample BETWEEN lo AND hi GROUP BY p.ant""")
def _(v):
    p = v.select("ant", "sample", F.when((F.col("sample") > 3 * F.col("ant")) & (F.col("re") > -60),
                                         F.col("re")).otherwise(0.0).alias("re"), F.lit(0.0).alias("im"))
    return co.trim_zero_padding(p, ["ant"], "sample", leading=True).groupBy("ant").agg(
        F.count("*").alias("n"), F.min("sample").alias("lo"), F.max("sample").alias("hi"))


@query("a25_gain_statistics", "vx_gains", """
    WITH g AS (SELECT *, SQRT(re * re + im * im) AS amp, DEGREES(ATAN2(im, re)) AS ph FROM vx_gains)
    SELECT calib_id, ant, ROUND(amp, 6) AS amplitude, ROUND(10 * LOG10(amp), 5) AS amplitude_db,
           ROUND(ph, 5) AS phase, CAST(ant // 4 + 1 AS VARCHAR) || '-' || CAST(ant % 4 + 1 AS VARCHAR) AS antenna_id,
           ROUND(amp - AVG(amp) OVER (PARTITION BY ant), 5) AS d_amplitude,
           ROUND(ph - AVG(ph) OVER (PARTITION BY ant), 5) AS d_phase FROM g""")
def _(g):
    out = cal.gain_statistics(g)
    return rounded(rounded(out, "amplitude", 6), "amplitude_db phase d_amplitude d_phase").select(
        "calib_id", "ant", "amplitude", "amplitude_db", "phase", "antenna_id", "d_amplitude", "d_phase")


@query("a26_gain_amplitudes", "fx_voltages", """
    WITH e AS (SELECT t_idx, ant1 AS ant, LN(1 + ABS(re)) / 40 AS v FROM vx_vis
               UNION ALL SELECT t_idx, ant2, LN(1 + ABS(re)) / 40 FROM vx_vis),
    s AS (SELECT t_idx, ant, SUM(v) AS s FROM e GROUP BY 1, 2),
    x AS (SELECT t_idx, ant, POWER(10, (s - SUM(s) OVER (PARTITION BY t_idx) / 2 / 7) / 6) AS g FROM s),
    o AS (SELECT *, AVG(g) OVER (PARTITION BY t_idx) AS m, STDDEV_POP(g) OVER (PARTITION BY t_idx) AS sd FROM x)
    SELECT t_idx, ant, ROUND(CASE WHEN ABS(g - m) > 2 * sd THEN 1 ELSE g END, 6) AS gain FROM o""", "vx_vis")
def _(v):
    """Pair powers are compressed to (1 + |re|)^(1/40) first, to keep 10^x within doubles."""
    vis = visibilities(v).withColumn("re", F.exp(F.log(1 + F.abs("re")) / 40))
    return rounded(cal.solve_gain_amplitudes(vis, 8), "gain", 6)


@query("a26_reference_phases", "fx_voltages", """
    WITH t AS (SELECT t_idx, re AS tr, im AS ti FROM (
                 SELECT *, ROW_NUMBER() OVER (PARTITION BY t_idx ORDER BY re DESC, im DESC) AS rn FROM vx_vis)
               WHERE rn = 1),
    q AS (SELECT v.t_idx, v.ant2 AS ant, (tr * re + ti * im) / (re * re + im * im) AS re,
                 -(ti * re - tr * im) / (re * re + im * im) AS im
          FROM vx_vis v JOIN t ON v.t_idx = t.t_idx WHERE ant1 = 0
          UNION ALL SELECT t_idx, 0, 1.0, 0.0 FROM t),
    o AS (SELECT *, AVG(re) OVER w AS m, SQRT(AVG(re * re + im * im) OVER w
            - (AVG(re) OVER w) * (AVG(re) OVER w) - (AVG(im) OVER w) * (AVG(im) OVER w)) AS sd
          FROM q WINDOW w AS (PARTITION BY t_idx))
    SELECT t_idx, ant, ROUND(CASE WHEN m - 2 * sd > re OR m + 2 * sd < re THEN 1 ELSE re END, 5) AS re,
           ROUND(CASE WHEN m - 2 * sd > re OR m + 2 * sd < re THEN 0 ELSE im END, 5) AS im FROM o""", "vx_vis")
def _(v):
    return rounded(cal.solve_reference_phases(visibilities(v)), "re im")


@query("a27_iterative_gains", "fx_voltages")
def _(v):
    """Iterative solution; checked against its own normal equations in the tests."""
    return rounded(cal.solve_gains(visibilities(v), 8), "re im")


@query("s12_visibility_scan", "fx_voltages", """
    SELECT t_idx, baseline, ROUND(re, 4) AS re, ROUND(im, 4) AS im FROM vx_vis""", "vx_vis")
def _(v):
    return rounded(visibilities(v), "re im", 4).select("t_idx", "baseline", "re", "im")


@query("c20_fringes", "fx_voltages", """
    SELECT baseline, t_idx, ROUND(SQRT(re * re + im * im), 4) AS amplitude,
           ROUND(DEGREES(ATAN2(im, re)), 5) AS phase FROM vx_vis""", "vx_vis")
def _(v):
    return visibilities(v).select("baseline", "t_idx", r(cplx.cabs("re", "im"), 4).alias("amplitude"),
                                  r(F.degrees(cplx.carg("re", "im"))).alias("phase"))


@query("f1_complex_algebra", "vx_gains", """
    SELECT a.calib_id, a.ant, ROUND(a.re * b.re - a.im * b.im, 6) AS mul_re, ROUND(a.re * b.im + a.im * b.re, 6) AS mul_im,
           ROUND(SQRT(a.re * a.re + a.im * a.im), 6) AS abs, ROUND(ATAN2(a.im, a.re), 6) AS arg
    FROM vx_gains a JOIN vx_gains b ON a.calib_id = b.calib_id AND b.ant = 0""")
def _(g):
    b = g.where("ant = 0").select("calib_id", F.col("re").alias("bre"), F.col("im").alias("bim"))
    mre, mim = cplx.cmul("re", "im", "bre", "bim")
    return g.join(b, "calib_id").select(
        "calib_id", "ant", r(mre, 6).alias("mul_re"), r(mim, 6).alias("mul_im"),
        r(cplx.cabs("re", "im"), 6).alias("abs"), r(cplx.carg("re", "im"), 6).alias("arg"))


@query("k13_gain_text", "vx_gains", """
    SELECT 'raw' AS stage, calib_id, ant, printf('%.12e%+.12ej', re, im) AS line FROM vx_gains""")
def _(g):
    from skysieve.sinks.tables import gain_lines
    return gain_lines(g, "raw", ["calib_id"], 12)


@query("s15_gain_text_scan", "vx_gains", """
    SELECT calib_id, ant, ROUND(re, 10) AS re, ROUND(im, 10) AS im FROM vx_gains""")
def _(g):
    """Parse the complex text form back into numbers."""
    from skysieve.sinks.tables import gain_lines
    from skysieve.sources.tables import parse_complex
    return parse_complex(gain_lines(g, "raw", ["calib_id"]), "line").select(
        "calib_id", "ant", r("re", 10).alias("re"), r("im", 10).alias("im"))

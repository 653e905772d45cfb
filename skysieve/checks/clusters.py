"""Partitioning, clustering and streak detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import add_view, query
from skysieve.checks.signal import r, rounded
from skysieve.functions import regression as rg
from skysieve.operators import dbscan as db, evaluate as ev, graph, hough, partition as pt, streaks as st
from skysieve.session import cut

NC, NT = 64, 160

# falling lines (events) over scattered pixels (orders)
add_view("fx_streaks", """
    SELECT iter, beam_id, channel_sample, time_idx, MAX(power) AS power FROM (
      SELECT CAST(FLOOR(event_id / 2500) AS BIGINT) AS iter, CAST(user_id % 8 AS INT) AS beam_id,
             CAST(63 - FLOOR((event_id % 160) * 4 / 10) AS INT) AS channel_sample,
             CAST(event_id % 160 AS INT) AS time_idx, 4000 + FLOOR(8 * value) / 8 AS power FROM events
      UNION ALL
      SELECT CAST(FLOOR(o_orderkey / 2500) AS BIGINT), CAST(o_custkey % 8 AS INT),
             CAST(FLOOR(o_totalprice) % 64 AS INT), CAST(o_orderkey % 160 AS INT),
             FLOOR(o_totalprice) / 512 FROM orders) u
    GROUP BY 1, 2, 3, 4""", ["events", "orders"])
add_view("vx_leaves", """
    WITH RECURSIVE part AS (
      SELECT iter, beam_id, channel_sample, time_idx, power, CAST(1 AS BIGINT) AS leaf,
             0e0 AS x1, 160e0 AS x2, 0e0 AS y1, 64e0 AS y2, COUNT(*) OVER g AS n,
             MIN(channel_sample) OVER g AS c0, MAX(channel_sample) OVER g AS c1,
             MIN(time_idx) OVER g AS t0, MAX(time_idx) OVER g AS t1
      FROM fx_streaks WINDOW g AS (PARTITION BY iter, beam_id)
      UNION ALL
      SELECT iter, beam_id, channel_sample, time_idx, power, leaf, x1, x2, y1, y2, COUNT(*) OVER g,
             MIN(channel_sample) OVER g, MAX(channel_sample) OVER g, MIN(time_idx) OVER g, MAX(time_idx) OVER g
      FROM (SELECT iter, beam_id, channel_sample, time_idx, power, leaf * 2 + CASE WHEN v > cut THEN 1 ELSE 0 END AS leaf,
              CASE WHEN NOT wide AND v > cut THEN cut ELSE x1 END AS x1, CASE WHEN NOT wide AND v <= cut THEN cut ELSE x2 END AS x2,
              CASE WHEN wide AND v > cut THEN cut ELSE y1 END AS y1, CASE WHEN wide AND v <= cut THEN cut ELSE y2 END AS y2
            FROM (SELECT *, CASE WHEN wide THEN (c0 + c1) / 2e0 ELSE (t0 + t1) / 2e0 END AS cut,
                         CASE WHEN wide THEN channel_sample ELSE time_idx END AS v
                  FROM (SELECT *, c1 - c0 >= t1 - t0 AS wide FROM part WHERE n > 40)))
      WINDOW g AS (PARTITION BY iter, beam_id, leaf))
    SELECT iter, beam_id, channel_sample, time_idx, power, leaf, x1, x2, y1, y2 FROM part WHERE n <= 40""", ["fx_streaks"])
add_view("vx_gated", """
    SELECT l.*, CAST(channel_sample * 160 + time_idx AS BIGINT) AS p FROM vx_leaves l
    JOIN (SELECT iter, beam_id, leaf, AVG(power) AS m FROM vx_leaves GROUP BY 1, 2, 3 HAVING COUNT(*) > 2) s
      ON l.iter = s.iter AND l.beam_id = s.beam_id AND l.leaf = s.leaf
    JOIN (SELECT iter, beam_id, AVG(power) / 8 AS bn FROM fx_streaks GROUP BY 1, 2) b
      ON l.iter = b.iter AND l.beam_id = b.beam_id
    WHERE power > m - bn * POWER(10, 0.5)""", ["vx_leaves", "fx_streaks"])
add_view("vx_leaf_edges", f"""
    SELECT a.iter, a.beam_id, a.leaf, a.p AS src, b.p AS dst FROM vx_gated a JOIN vx_gated b
      ON a.iter = b.iter AND a.beam_id = b.beam_id AND a.leaf = b.leaf AND b.time_idx > a.time_idx
    WHERE (a.channel_sample = b.channel_sample AND b.time_idx - a.time_idx = 1)
       OR (b.channel_sample < a.channel_sample
           AND (b.channel_sample - a.channel_sample) / (b.time_idx - a.time_idx) >= {st.MIN_SLOPE!r}
           AND (b.channel_sample - a.channel_sample) * (b.channel_sample - a.channel_sample)
             + (b.time_idx - a.time_idx) * (b.time_idx - a.time_idx) <= 16)""", ["vx_gated"])


def _cc(nodes, edges, keys):
    k = ", ".join(keys)

    def on(a, b):
        return " AND ".join(f"{a}.{x} = {b}.{x}" for x in keys)

    ek = ", ".join("e." + x for x in keys)
    return f"""
    WITH RECURSIVE sym AS (SELECT {k}, src, dst FROM {edges} UNION ALL SELECT {k}, dst, src FROM {edges}),
    cc({k}, p, comp) USING KEY ({k}, p) AS (
      SELECT {k}, p, p FROM {nodes}
      UNION
      SELECT {ek}, e.dst, MIN(cc.comp) FROM cc JOIN sym e ON {on('cc', 'e')} AND e.src = cc.p
      JOIN recurring.cc cur ON {on('cur', 'e')} AND cur.p = e.dst WHERE cc.comp < cur.comp GROUP BY {ek}, e.dst)
    SELECT {k}, p, comp FROM cc"""


add_view("vx_comps", f"""
    SELECT g.*, c.comp FROM vx_gated g JOIN ({_cc('vx_gated', 'vx_leaf_edges', ['iter', 'beam_id', 'leaf'])}) c
      ON g.iter = c.iter AND g.beam_id = c.beam_id AND g.leaf = c.leaf AND g.p = c.p""", ["vx_gated", "vx_leaf_edges"])
add_view("vx_leaf_clusters", """
    WITH s AS (SELECT iter, beam_id, leaf, comp, COUNT(*) AS n, COUNT(DISTINCT time_idx) AS td, COUNT(DISTINCT channel_sample) AS cd,
        MIN(time_idx) AS t0, MAX(time_idx) AS t1, MIN(channel_sample) AS c0, MAX(channel_sample) AS c1,
        VAR_SAMP(time_idx) AS vt, VAR_SAMP(channel_sample) AS vc, COVAR_SAMP(time_idx, channel_sample) AS cov,
        SUM(time_idx * power) / SUM(power) AS t_mean, SUM(channel_sample * power) / SUM(power) AS c_mean,
        MIN(x1) AS x1, MIN(x2) AS x2, MIN(y1) AS y1, MIN(y2) AS y2 FROM vx_comps GROUP BY 1, 2, 3, 4),
    q AS (SELECT *, CASE WHEN n >= 20 OR cd = 1 THEN NULL WHEN cov = 0 THEN 1
            ELSE ABS(((vt + vc) / 2 - SQRT((vt - vc) * (vt - vc) / 4 + cov * cov))
                   / ((vt + vc) / 2 + SQRT((vt - vc) * (vt - vc) / 4 + cov * cov))) * SIGN(cov) END AS ratio
          FROM s WHERE n >= 5 AND NOT ((t1 - t0 + 1 - td) / n > 0.5 AND (c1 - c0 + 1 - cd) / n > 0.5)),
    u AS (SELECT iter, beam_id, leaf, comp, channel_sample, MIN(time_idx) AS time_idx FROM (
            SELECT iter, beam_id, leaf, comp, time_idx, MIN(channel_sample) AS channel_sample FROM vx_comps GROUP BY 1, 2, 3, 4, 5)
          GROUP BY 1, 2, 3, 4, 5),
    g AS (SELECT iter, beam_id, leaf, comp, CASE WHEN COUNT(*) > 1 THEN VAR_SAMP(time_idx)
                 / (COVAR_SAMP(time_idx, channel_sample) + 1e-9) END AS grad FROM u GROUP BY 1, 2, 3, 4)
    SELECT q.*, CASE WHEN ratio IS NOT NULL THEN grad END AS slope FROM q
    JOIN g ON q.iter = g.iter AND q.beam_id = g.beam_id AND q.leaf = g.leaf AND q.comp = g.comp
    WHERE ratio IS NULL OR ratio BETWEEN -0.15 AND 0""", ["vx_comps"])


def beam_level(p):
    return p.groupBy("iter", "beam_id").agg((F.avg("power") / 8).alias("beam_noise"))


def leaves(p):
    return pt.kd_partition(p, NC, NT)


def gated(p):
    return pt.leaf_gate(leaves(p), beam_level(p))


def components(p):
    return st.leaf_components(gated(p), NT)


def pieces(p):
    """Leaf clusters; their components are read twice and written once."""
    return st.leaf_clusters(cut(components(p)))


@query("c8_space_partition", "fx_streaks", "SELECT * FROM vx_leaves", "vx_leaves")
def _(p):
    return leaves(p).drop("node")


@query("p13_leaf_gate", "fx_streaks", """
    SELECT iter, beam_id, leaf, channel_sample, time_idx, power FROM vx_gated""", "vx_gated")
def _(p):
    return gated(p).select("iter", "beam_id", "leaf", "channel_sample", "time_idx", "power")


@query("j9_leaf_edges", "fx_streaks", "SELECT iter, beam_id, leaf, src, dst FROM vx_leaf_edges", "vx_leaf_edges")
def _(p):
    e = st.leaf_edges(gated(p))
    return e.select("iter", "beam_id", "leaf", (F.col("c1") * NT + F.col("t1")).cast("bigint").alias("src"),
                    (F.col("c2") * NT + F.col("t2")).cast("bigint").alias("dst"))


@query("c9_leaf_components", "fx_streaks", """
    SELECT iter, beam_id, leaf, p, comp FROM vx_comps""", "vx_comps")
def _(p):
    return components(p).select("iter", "beam_id", "leaf", (F.col("channel_sample") * NT + F.col("time_idx")).cast("bigint").alias("p"), "comp")


@query("c9_connected_components", "fx_streaks", _cc("vx_gated", "vx_leaf_edges", ["iter", "beam_id", "leaf"]),
       "vx_gated vx_leaf_edges")
def _(p):
    """The same components by distributed star contraction."""
    g = cut(gated(p)).withColumn("p", (F.col("channel_sample") * NT + F.col("time_idx")).cast("bigint"))
    e = st.leaf_edges(g).select("iter", "beam_id", "leaf", (F.col("c1") * NT + F.col("t1")).cast("bigint").alias("src"),
                                (F.col("c2") * NT + F.col("t2")).cast("bigint").alias("dst"))
    out = graph.label_nodes(g.select("iter", "beam_id", "leaf", "p"), e, "p", ["iter", "beam_id", "leaf"])
    return out.withColumnRenamed("component", "comp")


@query("a6_leaf_clusters", "fx_streaks", """
    SELECT iter, beam_id, leaf, comp, n, ROUND(ratio, 6) AS ratio, ROUND(slope, 5) AS slope, ROUND(t_mean, 5) AS t_mean,
           ROUND(c_mean, 5) AS c_mean FROM vx_leaf_clusters""", "vx_leaf_clusters")
def _(p):
    """Inertia ratio, missing scores, slope and weighted centroid of accepted leaf clusters."""
    out = rounded(rounded(pieces(p), "ratio", 6), "slope t_mean c_mean")
    return out.select("iter", "beam_id", "leaf", "comp", "n", "ratio", "slope", "t_mean", "c_mean")


@query("a5_inertia_ratio", "fx_streaks", """
    WITH s AS (SELECT iter, beam_id, leaf, COUNT(*) AS n, COUNT(DISTINCT channel_sample) AS cd, VAR_SAMP(time_idx) AS vt,
                      VAR_SAMP(channel_sample) AS vc, COVAR_SAMP(time_idx, channel_sample) AS cov
               FROM vx_leaves GROUP BY 1, 2, 3 HAVING COUNT(*) > 2)
    SELECT iter, beam_id, leaf, n, ROUND(CASE WHEN n >= 20 OR cd = 1 THEN NULL WHEN cov = 0 THEN 1
            ELSE ABS(((vt + vc) / 2 - SQRT((vt - vc) * (vt - vc) / 4 + cov * cov))
                   / ((vt + vc) / 2 + SQRT((vt - vc) * (vt - vc) / 4 + cov * cov))) * SIGN(cov) END, 6) AS ratio FROM s""",
       "vx_leaves")
def _(p):
    s = leaves(p).groupBy("iter", "beam_id", "leaf").agg(
        F.count("*").alias("n"), F.count_distinct("channel_sample").alias("cd"), F.var_samp("time_idx").alias("vt"),
        F.var_samp("channel_sample").alias("vc"), F.covar_samp("time_idx", "channel_sample").alias("cov")).where("n > 2")
    return s.select("iter", "beam_id", "leaf", "n", r(rg.inertia_ratio("vt", "vc", "cov", "n", "cd"), 6).alias("ratio"))


@query("a7_leaf_slope", "fx_streaks", """
    WITH u AS (SELECT iter, beam_id, leaf, channel_sample, MIN(time_idx) AS time_idx FROM (
            SELECT iter, beam_id, leaf, time_idx, MIN(channel_sample) AS channel_sample FROM vx_leaves GROUP BY 1, 2, 3, 4)
          GROUP BY 1, 2, 3, 4)
    SELECT iter, beam_id, leaf, ROUND(CASE WHEN COUNT(*) > 1 THEN VAR_SAMP(time_idx)
           / (COVAR_SAMP(time_idx, channel_sample) + 1e-9) END, 4) AS slope FROM u
    GROUP BY 1, 2, 3 HAVING COUNT(*) = 1 OR ABS(COVAR_SAMP(time_idx, channel_sample)) > 1e-6""", "vx_leaves")
def _(p):
    ident = ["iter", "beam_id", "leaf"]
    s = st.leaf_slopes(leaves(p), ident)
    # a covariance of zero leaves only the small constant in the divisor: not comparable
    return s.where("_slope IS NULL OR abs(_slope) < 1e8").select(*ident, r("_slope", 4).alias("slope"))


@query("a8_power_centroid", "fx_streaks", """
    SELECT iter, beam_id, leaf, ROUND(SUM(time_idx * power) / SUM(power), 5) AS t_mean,
           ROUND(SUM(channel_sample * power) / SUM(power), 5) AS c_mean FROM vx_leaves GROUP BY 1, 2, 3""", "vx_leaves")
def _(p):
    return leaves(p).groupBy("iter", "beam_id", "leaf").agg(
        r(F.sum(F.col("time_idx") * F.col("power")) / F.sum("power")).alias("t_mean"),
        r(F.sum(F.col("channel_sample") * F.col("power")) / F.sum("power")).alias("c_mean"))


@query("a15_merge_radius", "fx_streaks", """
    SELECT iter, beam_id, ROUND(1.5 * MEDIAN(SQRT((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))), 5) AS eps
    FROM vx_leaf_clusters GROUP BY 1, 2""", "vx_leaf_clusters")
def _(p):
    return rounded(st.merge_radius(pieces(p)), "eps")


_MERGE = f"""
    WITH e AS (SELECT iter, beam_id, 1.5 * MEDIAN(SQRT((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))) AS eps
               FROM vx_leaf_clusters GROUP BY 1, 2),
    k AS (SELECT *, CAST(leaf * 20000 + comp AS BIGINT) AS p FROM vx_leaf_clusters),
    d AS (SELECT a.iter, a.beam_id, a.p AS src, b.p AS dst, a.slope AS s1, b.slope AS s2, a.t_mean AS ta, a.c_mean AS ca,
                 b.t_mean AS tb, b.c_mean AS cb, (a.t_mean - b.t_mean + 1e-6) / (a.c_mean - b.c_mean + 1e-6) AS v
          FROM k a JOIN k b ON a.iter = b.iter AND a.beam_id = b.beam_id AND a.p < b.p JOIN e ON e.iter = a.iter AND e.beam_id = a.beam_id
          WHERE SQRT((a.t_mean - b.t_mean) * (a.t_mean - b.t_mean) + (a.c_mean - b.c_mean) * (a.c_mean - b.c_mean)) <= eps),
    m AS (SELECT *, (v + s1 + s2) / 3 AS mu FROM d WHERE v <= 0 AND v >= {st.MIN_SLOPE!r}),
    edges AS (SELECT * FROM m WHERE s1 IS NULL OR s2 IS NULL OR
                SQRT(((v - mu) * (v - mu) + (s1 - mu) * (s1 - mu) + (s2 - mu) * (s2 - mu)) / 3) / ABS(mu) <= 0.3)"""


@query("j10_merge_edges", "fx_streaks", _MERGE + """
    SELECT iter, beam_id, ROUND(LEAST(ta, tb), 4) AS t0, ROUND(GREATEST(ta, tb), 4) AS t1 FROM edges""", "vx_leaf_clusters")
def _(p):
    k = cut(pieces(p))
    e = st.merge_edges(k)
    c = st.with_cluster_id(k, ["iter", "beam_id"]).select("iter", "beam_id", "cid", "t_mean")
    out = e.join(c.withColumnsRenamed({"cid": "src", "t_mean": "ta"}), ["iter", "beam_id", "src"]).join(
        c.withColumnsRenamed({"cid": "dst", "t_mean": "tb"}), ["iter", "beam_id", "dst"])
    return out.select("iter", "beam_id", r(F.least("ta", "tb"), 4).alias("t0"), r(F.greatest("ta", "tb"), 4).alias("t1"))


@query("a9_merged_groups", "fx_streaks", _MERGE.replace("WITH e AS", "WITH RECURSIVE e AS") + """,
    sym AS (SELECT iter, beam_id, src, dst FROM edges UNION ALL SELECT iter, beam_id, dst, src FROM edges),
    cc(iter, beam_id, p, comp) USING KEY (iter, beam_id, p) AS (
      SELECT iter, beam_id, p, p FROM k
      UNION
      SELECT e.iter, e.beam_id, e.dst, MIN(cc.comp) FROM cc JOIN sym e ON cc.iter = e.iter AND cc.beam_id = e.beam_id AND e.src = cc.p
      JOIN recurring.cc cur ON cur.iter = e.iter AND cur.beam_id = e.beam_id AND cur.p = e.dst
      WHERE cc.comp < cur.comp GROUP BY e.iter, e.beam_id, e.dst),
    g AS (SELECT iter, beam_id, comp, COUNT(*) AS n FROM cc GROUP BY 1, 2, 3),
    t AS (SELECT iter, beam_id, COUNT(*) AS total FROM k GROUP BY 1, 2)
    SELECT g.iter, g.beam_id, n AS leaves FROM g JOIN t ON g.iter = t.iter AND g.beam_id = t.beam_id
    WHERE n >= 2 OR total = 1""", "vx_leaf_clusters")
def _(p):
    """Sizes of the merged groups per image."""
    g = st.merged_groups(cut(pieces(p)))
    return g.groupBy("iter", "beam_id", "group_id").agg(F.count("*").alias("leaves")).drop("group_id")


@query("c11_streak_detector", "fx_streaks")
def _(p):
    return st.detect_streaks(p, beam_level(p), NC, NT)


@query("c12_robust_lines", "fx_streaks")
def _(p):
    """Inliers of the best line through the bright and through the faint pixels of each image."""
    pts = p.withColumn("group_id", F.when(F.col("power") >= 4000, 1).otherwise(2))
    return st.robust_lines(pts, ["iter", "beam_id", "group_id"])


# --- DBSCAN --------------------------------------------------------------------------------
add_view("vx_eps_pairs", """
    SELECT a.iter, a.beam_id, a.channel_sample * 160 + a.time_idx AS src, b.channel_sample * 160 + b.time_idx AS dst
    FROM (SELECT *, UNNEST(RANGE(-5, 6)) AS dc FROM fx_streaks) a JOIN fx_streaks b
      ON a.iter = b.iter AND a.beam_id = b.beam_id AND b.channel_sample = a.channel_sample + dc
     AND b.time_idx BETWEEN a.time_idx - 5 AND a.time_idx + 5
    WHERE dc * dc + (a.time_idx - b.time_idx) * (a.time_idx - b.time_idx) <= 25""", ["fx_streaks"])
add_view("vx_dbscan", """
    WITH RECURSIVE core AS (SELECT iter, beam_id, src AS p FROM vx_eps_pairs GROUP BY 1, 2, 3 HAVING COUNT(*) >= 5),
    ce AS (SELECT e.* FROM vx_eps_pairs e JOIN core a ON a.iter = e.iter AND a.beam_id = e.beam_id AND a.p = e.src
           JOIN core b ON b.iter = e.iter AND b.beam_id = e.beam_id AND b.p = e.dst),
    cc(iter, beam_id, p, comp) USING KEY (iter, beam_id, p) AS (
      SELECT iter, beam_id, p, p FROM core
      UNION
      SELECT e.iter, e.beam_id, e.dst, MIN(cc.comp) FROM cc JOIN ce e ON cc.iter = e.iter AND cc.beam_id = e.beam_id AND e.src = cc.p
      JOIN recurring.cc cur ON cur.iter = e.iter AND cur.beam_id = e.beam_id AND cur.p = e.dst
      WHERE cc.comp < cur.comp GROUP BY e.iter, e.beam_id, e.dst)
    SELECT e.iter, e.beam_id, CAST(e.src // 160 AS INT) AS channel_sample, CAST(e.src % 160 AS INT) AS time_idx,
           CAST(COALESCE(MIN(own.comp), MIN(cc.comp)) AS BIGINT) AS cluster_id, MIN(own.comp) IS NOT NULL AS core
    FROM vx_eps_pairs e JOIN cc ON cc.iter = e.iter AND cc.beam_id = e.beam_id AND cc.p = e.dst
    LEFT JOIN cc own ON own.iter = e.iter AND own.beam_id = e.beam_id AND own.p = e.src
    GROUP BY 1, 2, e.src""", ["vx_eps_pairs"])


@query("j8_eps_neighbours", "fx_streaks", """
    SELECT iter, beam_id, src, dst FROM vx_eps_pairs WHERE src < dst""", "vx_eps_pairs")
def _(p):
    pts = p.withColumn("ident", F.col("channel_sample") * NT + F.col("time_idx"))
    e = graph.neighbour_pairs(pts, ["iter", "beam_id"], ["channel_sample", "time_idx"], 5, "ident")
    return e.select("iter", "beam_id", F.col("a_ident").alias("src"), F.col("b_ident").alias("dst"))


@query("j8_eps_neighbours_3d", "fx_streaks", """
    SELECT e.iter, e.beam_id, COUNT(*) AS n FROM vx_eps_pairs e
    JOIN fx_streaks a ON a.iter = e.iter AND a.beam_id = e.beam_id AND a.channel_sample * 160 + a.time_idx = e.src
    JOIN fx_streaks b ON b.iter = e.iter AND b.beam_id = e.beam_id AND b.channel_sample * 160 + b.time_idx = e.dst
    WHERE src < dst AND (a.channel_sample - b.channel_sample) * (a.channel_sample - b.channel_sample)
      + (a.time_idx - b.time_idx) * (a.time_idx - b.time_idx) + (a.power - b.power) * (a.power - b.power) <= 25
    GROUP BY 1, 2""", "vx_eps_pairs")
def _(p):
    return db.dbscan_3d_pairs(p, 5.0).groupBy("iter", "beam_id").agg(F.count("*").alias("n"))


def clusters(p):
    return db.dbscan(p, NC, NT, tile=32)


@query("c10_dbscan", "fx_streaks", "SELECT * FROM vx_dbscan", "vx_dbscan")
def _(p):
    return clusters(p).select("iter", "beam_id", "channel_sample", "time_idx", "cluster_id", "core")


@query("p16_cluster_validity", "fx_streaks", """
    SELECT iter, beam_id, cluster_id, COUNT(*) AS n, ROUND(REGR_SLOPE(channel_sample, time_idx), 5) AS slope,
           ROUND(CORR(channel_sample, time_idx), 6) AS r FROM vx_dbscan GROUP BY 1, 2, 3
    HAVING COUNT(*) >= 3 AND ABS(CORR(channel_sample, time_idx)) >= 0.5
       AND REGR_SLOPE(channel_sample, time_idx) * (10.43081283569336 / 0.0958698057142857) BETWEEN -291.47 AND -1""", "vx_dbscan")
def _(p):
    fits = db.cluster_fits(db.dbscan(p, NC, NT), ["iter", "beam_id"])
    ok = db.valid_clusters(fits, st.CHANNEL_HZ, st.SAMPLING_TIME, 0.5, (-1.0, -291.47))
    return rounded(rounded(ok, "slope"), "r", 6).select("iter", "beam_id", "cluster_id", "n", "slope", "r")


@query("p18_loose_validity", "fx_streaks", """
    SELECT iter, beam_id, cluster_id, COUNT(*) AS n, ROUND(CORR(channel_sample, time_idx), 6) AS r
    FROM vx_dbscan GROUP BY 1, 2, 3 HAVING CORR(channel_sample, time_idx) < -0.9 AND (COUNT(*) >= 5
      OR (COUNT(*) = 4 AND 1 - ABS(CORR(channel_sample, time_idx)) <= 0.05)
      OR (COUNT(*) = 3 AND 1 - 2 * ASIN(LEAST(ABS(CORR(channel_sample, time_idx)), 1)) / PI() <= 0.05))""", "vx_dbscan")
def _(p):
    fits = db.loosely_valid(db.cluster_fits(db.dbscan(p, NC, NT), ["iter", "beam_id"]))
    return rounded(fits, "r", 6).select("iter", "beam_id", "cluster_id", "n", "r")


@query("p17_streak_validity", "fx_streaks", """
    WITH s AS (SELECT iter, beam_id, COUNT(*) AS n, CORR(channel_sample, time_idx) AS r,
      (MAX(time_idx) - MIN(time_idx) + 1 - COUNT(DISTINCT time_idx)) / COUNT(*) AS tm,
      (MAX(channel_sample) - MIN(channel_sample) + 1 - COUNT(DISTINCT channel_sample)) / COUNT(*) AS cm
      FROM fx_streaks GROUP BY 1, 2, power >= 4000)
    SELECT iter, beam_id, n, ROUND(r, 6) AS r, ROUND(tm, 6) AS t_missing, ROUND(cm, 6) AS c_missing FROM s
    WHERE NOT (tm > 0.5 AND cm > 0.5) AND r <= -0.99
      AND (n >= 5 OR (n = 4 AND 1 - ABS(r) <= 0.01) OR (n = 3 AND 1 - 2 * ASIN(ABS(r)) / PI() <= 0.01))""")
def _(p):
    """Bright and faint pixels of an image are a group each."""
    q = st.valid_streaks(st.streak_quality(p.withColumn("bright", F.col("power") >= 4000), ["iter", "beam_id", "bright"]))
    return rounded(q, "r t_missing c_missing", 6).drop("slope", "bright")


@query("c19_compare_detectors", "fx_streaks", """
    SELECT 'dbscan' AS algorithm, iter, beam_id, cluster_id, COUNT(*) AS n, COUNT(DISTINCT time_idx) AS n_times,
           COUNT(DISTINCT channel_sample) AS n_channels FROM vx_dbscan GROUP BY 2, 3, 4
    UNION ALL SELECT 'leaf', iter, beam_id, leaf, COUNT(*), COUNT(DISTINCT time_idx), COUNT(DISTINCT channel_sample)
    FROM vx_leaves GROUP BY 2, 3, 4""", "vx_dbscan vx_leaves")
def _(p):
    return ev.compare_detectors({
        "dbscan": db.dbscan(p, NC, NT),
        "leaf": leaves(p).withColumn("cluster_id", F.col("leaf"))}, ["iter", "beam_id"])


# --- Hough ---------------------------------------------------------------------------------
_RHO = "CAST(FLOOR(time_idx * COS(-PI() / 2 + k * (PI() / 179)) + channel_sample * SIN(-PI() / 2 + k * (PI() / 179)) + 0.5) AS INT)"
_POS = "CAST(FLOOR(channel_sample * COS(-PI() / 2 + k * (PI() / 179)) - time_idx * SIN(-PI() / 2 + k * (PI() / 179)) + 0.5) AS INT)"


@query("c14_hough_votes", "fx_streaks", f"""
    SELECT iter, beam_id, CAST(k AS INT) AS theta, {_RHO} AS rho, COUNT(*) AS votes
    FROM (SELECT *, UNNEST(RANGE(0, 180)) AS k FROM fx_streaks) GROUP BY 1, 2, 3, 4""")
def _(p):
    return hough.votes(p)


@query("c14_hough_segments", "fx_streaks", f"""
    WITH x AS (SELECT *, CAST(k AS INT) AS theta, {_RHO} AS rho, {_POS} AS pos
               FROM (SELECT *, UNNEST(RANGE(0, 180)) AS k FROM fx_streaks)),
    v AS (SELECT *, COUNT(*) OVER (PARTITION BY iter, beam_id, theta, rho) AS votes FROM x),
    g AS (SELECT *, pos - LAG(pos) OVER w AS gap FROM v WHERE votes >= 10
          WINDOW w AS (PARTITION BY iter, beam_id, theta, rho ORDER BY pos, channel_sample, time_idx)),
    s AS (SELECT *, SUM(CASE WHEN gap > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY iter, beam_id, theta, rho
                 ORDER BY pos, channel_sample, time_idx ROWS UNBOUNDED PRECEDING) AS segment FROM g)
    SELECT iter, beam_id, theta, rho, CAST(segment AS BIGINT) AS segment, COUNT(*) AS n,
           ARG_MIN(time_idx, (pos, channel_sample, time_idx)) AS t0, ARG_MIN(channel_sample, (pos, channel_sample, time_idx)) AS c0,
           ARG_MAX(time_idx, (pos, channel_sample, time_idx)) AS t1, ARG_MAX(channel_sample, (pos, channel_sample, time_idx)) AS c1
    FROM s GROUP BY 1, 2, 3, 4, 5 HAVING MAX(pos) - MIN(pos) >= 5""")
def _(p):
    return hough.segments(p)


add_view("vx_leaf_boxes", """
    SELECT c_custkey AS id, CAST(c_custkey % 160 AS INT) AS t0, CAST((c_custkey * 7) % 160 AS INT) AS t1,
           CAST(c_nationkey AS INT) AS c0, CAST(60 - c_nationkey AS INT) AS c1 FROM customer""", ["customer"])


@query("e6_rasterise", "vx_leaf_boxes", """
    SELECT id, CAST(FLOOR(t0 + CASE WHEN n > 0 THEN k / n ELSE 0 END * (t1 - t0) + 0.5) AS INT) AS time_idx,
           CAST(FLOOR(c0 + CASE WHEN n > 0 THEN k / n ELSE 0 END * (c1 - c0) + 0.5) AS INT) AS channel_sample
    FROM (SELECT *, UNNEST(RANGE(0, n + 1)) AS k FROM (
      SELECT *, GREATEST(ABS(t1 - t0), ABS(c1 - c0)) AS n FROM vx_leaf_boxes))""")
def _(b):
    return hough.rasterise(b).select("id", "time_idx", "channel_sample")


add_view("vx_targets", """
    SELECT CAST(s_suppkey AS BIGINT) AS target, CAST(s_suppkey % 8 AS BIGINT) AS iter, CAST(s_suppkey % 160 AS INT) AS transit,
           CAST(s_nationkey * 2 AS INT) AS channel FROM supplier""", ["supplier"])


@query("j14_prediction_overlay", "fx_streaks vx_targets", """
    SELECT t.target, p.iter, p.beam_id, p.channel_sample, p.time_idx FROM fx_streaks p JOIN vx_targets t ON p.iter = t.iter
    WHERE p.time_idx BETWEEN t.transit - 30 AND t.transit + 20 AND p.channel_sample BETWEEN t.channel - 5 AND t.channel + 5""")
def _(p, t):
    """Pixels near the predicted transit time and channel of catalogue targets."""
    from skysieve.operators.monitor import prediction_overlay
    return prediction_overlay(p, t, 30, 20, 5).select("target", "iter", "beam_id", "channel_sample", "time_idx")

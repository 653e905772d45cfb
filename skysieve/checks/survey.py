"""Schedules, look-ups, packets, ADC levels, spectra and file sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import add_view, query
from skysieve.checks.signal import r, rounded
from skysieve.functions import units
from skysieve.operators import calibrate as cal, channelise as ch, correlate as co, levels as lv, monitor as mo, packets as pk
from skysieve.operators import schedule as sc
from skysieve.sources import files, tables

NOW = 64210147200  # inside the order dates, on a calendar of 31-day months

add_view("vx_sched", """
    SELECT obs_id, station, CAST((EXTRACT(YEAR FROM start_ts) * 12 + EXTRACT(MONTH FROM start_ts)) * 31 + EXTRACT(DAY FROM start_ts) AS BIGINT) * 86400
             + obs_id % 86400 AS start_s,
           CASE WHEN obs_id % 97 = 0 THEN NULL ELSE CAST((EXTRACT(YEAR FROM start_ts) * 12 + EXTRACT(MONTH FROM start_ts)) * 31 + EXTRACT(DAY FROM start_ts) AS BIGINT) * 86400
             + obs_id % 86400 + 3600 * (1 + obs_id % 48) END AS end_s,
           CASE status WHEN 'F' THEN 'finished' WHEN 'O' THEN 'pending' ELSE 'running' END AS status,
           CAST(obs_id % 90 AS DOUBLE) AS declination FROM fx_blocks""", ["fx_blocks"])


# --- calibration look-ups --------------------------------------------------------------------
@query("j4_latest_calibration", "vx_sched", """
    SELECT o.station, o.obs_id, o.start_s AS t, c.obs_id AS calib_id, c.start_s AS calib_t
    FROM vx_sched o LEFT JOIN LATERAL (
      SELECT obs_id, start_s FROM vx_sched c WHERE c.station = o.station AND c.status = 'finished' AND c.start_s <= o.start_s
      ORDER BY start_s DESC, obs_id LIMIT 1) c ON TRUE WHERE o.status <> 'finished'""")
def _(s):
    o = s.where("status <> 'finished'").select("station", "obs_id", F.col("start_s").alias("t"))
    c = s.where("status = 'finished'").select("station", F.col("obs_id").alias("calib_id"), F.col("start_s").alias("t"),
                                              F.col("obs_id").alias("created"))
    return cal.latest_calibration(o, c, ["station"], 200)


add_view("vx_sources", """
    SELECT CAST(n_nationkey AS INT) AS source_id, n_name AS name, n_nationkey * 3.7e0 - 10 AS dec FROM nation""", ["nation"])
add_view("vx_decs", "SELECT CAST(c_custkey AS BIGINT) AS request_id, c_acctbal / 100 AS declination FROM customer", ["customer"])


@query("j5_match_calibrator", "vx_decs vx_sources", """
    SELECT d.request_id, d.declination, s.source_id, s.name AS source, s.source_id IS NULL AS failed FROM vx_decs d LEFT JOIN LATERAL (
      SELECT source_id, name FROM vx_sources s WHERE ABS(d.declination - s.dec) < 1.0 ORDER BY source_id LIMIT 1) s ON TRUE""")
def _(d, s):
    return cal.match_calibrator(d, s, 1.0)


@query("j16_calibrator_windows", "vx_sched", """
    WITH q AS (SELECT obs_id AS request_id, start_s AS a, end_s AS b FROM vx_sched WHERE status = 'pending' AND end_s IS NOT NULL),
    t AS (SELECT station % 5 AS source, start_s AS s FROM vx_sched WHERE status = 'finished')
    SELECT request_id, source, MAX(s) AS transit_s FROM q JOIN t ON s > a + 1800 AND s < b - 900 GROUP BY 1, 2""")
def _(s):
    q = s.where("status = 'pending' AND end_s IS NOT NULL").select(
        F.col("obs_id").alias("request_id"), F.col("start_s").alias("from_s"), F.col("end_s").alias("to_s"))
    t = s.where("status = 'finished'").select((F.col("station") % 5).alias("source"), F.col("start_s").alias("transit_s"))
    return cal.calibrator_windows(q, t, 1800, 900)


@query("f17_source_of_name", "customer", """
    SELECT c_custkey, CASE WHEN lower(nm) LIKE '%cas%' THEN 'cas' WHEN lower(nm) LIKE '%cyg%' THEN 'cyg'
      WHEN lower(nm) LIKE '%tau%' THEN 'tau' WHEN lower(nm) LIKE '%vir%' THEN 'vir' END AS source
    FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'CasA_' WHEN 1 THEN 'obs_Cygnus' WHEN 2 THEN 'TAU-' WHEN 3 THEN 'Vir_' ELSE '' END || c_name AS nm FROM customer)""")
def _(c):
    nm = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("CasA_", "obs_Cygnus", "TAU-", "Vir_", "")]),
                               (F.col("c_custkey") % 5 + 1).cast("int")), F.col("c_name"))
    return c.select("c_custkey", cal.source_of(nm).alias("source"))


@query("a18_transit_sample", "vx_sched", """
    SELECT obs_id, CAST(FLOOR((((86400 * 3 - start_s % 86400) % 86400 + 86400) % 86400) / 3.8347922e0) AS BIGINT) AS vis_peak FROM vx_sched""")
def _(s):
    day = F.floor(F.col("start_s") / 86400) * 86400
    return s.select("obs_id", co.transit_sample(F.col("start_s"), day, 3.8347922).alias("vis_peak"))


# --- schedule --------------------------------------------------------------------------------
@query("p22_pending", "vx_sched", f"""
    SELECT obs_id, station, start_s FROM vx_sched WHERE status = 'pending' AND start_s >= {NOW} - 300""")
def _(s):
    """Pending observations of both kinds, one list."""
    det, cl = s.where("station % 2 = 0"), s.where("station % 2 = 1")
    return sc.pending(det.unionByName(cl), NOW).select("obs_id", "station", "start_s")


@query("t1_schedule_order", "vx_sched", f"""
    SELECT obs_id, start_s, ROW_NUMBER() OVER (ORDER BY start_s, obs_id) AS position FROM vx_sched
    WHERE status = 'pending' AND start_s >= {NOW} - 300""")
def _(s):
    """Positions in the pending list; the list is ordered through monthly buckets."""
    from skysieve.operators.sequences import row_index
    p = s.where((F.col("status") == "pending") & (F.col("start_s") >= NOW - 300)).withColumn("all", F.lit(1)).withColumn(
        "_b", F.floor(F.col("start_s") / (30 * 86400)))
    return row_index(p, ["all"], ["start_s", "obs_id"], "_b", "position").select("obs_id", "start_s", "position")


@query("t2_page", "vx_sched", """
    SELECT obs_id, start_s, (SELECT COUNT(*) FROM vx_sched) AS total FROM vx_sched ORDER BY start_s DESC, obs_id DESC LIMIT 25 OFFSET 50""")
def _(s):
    return mo.page(s.select("obs_id", "start_s"), [F.col("start_s").desc(), F.col("obs_id").desc()], 3, 25)


@query("t3_next_pending", "vx_sched", f"""
    SELECT obs_id, start_s FROM vx_sched WHERE status = 'pending' AND start_s >= {NOW} - 300 ORDER BY start_s, obs_id LIMIT 1""")
def _(s):
    return sc.pending(s, NOW).select("obs_id", "start_s").limit(1)


@query("t3_latest_configuration", "vx_sched", """
    SELECT station, obs_id, start_s, status FROM vx_sched
    QUALIFY ROW_NUMBER() OVER (PARTITION BY station ORDER BY start_s DESC, obs_id DESC) = 1""")
def _(s):
    return mo.latest_per(s.select("station", "obs_id", "start_s", "status"), ["station"], ["start_s", "obs_id"])


@query("p23_request_checks", "vx_sched", f"""
    WITH q AS (SELECT obs_id, CASE WHEN obs_id % 11 = 0 THEN NULL ELSE 'obs' END AS name, start_s,
                      CASE WHEN obs_id % 13 = 0 THEN start_s - 5 ELSE end_s END AS end_s, 'detection' AS pipeline FROM vx_sched),
    c AS (SELECT obs_id, CASE WHEN name IS NULL THEN 'name not specified' WHEN start_s IS NULL THEN 'start_s not specified'
             WHEN end_s IS NULL THEN 'end_s not specified' WHEN start_s - {NOW} < 1 THEN 'start time is not in the future'
             WHEN start_s > end_s THEN 'start time is after end time' END AS reason FROM q)
    SELECT obs_id, reason, reason IS NULL AS ok FROM c""")
def _(s):
    q = s.select("obs_id", F.when(F.col("obs_id") % 11 != 0, F.lit("obs")).alias("name"), "start_s",
                 F.when(F.col("obs_id") % 13 == 0, F.col("start_s") - 5).otherwise(F.col("end_s")).alias("end_s"),
                 F.lit("detection").alias("pipeline"))
    return sc.checked_requests(q, NOW).select("obs_id", "reason", "ok")


@query("j6_schedule_conflicts", "vx_sched", """
    SELECT a.station, a.obs_id AS new_id, b.obs_id FROM vx_sched a JOIN vx_sched b ON a.station = b.station
    WHERE a.status = 'running' AND b.status = 'pending' AND CASE
      WHEN a.end_s IS NULL OR b.end_s IS NULL THEN (b.end_s IS NULL AND b.start_s < a.start_s) OR (a.end_s IS NULL AND a.start_s < b.start_s)
      ELSE a.start_s <= b.end_s AND b.start_s <= a.end_s END""")
def _(s):
    return sc.conflicts(s.where("status = 'running'").withColumnRenamed("obs_id", "new_id"), s.where("status = 'pending'"), ["station"])


@query("f15_slew", "vx_sched", """
    SELECT obs_id, ROUND(15 + ABS(declination - LAG(declination) OVER w) * 60 / 4, 4) AS slew_s,
           COALESCE(start_s - LAG(end_s) OVER w >= 15 + ABS(declination - LAG(declination) OVER w) * 60 / 4, TRUE) AS feasible
    FROM vx_sched WINDOW w AS (PARTITION BY station ORDER BY start_s, obs_id)""")
def _(s):
    return rounded(sc.slew_feasibility(s), "slew_s", 4).select("obs_id", "slew_s", "feasible")


@query("s13_observation_scan", "vx_sched", f"""
    SELECT obs_id, start_s FROM vx_sched WHERE status = 'finished' AND start_s >= {NOW} AND start_s <= {NOW} + 31536000""")
def _(s):
    return tables.observations(s, status="finished", from_s=NOW, to_s=NOW + 31536000).select("obs_id", "start_s")


add_view("vx_candidates", """
    SELECT user_id AS obs_id, CAST(event_id % 32 AS INT) AS beam_id, MIN(event_id) AS min_t, MAX(event_id) AS max_t,
           MIN(value) AS min_channel, MAX(value) AS max_channel FROM events GROUP BY 1, 2""", ["events"])


@query("s13_candidate_scan", "vx_candidates", """
    SELECT 'range' AS scan, * FROM vx_candidates WHERE beam_id = 3 AND min_t >= 100 AND max_t <= 9000 AND min_channel >= 1 AND max_channel <= 90
    UNION ALL SELECT 'obs', * FROM vx_candidates WHERE obs_id = 7""")
def _(c):
    """Range arguments; and a scan by observation, which ignores them."""
    a = tables.beam_candidates(c, beam_id=3, from_t=100, to_t=9000, min_channel=1, max_channel=90)
    b = tables.beam_candidates(c, obs_id=7, beam_id=3, from_t=100)
    return a.select(F.lit("range").alias("scan"), "*").unionByName(b.select(F.lit("obs").alias("scan"), "*"))


@query("j15_calibration_reference", "vx_sched", """
    SELECT o.obs_id, c.obs_id AS calib_id, c.declination FROM vx_sched o LEFT JOIN vx_sched c
      ON c.obs_id = o.obs_id - 1 AND c.status = 'finished' WHERE o.status = 'pending'""")
def _(s):
    """Observation -> its calibration observation by stored reference."""
    o = s.where("status = 'pending'").select("obs_id", (F.col("obs_id") - 1).alias("calib_ref"))
    c = s.where("status = 'finished'").select(F.col("obs_id").alias("calib_ref"), F.col("obs_id").alias("calib_id"), "declination")
    return o.join(c, "calib_ref", "left").select("obs_id", "calib_id", "declination")


@query("x9_late_timestamps", "events", """
    SELECT user_id, COUNT(*) AS n, COUNT(*) FILTER (event_id % 50 = 0) AS invalid FROM events GROUP BY 1""")
def _(e):
    """Rows without a usable time are stamped and counted."""
    from skysieve.streaming.blocks import stamped
    raw = e.select("user_id", F.when(F.col("event_id") % 50 != 0, F.col("ts").cast("timestamp")).alias("ts"))
    return stamped(raw, "ts").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if("late").alias("invalid"))


# --- metrics and JSON --------------------------------------------------------------------------
@query("w8_last_points", "events", """
    SELECT user_id AS ant, event_id, value AS rms FROM events QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 90""")
def _(e):
    m = e.select(F.col("user_id").alias("ant"), "event_id", "ts", F.col("value").alias("rms"))
    return mo.last_points(m, ["ant"], ["ts", "event_id"], 90).drop("ts")


@query("f18_json", "events", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k,
           '{"antenna":' || user_id || ',"level":' || CAST(CAST(value AS INT) AS VARCHAR) || '}' AS message FROM events""")
def _(e):
    return e.select("event_id", F.from_json("props", "k int")["k"].alias("k"),
                    F.to_json(F.struct(F.col("user_id").alias("antenna"), F.bround("value").cast("int").alias("level"))).alias("message"))


@query("d15_antenna_metrics", "events", """
    SELECT user_id AS ant, event_type, COUNT(*) AS n, ROUND(SQRT(AVG(value * value)), 6) AS rms FROM events GROUP BY 1, 2""")
def _(e):
    return e.groupBy(F.col("user_id").alias("ant"), "event_type").agg(
        F.count("*").alias("n"), r(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


@query("s14_schedule_json", "vx_sched", """
    SELECT obs_id, 'obs' || obs_id AS name, start_s, CAST(declination AS DOUBLE) AS declination, obs_id % 17 <> 0 AS ok FROM vx_sched""")
def _(s):
    """Schedule entries as JSON text, parsed with the declared schema; incomplete ones are marked."""
    text = F.to_json(F.struct(
        F.concat(F.lit("obs"), F.col("obs_id").cast("string")).alias("name"),
        F.when(F.col("obs_id") % 17 != 0, F.lit("detection")).alias("pipeline"),
        F.struct(F.struct(F.col("declination").alias("reference_declination")).alias("beamformer"), "start_s").alias("config_parameters")))
    return tables.parse_schedule(s.select("obs_id", text.alias("json")), "json").select("obs_id", "name", "start_s", "declination", "ok")


@query("d11_settings", "events", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS k FROM events""")
def _(e):
    """Free-form settings as a map of text."""
    return e.select("event_id", F.element_at(F.from_json("props", "map<string,string>"), "k").alias("k"))


# --- packets -----------------------------------------------------------------------------------
add_view("vx_packets", """
    SELECT l_orderkey AS arrival, l_suppkey AS stream, CAST(l_partkey % 256 AS BIGINT) AS counter, CAST(l_quantity AS BIGINT) AS ts,
           CAST(l_linenumber AS BIGINT) AS ant, CAST(l_discount * 100 AS INT) AS iq
    FROM lineitem""", ["lineitem"])


@query("s7_packet_headers", "vx_packets", """
    SELECT arrival, stream, counter, 8192 AS payload_length, 1000 AS sync_time, ts AS packet_ts, ant AS start_antenna, ts % 2 = 0 AS valid
    FROM vx_packets""")
def _(p):
    """Nine 64-bit items per packet are built from the rows and decoded again."""
    def item(i, v):
        return F.shiftleft(F.lit(i).cast("bigint"), 48).bitwiseOR(v)
    ids = pk.ITEM_IDS
    items = F.array(item(ids["magic"], F.lit(0).cast("bigint")), item(ids["counter"], F.col("counter")),
                    item(ids["payload_length"], F.lit(8192).cast("bigint")), item(ids["sync_time"], F.lit(1000).cast("bigint")),
                    item(ids["timestamp"], F.col("ts")), item(ids["mode"], F.when(F.col("ts") % 2 == 0, F.lit(7)).otherwise(F.lit(3)).cast("bigint")),
                    item(ids["antenna"], F.shiftleft("ant", 8)), item(0xA003, F.lit(0).cast("bigint")), item(0x3300, F.lit(0).cast("bigint")))
    d = pk.decode_headers(p.select("arrival", "stream", items.alias("items")))
    return d.drop("items").withColumn("payload_length", F.col("payload_length").cast("int")).withColumn("sync_time", F.col("sync_time").cast("int"))


@query("s8_payload_samples", "lineitem", """
    SELECT l_orderkey, l_linenumber, CAST(k // 2 AS BIGINT) AS sample, CAST(k % 2 + 4 AS INT) AS ant,
           CAST(l_linenumber * (2 * k + 1) AS DOUBLE) AS re, CAST(l_linenumber * (2 * k + 2) AS DOUBLE) AS im
    FROM lineitem, (SELECT UNNEST(RANGE(0, 6)) AS k)""")
def _(l):
    p = l.select("l_orderkey", "l_linenumber", F.lit(4).alias("start_antenna"),
                 F.transform(F.sequence(F.lit(1), F.lit(12)), lambda x: x * F.col("l_linenumber")).alias("iq"))
    return pk.payload_samples(p, 2)


@query("s9_packet_sequence", "vx_packets", """
    WITH d AS (SELECT stream, arrival, MIN(counter) AS counter FROM vx_packets GROUP BY 1, 2),
    k AS (SELECT *, SUM(CASE WHEN counter = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY arrival)
            - CASE WHEN FIRST_VALUE(counter) OVER (PARTITION BY stream ORDER BY arrival) = 0 THEN 1 ELSE 0 END AS rollovers FROM d),
    n AS (SELECT *, counter + rollovers * 16777216 AS packet_no FROM k)
    SELECT stream, arrival, counter, CAST(rollovers AS BIGINT) AS rollovers, CAST(packet_no AS BIGINT) AS packet_no,
           CAST(COALESCE(GREATEST(0, packet_no - LAG(packet_no) OVER (PARTITION BY stream ORDER BY arrival) - 1), 0) AS BIGINT) AS lost FROM n""")
def _(p):
    d = p.groupBy("stream", "arrival").agg(F.min("counter").alias("counter")).withColumn("_b", F.floor(F.col("arrival") / 2048))
    return pk.sequence_packets(d, ["stream"], "arrival", "_b").drop("_b")


@query("s9_fill_missing", "vx_packets", """
    WITH d AS (SELECT ant AS stream, arrival, SUM(iq) AS iq FROM vx_packets GROUP BY 1, 2),
    g AS (SELECT stream, UNNEST(RANGE(MIN(arrival), MAX(arrival) + 1)) AS arrival FROM d GROUP BY 1)
    SELECT g.stream, g.arrival, CAST(COALESCE(iq, 0) AS BIGINT) AS iq, iq IS NOT NULL AS present
    FROM g LEFT JOIN d ON d.stream = g.stream AND d.arrival = g.arrival""")
def _(p):
    d = p.groupBy(F.col("ant").alias("stream"), "arrival").agg(F.sum("iq").alias("iq"))
    return pk.fill_missing(d, ["stream"], "arrival", ["iq"])


# --- levels and spectra --------------------------------------------------------------------------
add_view("vx_adc", """
    SELECT CAST(l_suppkey % 16 AS INT) AS ant, CAST(FLOOR(l_orderkey / 1500) AS BIGINT) AS capture,
           CAST(l_quantity * 10 - 250 AS DOUBLE) AS value FROM lineitem""", ["lineitem"])
add_view("vx_spectra", """
    SELECT CAST(l_suppkey % 16 AS INT) AS ant, CAST(FLOOR(l_orderkey / 1500) AS BIGINT) AS capture,
           CAST(l_partkey % 128 AS INT) AS bin, -80 + SUM(l_discount * 100) AS level FROM lineitem GROUP BY 1, 2, 3""", ["lineitem"])


@query("a21_adc_levels", "vx_adc", """
    WITH p AS (SELECT ant, capture, AVG(value * value) AS p FROM vx_adc GROUP BY 1, 2)
    SELECT ant, capture, ROUND(SQRT(p), 6) AS rms, ROUND(10 * LOG10(POWER(SQRT(p) * 1.7 / 16384, 2) / 400) + 42, 5) AS rf_dbm,
           ROUND(10 * LOG10(p / (8192.0 * 8192.0 / 2)), 5) AS dbfs, ROUND(LOG2(SQRT(p)), 6) AS bits_used FROM p""")
def _(a):
    return rounded(rounded(lv.adc_levels(a, ["ant", "capture"], 14), "rms bits_used", 6), "rf_dbm dbfs")


@query("a22_bit_spread", "vx_adc", """
    WITH p AS (SELECT ant, capture, LOG2(SQRT(AVG(value * value))) AS b FROM vx_adc GROUP BY 1, 2)
    SELECT capture, ROUND(MAX(b) - MIN(b), 6) AS bit_spread FROM p GROUP BY 1""")
def _(a):
    return rounded(lv.bit_spread(lv.adc_levels(a, ["ant", "capture"], 14), ["capture"]), "bit_spread", 6)


@query("a20_capture_spectra", "embeddings")
def _(e):
    """Averaged spectrum per stored waveform; tested against a direct transform."""
    x = e.select("vec_id", F.transform("embedding", lambda v: v * 8191.0).alias("samples"))
    return rounded(lv.capture_spectra(x, 2, 14, ["vec_id"]), "amplitude level", 6)


@query("a23_fundamental", "vx_spectra", """
    SELECT ant, capture, ARG_MAX(bin * 5e3, (level, -bin)) AS frequency, ROUND(MAX(level), 6) AS level FROM vx_spectra GROUP BY 1, 2""")
def _(s):
    return rounded(lv.fundamental(s.withColumn("level", F.round("level", 6)), ["ant", "capture"], 5e3), "level", 6)


@query("a31_strongest_bin", "vx_spectra", "SELECT ant, ROUND(MAX(level), 6) AS level FROM vx_spectra GROUP BY 1")
def _(s):
    return s.groupBy("ant").agg(r(F.max("level"), 6).alias("level"))


@query("a30_mean_spectrum", "vx_spectra", """
    SELECT ant, bin, ROUND(10 * LOG10(AVG(POWER(10, level / 10))), 5) AS level FROM vx_spectra
    WHERE bin * 5e3 BETWEEN 1e5 AND 4e5 GROUP BY 1, 2""")
def _(s):
    return rounded(lv.mean_spectrum(lv.band(s, 1e5, 4e5, 5e3), ["ant"]), "level")


@query("a30_relative_power", "vx_spectra", """
    SELECT ant, bin, capture, ROUND(level - FIRST_VALUE(level) OVER (PARTITION BY ant, bin ORDER BY capture), 5) AS relative FROM vx_spectra""")
def _(s):
    return rounded(lv.relative_power(s, ["ant", "bin"], ["capture"]), "relative").select("ant", "bin", "capture", "relative")


@query("w7_max_hold", "vx_spectra", """
    SELECT ant, bin, capture, ROUND(MAX(level) OVER w, 6) AS max_hold, ROUND(MIN(level) OVER w, 6) AS min_hold FROM vx_spectra
    WINDOW w AS (PARTITION BY ant, bin ORDER BY capture)""")
def _(s):
    return rounded(mo.max_hold(s, ["ant", "bin"], bucket=4).drop("level"), "max_hold min_hold", 6)


@query("f2_unit_conversions", "vx_spectra", """
    SELECT ant, bin, capture, ROUND(POWER(10, level / 10) * 1e8, 4) AS linear, ROUND(POWER(10, (level - 30) / 10) * 1e12, 4) AS watt,
           ROUND(level, 6) AS back FROM vx_spectra""")
def _(s):
    return s.select("ant", "bin", "capture", r(units.from_db("level") * 1e8, 4).alias("linear"),
                    r(units.dbm_to_watt("level") * 1e12, 4).alias("watt"),
                    r(units.watt_to_dbm(units.dbm_to_watt("level")), 6).alias("back"))


@query("f13_predicted_channel", "vx_decs", """
    SELECT request_id, CAST(FLOOR((410 + declination * 100 * 1e-6 - 409.99) / 0.0000104e0) AS INT) AS channel FROM vx_decs""")
def _(d):
    return d.select("request_id", units.predicted_channel(F.col("declination") * 100, F.lit(410.0), F.lit(409.99), F.lit(0.0000104)).alias("channel"))


@query("f14_attenuators", "vx_decs", """
    WITH x AS (SELECT request_id, CAST(request_id % 64 AS INT) AS code, declination FROM vx_decs),
    d AS (SELECT *, (code & 1) * 0.5e0 + ((code >> 1) & 1) * 16 + ((code >> 2) & 1) * 1 + ((code >> 3) & 1) * 8
             + ((code >> 4) & 1) * 2 + ((code >> 5) & 1) * 4 AS db FROM x)
    SELECT request_id, code, db, code AS code_back,
           ROUND_EVEN(GREATEST(0, LEAST(31.5, db - (5 - declination / 10))) * 2, 0) / 2 AS new_db,
           ROUND(20 * LOG10(16 / (1 + code)), 5) AS gain FROM d""")
def _(d):
    x = d.withColumn("code", (F.col("request_id") % 64).cast("int")).withColumn("db", units.attenuator_db("code"))
    return x.select("request_id", "code", "db", units.attenuator_code("db").alias("code_back"),
                    units.attenuation_step("db", F.col("declination") / 10, F.lit(5.0)).alias("new_db"),
                    r(units.gain_advice_db(F.col("code") + 1.0, 16.0)).alias("gain"))


@query("f19_antenna_label", "fx_voltages", """
    SELECT DISTINCT ant, CAST(ant // 4 + 1 AS VARCHAR) || '-' || CAST(ant % 4 + 1 AS VARCHAR) AS label FROM fx_voltages""")
def _(v):
    return v.select("ant").distinct().select("ant", units.antenna_label("ant").alias("label"))


@query("f21_quantised_frequency", "vx_decs", """
    SELECT request_id, ROUND(FLOOR((1e8 + declination * 1e5) / 8.75e7 * 1024) / 1024 * 8.75e7, 3) AS frequency FROM vx_decs""")
def _(d):
    return d.select("request_id", r(units.quantised_frequency(1e8 + F.col("declination") * 1e5, F.lit(8.75e7)), 3).alias("frequency"))


@query("f22_spectrum_axis", "vx_spectra", """
    SELECT DISTINCT bin, ROUND(bin * (7e8 / (32768 / 16)), 3) AS frequency FROM vx_spectra""")
def _(s):
    n_avg, width = lv.resolution(32768, 7e8, 3.5e5)
    assert n_avg == 16
    return s.select("bin").distinct().select("bin", r(F.col("bin") * width, 3).alias("frequency"))


@query("f20_prototype_filter", "fx_voltages", """
    SELECT DISTINCT CAST(k AS INT) AS k, ROUND(CASE WHEN y = 0 THEN 1 ELSE SIN(PI() * y) / (PI() * y) END * (0.5 - 0.5 * COS(2 * PI() * (31 - k) / 31)), 9) AS h
    FROM (SELECT CAST(sample % 32 AS INT) AS k, (31 - sample % 32) / 8.0 - 2 AS y FROM fx_voltages)""")
def _(v):
    return v.select((F.col("sample") % 32).cast("int").alias("k")).distinct().select(
        "k", r(ch.filter_coefficient("k", 8, 4), 9).alias("h"))


_H = "(CASE WHEN y = 0 THEN 1 ELSE SIN(PI() * y) / (PI() * y) END * (0.5 - 0.5 * COS(2 * PI() * (31 - q) / 31)))"
add_view("vx_fir", f"""
    SELECT ant, m AS spectrum, pos, SUM(re * {_H}) AS re, SUM(im * {_H}) AS im FROM (
      SELECT *, j * 8 + pos AS q, (31 - (j * 8 + pos)) / 8.0 - 2 AS y, FLOOR(sample / 8) - j + 4 AS m FROM (
        SELECT ant, sample, re, im, CAST(sample % 8 AS INT) AS pos, UNNEST([0, 1, 2, 3]) AS j FROM fx_voltages))
    GROUP BY 1, 2, 3""", ["fx_voltages"])


@query("c1_tap_sums", "fx_voltages", """
    SELECT ant, CAST(spectrum AS BIGINT) AS spectrum, pos, ROUND(re, 6) AS re, ROUND(im, 6) AS im FROM vx_fir""", "vx_fir")
def _(v):
    return rounded(ch.fir(v, 8, 4), "re im", 6)


@query("c1_channeliser", "fx_voltages", """
    SELECT ant, CAST(spectrum AS BIGINT) AS spectrum, CAST((k + 4) % 8 AS INT) AS channel,
           ROUND(SUM(re * COS(2 * PI() * k * pos / 8) + im * SIN(2 * PI() * k * pos / 8)), 4) AS re,
           ROUND(SUM(im * COS(2 * PI() * k * pos / 8) - re * SIN(2 * PI() * k * pos / 8)), 4) AS im
    FROM vx_fir, (SELECT UNNEST(RANGE(0, 8)) AS k) GROUP BY 1, 2, 3""", "vx_fir")
def _(v):
    return rounded(ch.channelise(v, 8, 4), "re im", 4)


def dense_strips(v):
    """Array rows of 80 samples per antenna and block."""
    b = v.withColumn("iter", F.floor(F.col("sample") / 80))
    full = b.groupBy("ant", "iter").agg(F.map_from_entries(F.collect_list(F.struct((F.col("sample") % 80).cast("int"), F.struct("re", "im")))).alias("_m"))
    cell = lambda part: F.transform(F.sequence(F.lit(0), F.lit(79)), lambda k: F.coalesce(F.col("_m")[k][part], F.lit(0.0)))
    return full.select("ant", "iter", cell("re").alias("re"), cell("im").alias("im"))


def spectra_rows(out):
    """Long rows without the zeros (a spectrum without samples is absent from the long form)."""
    return out.select("ant", "iter", "channel", F.posexplode(F.arrays_zip("re", "im")).alias("k", "_v")).select(
        "ant", (F.col("iter") * 10 + F.col("k")).alias("spectrum"), "channel", r(F.col("_v.re"), 4).alias("re"),
        r(F.col("_v.im"), 4).alias("im")).where("re <> 0 OR im <> 0")


_BLOCK_SPECTRA = """
    WITH s AS (SELECT ant, CAST(spectrum AS BIGINT) AS spectrum, CAST((k + 4) % 8 AS INT) AS channel,
           ROUND(SUM(re * COS(2 * PI() * k * pos / 8) + im * SIN(2 * PI() * k * pos / 8)), 4) AS re,
           ROUND(SUM(im * COS(2 * PI() * k * pos / 8) - re * SIN(2 * PI() * k * pos / 8)), 4) AS im
    FROM vx_fir, (SELECT UNNEST(RANGE(0, 8)) AS k)
    WHERE spectrum < (SELECT (MAX(sample) // 80 + 1) * 10 FROM fx_voltages) GROUP BY 1, 2, 3)
    SELECT * FROM s WHERE re <> 0 OR im <> 0"""


@query("w10_channeliser_blocks", "fx_voltages", _BLOCK_SPECTRA, "vx_fir")
def _(v):
    """Dense block form: only block tails travel to the next block."""
    return spectra_rows(ch.channelise_strips(dense_strips(v), 8, 4, ["ant"]))


@query("x4_channeliser_stream", "fx_voltages", _BLOCK_SPECTRA, "vx_fir")
def _(v):
    """The same on a stream, with the block tail as keyed state."""
    from skysieve.checks.flows import _drain, _land
    from skysieve.streaming import blocks as sb, state as ss
    s = dense_strips(v)
    stream = sb.block_stream(v.sparkSession, _land(s, "strips"), s.schema, 1000)
    return spectra_rows(_drain(ss.channelise_stream(stream, 8, 4, "ant"), "spectra"))


@query("d1_4_block_metadata", "vx_sched", """
    SELECT obs_id, start_s * 1000000 - CAST(ROUND(7 * 8192 * (1 / 85449.21875e0) * 1e6) AS BIGINT) AS t0_us,
           ROUND(8192 / 85449.21875e0, 9) AS sampling_time, 160 AS nsamp, ROUND(0.08544921875e0 / 8192, 12) AS channel_bandwidth,
           ROUND(410 - 0.08544921875e0 / 2, 9) AS start_center_frequency FROM vx_sched""")
def _(s):
    b = s.select("obs_id", (F.col("start_s") * 1000000).alias("t0_us"), F.lit(1 / 85449.21875).alias("sampling_time"),
                 F.lit(1310720).alias("nsamp"), F.lit(0.08544921875).alias("channel_bandwidth"), F.lit(410.0).alias("start_center_frequency"))
    m = ch.block_metadata(b, 8192, 8)
    return rounded(rounded(m, "sampling_time start_center_frequency", 9), "channel_bandwidth", 12).withColumn("nsamp", F.col("nsamp").cast("int"))


# --- file sets ---------------------------------------------------------------------------------
add_view("vx_files", """
    SELECT CAST(o_custkey AS BIGINT) AS obs_id, 'raw_' || o_custkey || CASE WHEN k = 0 THEN '.dat' ELSE '_' || k || '.dat' END AS path,
           1000 * (1 + o_orderkey % 5) AS n_bytes
    FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k FROM orders) t""", ["orders"])


@query("s3_file_index", "vx_files", """
    WITH n AS (SELECT *, COALESCE(CAST(NULLIF(regexp_extract(path, '_(\\d+)\\.dat$', 1), '') AS INT), 0) AS raw FROM vx_files),
    k AS (SELECT obs_id, path, n_bytes, CASE WHEN path = 'raw_' || obs_id || '.dat' THEN 0 ELSE raw END AS part FROM n)
    SELECT obs_id, path, CAST(part AS INT) AS part, n_bytes, CAST(SUM(n_bytes) OVER (PARTITION BY obs_id ORDER BY part) - n_bytes AS BIGINT) AS offset_bytes FROM k""")
def _(f):
    return files.file_index(f, "raw_")


@query("s5_file_time_ranges", "vx_files", """
    WITH n AS (SELECT *, COALESCE(CAST(NULLIF(regexp_extract(path, '_(\\d+)\\.dat$', 1), '') AS INT), 0) AS raw FROM vx_files),
    k AS (SELECT obs_id, path, n_bytes, CASE WHEN path = 'raw_' || obs_id || '.dat' THEN 0 ELSE raw END AS part FROM n),
    c AS (SELECT *, SUM(n_bytes) OVER (PARTITION BY obs_id ORDER BY part) - n_bytes AS o FROM k)
    SELECT obs_id, path, n_bytes // 500 AS n_blocks, ROUND(o / 500 * 1.5, 4) AS from_s, ROUND((o + n_bytes) / 500 * 1.5, 4) AS to_s FROM c""")
def _(f):
    return rounded(files.time_ranges(files.file_index(f, "raw_"), 500, 1.5), "from_s to_s", 4)


@query("u5_concatenated_files", "vx_files", """
    SELECT obs_id, COUNT(*) AS files, CAST(SUM(n_bytes) AS BIGINT) AS n_bytes FROM vx_files GROUP BY 1""")
def _(f):
    i = files.file_index(f, "raw_")
    return i.groupBy("obs_id").agg(F.count("*").alias("files"), F.max(F.col("offset_bytes") + F.col("n_bytes")).alias("n_bytes"))


@query("s2_skip_and_limit", "fx_pixels", """
    SELECT iter, COUNT(*) AS n FROM fx_pixels WHERE iter >= 2 AND iter <= 5 GROUP BY 1""")
def _(p):
    return files.block_range(p, skip=2, limit=4).groupBy("iter").agg(F.count("*").alias("n"))


@query("s4_header_join", "fx_pixels vx_sched", """
    SELECT p.iter, COUNT(*) AS n, MAX(s.start_s) AS start_s FROM fx_pixels p JOIN vx_sched s ON p.iter = s.obs_id GROUP BY 1""")
def _(p, s):
    return files.with_header(p.withColumn("obs_id", F.col("iter")), s.select("obs_id", "start_s")).groupBy("iter").agg(
        F.count("*").alias("n"), F.max("start_s").alias("start_s"))


@query("s18_beam_csv_scan", "fx_pixels", """
    SELECT iter, beam_id, time_idx, ROUND(10 * LOG10(AVG(power)), 5) AS power_db, CASE WHEN COUNT(*) > 1 THEN COUNT(*) END AS n FROM fx_pixels GROUP BY 1, 2, 3""")
def _(p):
    """Written as CSV with a null marker and read back."""
    from skysieve.session import scratch_path
    g = p.groupBy("iter", "beam_id", "time_idx").agg(r(10 * F.log10(F.avg("power"))).alias("power_db"),
                                                     F.when(F.count("*") > 1, F.count("*")).alias("n"))
    path = scratch_path(p.sparkSession, "csv")
    g.write.option("header", True).option("nullValue", "NULL").csv(path)
    return tables.beam_csv(p.sparkSession, path, g.schema)


@query("k9_beam_power_csv", "fx_pixels", """
    SELECT CAST(iter AS VARCHAR) || ',' || beam_id || ',' || time_idx || ',' || CASE WHEN COUNT(*) > 1 THEN CAST(COUNT(*) AS VARCHAR) ELSE 'NULL' END AS line
    FROM fx_pixels GROUP BY iter, beam_id, time_idx""")
def _(p):
    from skysieve.sinks.tables import csv_lines
    g = p.groupBy("iter", "beam_id", "time_idx").agg(F.when(F.count("*") > 1, F.count("*")).alias("n"))
    return csv_lines(g, [("iter", "%d"), ("beam_id", "%d"), ("time_idx", "%d"), ("n", "%d")])


# --- table functions ---------------------------------------------------------------------------
@query("e1_block_transform", "fx_voltages", """
    SELECT sample // 50 AS iter, ant, COUNT(*) AS n, ROUND(SQRT(AVG(re * re + im * im)), 5) AS rms FROM fx_voltages GROUP BY 1, 2""")
def _(v):
    """A transform of each antenna's block, called by name from SQL."""
    from skysieve.functions.table_functions import register
    b = v.withColumn("iter", F.floor(F.col("sample") / 50))
    out = register(v.sparkSession).sql("""SELECT * FROM block_transform(
        TABLE(SELECT iter, ant, sample, re, im FROM {b}) PARTITION BY (iter, ant) ORDER BY (sample), 'rms', 'iter, ant')""", b=b)
    return rounded(out, "rms")


@query("e6_rasterise_sql", "vx_leaf_boxes", """
    SELECT id, CAST(FLOOR(t0 + CASE WHEN n > 0 THEN k / n ELSE 0 END * (t1 - t0) + 0.5) AS INT) AS time_idx,
           CAST(FLOOR(c0 + CASE WHEN n > 0 THEN k / n ELSE 0 END * (c1 - c0) + 0.5) AS INT) AS channel_sample
    FROM (SELECT *, UNNEST(RANGE(0, n + 1)) AS k FROM (
      SELECT *, GREATEST(ABS(t1 - t0), ABS(c1 - c0)) AS n FROM vx_leaf_boxes))""")
def _(b):
    """The rasteriser as a table function; a line has many cells, so lines are dealt to all tasks."""
    from skysieve.functions.table_functions import register
    from skysieve.session import spread
    return register(b.sparkSession).sql("SELECT id, time_idx, channel_sample FROM rasterise(TABLE(SELECT * FROM {b}))", b=spread(b, "id"))

"""Sinks, binary formats, streams and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from skysieve.checks.registry import query
from skysieve.checks.clusters import NC, NT
from skysieve.checks.pixels import _ROLL
from skysieve.checks.signal import A19_SQL, r, rounded
from skysieve.checks.tracks import LIMITS, first_match_sql
from skysieve.operators import beamform as bf, noise as nz, tracks as tr
from skysieve.operators.streaks import CHANNEL_HZ, SAMPLING_TIME
from skysieve.plans.pipelines import PIPELINES
from skysieve.session import cut, scratch_path
from skysieve.sinks import tables as sinks
from skysieve.sinks.keyed import KeyedTable
from skysieve.streaming import blocks as sb, state as ss, tables as stt

BLOCK = 50


def frames(v):
    f = bf.to_frames(v, 8).withColumn("iter", F.floor(F.col("sample") / BLOCK))
    return f.select("iter", "sample", F.col("re").cast("array<float>").alias("re"), F.col("im").cast("array<float>").alias("im"))


_DENSE = """
    WITH g AS (SELECT s.sample, a.ant FROM (SELECT DISTINCT sample FROM fx_voltages) s, (SELECT UNNEST(RANGE(0, 8)) AS ant) a),
    d AS (SELECT g.sample, CAST(g.ant AS INT) AS ant, CAST(COALESCE(re, 0) AS FLOAT) AS re, CAST(COALESCE(im, 0) AS FLOAT) AS im
          FROM g LEFT JOIN fx_voltages v ON v.sample = g.sample AND v.ant = g.ant)"""


def _raw(v, path_name="raw"):
    spark = v.sparkSession
    path = scratch_path(spark, path_name)
    sinks.raw_voltages(frames(v), path)
    return spark.read.format("voltage_raw").option("path", path).option("nants", 8).option("blocksamples", BLOCK).load()


def _long(f):
    return f.select("sample", F.posexplode(F.arrays_zip("re", "im")).alias("ant", "_v")).select(
        "sample", "ant", r(F.col("_v.re").cast("double"), 3).alias("re"), r(F.col("_v.im").cast("double"), 3).alias("im"))


@query("s1_raw_voltage_scan", "fx_voltages", _DENSE + """
    SELECT sample, ant, ROUND(CAST(re AS DOUBLE), 3) AS re, ROUND(CAST(im AS DOUBLE), 3) AS im FROM d""")
def _(v):
    """Flat raw files written by the sink and scanned by the binary source."""
    return _long(_raw(v))


@query("s2_raw_scan_range", "fx_voltages", _DENSE + f"""
    SELECT CAST(sample // {BLOCK} AS BIGINT) AS iter, COUNT(DISTINCT sample) AS n FROM d WHERE sample // {BLOCK} BETWEEN 3 AND 7 GROUP BY 1""")
def _(v):
    """Block bounds are pushed into the planning of the binary scan."""
    return _raw(v).where("iter >= 3 AND iter <= 7").groupBy("iter").agg(F.count("*").alias("n"))


@query("k1_raw_sink_files", "fx_voltages", _DENSE + f"""
    SELECT CAST(sample // {BLOCK} // 4 AS BIGINT) AS chunk, COUNT(DISTINCT sample) AS n FROM d GROUP BY 1""")
def _(v):
    """The columnar raw sink, a partition every four blocks."""
    path = scratch_path(v.sparkSession, "rawpq")
    sinks.append(frames(v).withColumn("chunk", F.floor(F.col("iter") / 4)), path, ["chunk"])
    return v.sparkSession.read.parquet(path).groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.count("*").alias("n"))


@query("s10_beam_power_scan", "fx_pixels", """
    WITH d AS (SELECT DISTINCT time_idx FROM fx_pixels)
    SELECT d.time_idx, CAST(c AS INT) AS channel, CAST(b AS INT) AS beam_id, CAST(CAST(COALESCE(p.power, 0) AS FLOAT) AS DOUBLE) AS power
    FROM d, (SELECT UNNEST(RANGE(0, 64)) AS c), (SELECT UNNEST(RANGE(0, 8)) AS b)
    LEFT JOIN (SELECT beam_id, channel_sample, time_idx, MAX(power) AS power FROM fx_pixels GROUP BY 1, 2, 3) p
      ON p.time_idx = d.time_idx AND p.channel_sample = c AND p.beam_id = b""")
def _(p):
    """Beam power written as flat floats (time, channel, beam) and scanned back."""
    from skysieve.sources.raw import register
    spark = register(p.sparkSession)
    top = p.groupBy("time_idx", "channel_sample").agg(*[F.max(F.when(F.col("beam_id") == b, F.col("power"))).alias(f"b{b}") for b in range(8)])
    grid = p.select("time_idx").distinct().withColumn("channel_sample", F.explode(F.sequence(F.lit(0), F.lit(NC - 1))))
    full = grid.join(top, ["time_idx", "channel_sample"], "left").select(
        F.col("time_idx").cast("bigint").alias("time_idx"), F.col("channel_sample").alias("channel"),
        F.array(*[F.coalesce(f"b{b}", F.lit(0.0)).cast("float") for b in range(8)]).alias("power"))
    path = scratch_path(spark, "beamraw")
    # one ordered range of times per file; file numbers follow the time of their first row
    full.repartitionByRange(4, "time_idx").sortWithinPartitions("time_idx", "channel").write.format("beam_raw").option(
        "path", path).mode("append").save()
    back = spark.read.format("beam_raw").option("path", path).option("nchans", NC).option("nbeams", 8).load()
    return back.select("time_idx", "channel", F.posexplode("power").alias("beam_id", "power")).select(
        F.col("time_idx").cast("int").alias("time_idx"), "channel", "beam_id", F.col("power").cast("double").alias("power"))


@query("k2_beam_sink", "fx_voltages fx_weights", f"""
    WITH b AS (SELECT v.sample // {BLOCK} AS iter, v.sample, w.beam_id, SUM(v.re * w.re - v.im * w.im) AS re, SUM(v.re * w.im + v.im * w.re) AS im
               FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY 1, 2, 3)
    SELECT CAST(iter AS BIGINT) AS iter, sample, beam_id, ROUND(re * re + im * im, 3) AS power FROM b WHERE iter > 2 AND beam_id BETWEEN 1 AND 3""")
def _(v, w):
    path = scratch_path(v.sparkSession, "beams")
    b = bf.beamform(v, w).withColumn("iter", F.floor(F.col("sample") / BLOCK))
    sinks.append(sinks.beam_table(b, (1, 3)), path)
    return rounded(v.sparkSession.read.parquet(path), "power", 3).select("iter", "sample", "beam_id", "power")


@query("k3_visibility_sink", "fx_voltages", """
    SELECT t_idx, baseline, ROUND(1000 + t_idx * 3.8347922e0, 6) AS time_s, ROUND(re, 3) AS re, ROUND(im, 3) AS im FROM vx_vis""", "vx_vis")
def _(v):
    """Appended block by block in two calls, read back as one table."""
    path = scratch_path(v.sparkSession, "vis")
    t = sinks.visibility_table(PIPELINES["correlation"](v, 8, 50), 1000.0, 3.8347922)
    sinks.append(t.where("t_idx < 20"), path)
    sinks.append(t.where("t_idx >= 20"), path)
    return rounded(rounded(v.sparkSession.read.parquet(path), "time_s", 6), "re im", 3).select("t_idx", "baseline", "time_s", "re", "im")


@query("k4_image_sink", "fx_pixels", """
    SELECT iter, beam_id, CAST(iter // 10 AS BIGINT) AS file_no, 410.07e0 AS s_freq, COUNT(*) AS n, SUM(power) AS power
    FROM fx_pixels WHERE beam_id IN (2, 6) GROUP BY 1, 2""")
def _(p):
    path = scratch_path(p.sparkSession, "img")
    sinks.append(sinks.image_table(p, [2, 6], {"s_freq": 410.07}), path, ["file_no"])
    back = p.sparkSession.read.parquet(path)
    return back.groupBy("iter", "beam_id", F.col("file_no").cast("bigint").alias("file_no"), "s_freq").agg(
        F.count("*").alias("n"), F.sum("power").alias("power"))


@query("k15_snapshot", "fx_pixels", "SELECT iter, COUNT(*) AS n, SUM(power) AS power FROM fx_pixels GROUP BY 1")
def _(p):
    path = scratch_path(p.sparkSession, "snap")
    sinks.snapshot(p, path, "filtered")
    return p.sparkSession.read.parquet(f"{path}/filtered").groupBy(F.col("iter").cast("bigint").alias("iter")).agg(
        F.count("*").alias("n"), F.sum("power").alias("power"))


# --- streams ---------------------------------------------------------------------------------
def _land(df, name):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return path


def _drain(stream, name):
    spark = stream.sparkSession
    out = scratch_path(spark, name)
    stt.run_available(stream, out, scratch_path(spark, name + "-cp"))
    return spark.read.schema(stream.schema).parquet(out)


@query("s6_block_stream", "fx_voltages", f"""
    SELECT CAST(sample // {BLOCK} AS BIGINT) AS iter, ant, COUNT(*) AS n, ROUND(SUM(re), 4) AS re FROM fx_voltages GROUP BY 1, 2""")
def _(v):
    """Landed blocks consumed as a stream to the end."""
    b = v.withColumn("iter", F.floor(F.col("sample") / BLOCK))
    path = _land(b, "blocks")
    out = _drain(sb.block_stream(v.sparkSession, path, b.schema, 4), "blocks-out")
    return out.groupBy("iter", "ant").agg(F.count("*").alias("n"), r(F.sum("re"), 4).alias("re"))


_WHOLE = f"(SELECT COUNT(DISTINCT sample) // {BLOCK} * {BLOCK} FROM fx_voltages)"


@query("s6_raw_stream", "fx_voltages", _DENSE + f"""
    SELECT sample, ant, ROUND(CAST(re AS DOUBLE), 3) AS re, ROUND(CAST(im AS DOUBLE), 3) AS im FROM d
    WHERE sample - (SELECT MIN(sample) FROM fx_voltages) < {_WHOLE}""")
def _(v):
    """Raw files read as a stream of whole blocks, started anew after half of the files."""
    spark = v.sparkSession
    path, out, state = (scratch_path(spark, n) for n in ("raw", "raw-out", "raw-cp"))
    f = frames(v)
    last = f.agg(F.max("iter")).first()[0]
    for part in (F.col("iter") <= last // 8 * 4 - 1, F.col("iter") > last // 8 * 4 - 1):
        sinks.raw_voltages(f.where(part), path)
        stt.run_available(sb.voltage_stream(spark, path, 8, BLOCK), out, state)
    return _long(spark.read.parquet(out))


@query("k1_raw_stream_sink", "fx_voltages", _DENSE + f"""
    SELECT sample, ant, ROUND(CAST(re AS DOUBLE), 3) AS re, ROUND(CAST(im AS DOUBLE), 3) AS im FROM d
    WHERE sample - (SELECT MIN(sample) FROM fx_voltages) < {_WHOLE}""")
def _(v):
    """A stream from raw files to raw files, scanned back."""
    spark = v.sparkSession
    path, copy, state = (scratch_path(spark, n) for n in ("raw", "raw-copy", "raw-cp"))
    sinks.raw_voltages(frames(v), path)
    sinks.raw_voltage_stream(sb.voltage_stream(spark, path, 8, BLOCK), copy, state).awaitTermination()
    return _long(spark.read.format("voltage_raw").option("path", copy).option("nants", 8).option("blocksamples", BLOCK).load())


@query("s1_observations", "fx_voltages", _DENSE + f""",
    o AS (SELECT sample // {BLOCK} % 3 AS obs_id, sample // {BLOCK} // 3 AS iter, ant, re, im FROM d)
    SELECT 'obs' || CAST(obs_id AS BIGINT) AS obs_id, CAST(iter AS BIGINT) AS iter, COUNT(*) // 8 AS n, ROUND(SUM(CAST(re AS DOUBLE)), 2) AS re
    FROM o WHERE obs_id < 2 GROUP BY 1, 2""")
def _(v):
    """Folders of observations scanned as one table with their names."""
    spark = v.sparkSession
    path = scratch_path(spark, "observations")
    f = frames(v)
    for o in range(3):
        sinks.raw_voltages(f.where(F.col("iter") % 3 == o).withColumn("iter", F.floor(F.col("iter") / 3)), f"{path}/obs{o}")
    back = spark.read.format("voltage_raw").option("path", path).option("nants", 8).option("blocksamples", BLOCK).option(
        "observations", "true").load()
    return back.where("obs_id < 'obs2'").groupBy("obs_id", "iter").agg(F.count("*").alias("n"), r(F.sum(F.aggregate(
        "re", F.lit(0.0), lambda a, x: a + x)), 2).alias("re"))


@query("x1_stream_beams", "fx_voltages fx_weights", """
    SELECT v.sample, w.beam_id, ROUND(SUM(v.re * w.re - v.im * w.im), 4) AS re, ROUND(SUM(v.re * w.im + v.im * w.re), 4) AS im
    FROM fx_voltages v JOIN fx_weights w ON v.ant = w.ant GROUP BY v.sample, w.beam_id""")
def _(v, w):
    """Reader and beamformer as one stream over landed frames."""
    f = bf.to_frames(v, 8)
    beams = bf.beamform_frames(sb.block_stream(v.sparkSession, _land(f, "frames"), f.schema, 4), w)
    rows = beams.select("sample", F.posexplode(F.arrays_zip("re", "im")).alias("beam_id", "_v")).select(
        "sample", "beam_id", F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))
    return rounded(_drain(rows, "beams-out"), "re im", 4)


def _track_events(p):
    """Track stream over points landed in several files and batches, and a last row that moves the time on."""
    path = _land(p.repartition(6), "points")
    tick = p.sparkSession.createDataFrame([(10 ** 6,)], "iter long").select(
        *[F.col(c) if c == "iter" else F.lit(None).cast(t).alias(c) for c, t in p.dtypes])
    tick.write.mode("append").parquet(path)
    stream = sb.block_stream(p.sparkSession, path, p.schema, 2)
    return _drain(ss.track_stream(stream, "track_id", 1.0, 1.0, delay="10 hours", **LIMITS), "tracks-out")


@query("x1_stream_power", "fx_voltages", """
    WITH y AS (SELECT ant, CAST(spectrum AS BIGINT) AS m, CAST((k + 4) % 8 AS INT) AS c,
           SUM(re * COS(2 * PI() * k * pos / 8) + im * SIN(2 * PI() * k * pos / 8)) AS re,
           SUM(im * COS(2 * PI() * k * pos / 8) - re * SIN(2 * PI() * k * pos / 8)) AS im
        FROM vx_fir, (SELECT UNNEST(RANGE(0, 8)) AS k) GROUP BY 1, 2, 3),
    g AS (SELECT CAST(m AS BIGINT) AS m, CAST(a AS INT) AS ant, CAST(c AS INT) AS c
        FROM (SELECT UNNEST(RANGE(0, (SELECT COUNT(DISTINCT sample) // 40 * 5 FROM fx_voltages))) AS m),
             (SELECT UNNEST(RANGE(0, 8)) AS a), (SELECT UNNEST(RANGE(0, 8)) AS c)),
    p AS (SELECT g.m // 5 AS iter, g.m % 5 AS t, g.ant, g.c, COALESCE(re * re + im * im, 0) + 1e-14 AS power
        FROM g LEFT JOIN y ON y.m = g.m AND y.ant = g.ant AND y.c = g.c),
    n AS (SELECT iter, ant, c, MEDIAN(power) AS noise FROM p GROUP BY 1, 2, 3),
    l AS (SELECT iter, ant, c, MEDIAN(noise) OVER (PARTITION BY ant, c ORDER BY iter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS level FROM n)
    SELECT 'obs' AS obs_id, p.iter, p.ant AS beam_id, p.c AS channel_sample, CAST(t AS INT) AS time_idx, ROUND(power - level, 3) AS power,
           ROUND(level, 3) AS channel_noise FROM p JOIN l USING (iter, ant, c)""", "vx_fir")
def _(v):
    """Raw files to power above the rolling noise as one stream, started anew half-way; a beam for each antenna."""
    spark = v.sparkSession
    path, out, state = (scratch_path(spark, n) for n in ("raw", "power-out", "power-cp"))
    f = frames(v).withColumn("iter", F.floor(F.col("sample") / 40))
    last = f.agg(F.max("iter")).first()[0]
    weights = spark.createDataFrame([(a, a, 1.0, 0.0) for a in range(8)], "beam_id int, ant int, re double, im double")
    for part in (F.col("iter") <= last // 8 * 4 - 1, F.col("iter") > last // 8 * 4 - 1):
        sinks.raw_voltages(f.where(part), f"{path}/obs")
        slices = bf.beam_slices(sb.voltage_stream(spark, path, 8, 40, True), weights)
        powers = ss.channel_power_stream(slices, 40, 8, 4, 3)
        stt.run_available(powers, out, state)
    rows = spark.read.schema(powers.schema).parquet(out).select(
        "obs_id", "iter", "beam_id", "channel_sample", F.posexplode("power").alias("time_idx", "power"), "channel_noise")
    return rounded(rows, "power channel_noise", 3)


@query("x8_track_events", "vx_cluster_points", first_match_sql("9e15", """
    SELECT e.event AS name, CASE WHEN e.event = 'deleted' THEN 'WARNING' ELSE 'INFO' END AS level, COUNT(*) AS n
    FROM (SELECT UNNEST(events) AS e FROM done) GROUP BY ALL"""))
def _(p):
    """Event log rows of the track stream, counted per kind."""
    return stt.event_log(_track_events(p)).groupBy("name", "level").agg(F.count("*").alias("n"))


@query("x3_stream_rolling_noise", "fx_pixels", f"""
    SELECT iter, beam_id, channel_sample, channel_noise, ROUND(channel_noise_std, 3) AS channel_noise_std FROM ({_ROLL})""", "vx_noise")
def _(p):
    """Keyed state on a stream; the result equals the batch window."""
    n = nz.channel_noise(p)
    path = _land(n, "noise")
    out = _drain(ss.rolling_noise_stream(sb.block_stream(p.sparkSession, path, n.schema, 1000)), "noise-out")
    return rounded(out, "channel_noise_std", 3)


@query("x5_stream_tracks", "vx_cluster_points", first_match_sql("9e15", """
    SELECT track_id, e.no AS track_no, e.status, e.n, e.t0 AS first_sample, e.t1 AS last_sample, ROUND(e.gradient, 5) AS gradient,
           ROUND(e.r, 5) AS r, e.event FROM (SELECT track_id, UNNEST(events) AS e FROM done)"""))
def _(p):
    """Open-track state on a stream with its created / modified / transit events."""
    return rounded(_track_events(p), "gradient r", 5)


@query("k12_event_log", "events", """
    SELECT event_type AS name, COUNT(*) AS n, CAST(COUNT(*) FILTER (event_type = 'deleted') AS BIGINT) AS warnings FROM events GROUP BY 1""")
def _(e):
    """Event rows appended from a stream, counted per name."""
    src = e.select(F.col("event_type").alias("event"), "event_id", "value")
    path = _land(src, "ev")
    log = _drain(stt.event_log(sb.block_stream(e.sparkSession, path, src.schema, 10)), "ev-out")
    return log.groupBy("name").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "WARNING").alias("warnings"))


@query("x7_heartbeat", "events", """
    SELECT 'event-log' AS name, CAST(COUNT(*) AS DOUBLE) AS rows FROM events""")
def _(e):
    """Input rows of all triggers of a named stream."""
    src = e.select(F.col("event_type").alias("event"), "event_id", "value")
    log = stt.event_log(sb.block_stream(e.sparkSession, _land(src, "hb"), src.schema, 1))
    path = scratch_path(e.sparkSession, "heartbeat")
    with stt.heartbeat(e.sparkSession, path):
        log.writeStream.format("noop").queryName("event-log").trigger(availableNow=True).option(
            "checkpointLocation", scratch_path(e.sparkSession, "hb-cp")).start().awaitTermination()
    return stt.heartbeat_rows(e.sparkSession, path).where("event = 'progress'").groupBy("name").agg(F.sum("rows").alias("rows"))


@query("x7_metrics_stream", "fx_voltages", f"""
    SELECT CAST(sample // {BLOCK} AS BIGINT) AS iter, ant, ROUND(SQRT(AVG(re * re + im * im)), 5) AS rms
    FROM fx_voltages WHERE (sample // {BLOCK}) % 10 = 0 GROUP BY 1, 2""")
def _(v):
    """Every tenth block, one time window per block."""
    b = v.withColumn("iter", F.floor(F.col("sample") / BLOCK)).withColumn(
        "ts", F.timestamp_seconds(F.lit(1700000010) + F.col("iter") * 15))
    path = _land(b.repartition(4), "metrics")
    # one row of a much later block closes the windows before it
    b.sparkSession.createDataFrame([(10 ** 7,)], "iter long").select(*[
        F.col(c) if c == "iter" else F.timestamp_seconds(F.lit(1900000000)).alias(c) if c == "ts" else F.lit(None).cast(t).alias(c)
        for c, t in b.dtypes]).write.mode("append").parquet(path)
    m = stt.antenna_metrics(sb.block_stream(v.sparkSession, path, b.schema, 2), watermark="100 days")
    return rounded(_drain(m, "metrics-out"), "rms").select("iter", "ant", "rms")


@query("s17_request_stream", "vx_sched", """
    WITH q AS (SELECT obs_id % 5000 AS obs_id, obs_id AS version, 'obs' || obs_id AS name, start_s, obs_id % 7 = 0 AS deleted FROM vx_sched)
    SELECT obs_id, version, name, start_s FROM q QUALIFY ROW_NUMBER() OVER (PARTITION BY obs_id ORDER BY version DESC) = 1 AND NOT deleted""")
def _(s):
    """Create / delete messages as JSON text, applied to a keyed table."""
    spark = s.sparkSession
    text = F.to_json(F.struct(
        F.when(F.col("obs_id") % 7 == 0, F.lit("delete")).otherwise(F.lit("create")).alias("action"),
        (F.col("obs_id") % 5000).alias("obs_id"), F.concat(F.lit("obs"), F.col("obs_id").cast("string")).alias("name"),
        F.lit("detection").alias("pipeline"), "start_s"))
    m = s.select(text.alias("value"), F.col("obs_id").alias("version"))
    changes = stt.parsed_requests(sb.block_stream(spark, _land(m, "req"), m.schema, 1)).select(
        "obs_id", "version", "name", "start_s", (F.col("action") == "delete").alias("deleted"))
    out = scratch_path(spark, "sched")
    schema = "obs_id bigint, version bigint, name string, start_s bigint"
    stt.upsert_table(changes, out, scratch_path(spark, "sched-cp"), "obs_id", "version", schema).awaitTermination()
    return KeyedTable(spark, out, "obs_id", "version", schema).read()


@query("k10_keyed_table", "vx_cluster_points", """
    WITH v AS (SELECT track_id, iter, COUNT(*) AS n, MAX(snr) AS psnr FROM vx_cluster_points GROUP BY 1, 2)
    SELECT track_id, iter, n, psnr FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY iter DESC) = 1
       AND NOT (track_id % 9 = 0 AND iter > 1)""")
def _(p):
    """A batch per block into the buckets of a table that is merged when read."""
    v = cut(p.groupBy("track_id", "iter").agg(F.count("*").alias("n"), F.max("snr").alias("psnr")))
    table = KeyedTable(p.sparkSession, scratch_path(p.sparkSession, "tracks"), "track_id", "iter",
                       "track_id bigint, iter bigint, n bigint, psnr double")
    changes = v.withColumn("deleted", (F.col("track_id") % 9 == 0) & (F.col("iter") > 1))
    for i in range(v.agg(F.max("iter")).first()[0] + 1):
        table.apply(changes.where(F.col("iter") == i), i)
    return table.read()


@query("k10_track_upsert", "vx_cluster_points", """
    WITH v AS (SELECT track_id, iter, COUNT(*) AS n, MAX(snr) AS psnr FROM vx_cluster_points GROUP BY 1, 2)
    SELECT track_id, iter, n, psnr FROM v QUALIFY ROW_NUMBER() OVER (PARTITION BY track_id ORDER BY iter DESC) = 1 AND track_id % 9 <> 0""")
def _(p):
    """The newest state per track replaces the stored one; cancelled tracks are deleted."""
    v = p.groupBy("track_id", "iter").agg(F.count("*").alias("n"), F.max("snr").alias("psnr"))
    old = v.where("iter <= 1").groupBy("track_id").agg(F.max_by(F.struct("iter", "n", "psnr"), "iter").alias("_r")).select("track_id", "_r.*")
    new = v.where("iter > 1").withColumn("deleted", F.col("track_id") % 9 == 0)
    merged = tr.upsert(old.where("track_id % 9 <> 0"), new, "track_id", "iter", "deleted")
    return merged.where("track_id % 9 <> 0").select("track_id", "iter", "n", "psnr")


# --- pipelines -------------------------------------------------------------------------------
@query("e4_standalone_beams", "fx_voltages fx_weights", A19_SQL)
def _(v, w):
    out = PIPELINES["standalone_beams"](v, w, 10)
    return rounded(rounded(out, "power", 3), "power_db noise_db").select("beam_id", "chunk", "power", "power_db", "noise_db")


@query("e4_correlation", "fx_voltages", """
    SELECT t_idx, baseline, ROUND(re, 4) AS re, ROUND(im, 4) AS im FROM vx_vis""", "vx_vis")
def _(v):
    return rounded(PIPELINES["correlation"](v, 8, 50), "re im", 4).select("t_idx", "baseline", "re", "im")


@query("e4_channelised_correlation", "fx_voltages", """
    WITH s AS (SELECT ant, CAST(spectrum AS BIGINT) AS m, CAST((k + 4) % 8 AS INT) AS channel,
           SUM(re * COS(2 * PI() * k * pos / 8) + im * SIN(2 * PI() * k * pos / 8)) AS re,
           SUM(im * COS(2 * PI() * k * pos / 8) - re * SIN(2 * PI() * k * pos / 8)) AS im
        FROM vx_fir, (SELECT UNNEST(RANGE(0, 8)) AS k) GROUP BY 1, 2, 3)
    SELECT a.channel - 2 AS channel, CAST(FLOOR(a.m / 4) AS BIGINT) AS t_idx,
           CAST(a.ant * 8 - FLOOR(a.ant * (a.ant + 1) / 2) + b.ant - a.ant - 1 AS INT) AS baseline,
           ROUND(SUM(a.re * b.re + a.im * b.im), 2) AS re, ROUND(SUM(a.im * b.re - a.re * b.im), 2) AS im
    FROM s a JOIN s b ON a.m = b.m AND a.channel = b.channel AND a.ant < b.ant WHERE a.channel BETWEEN 2 AND 5 GROUP BY 1, 2, 3""", "vx_fir")
def _(v):
    out = PIPELINES["channelised_correlation"](v, 8, 8, 4, 4, (2, 6))
    return rounded(out, "re im", 2).select("channel", "t_idx", "baseline", "re", "im")


@query("e4_truncate", "fx_voltages", f"""
    SELECT sample, ant, re, im FROM fx_voltages WHERE sample // {BLOCK} BETWEEN 2 AND 9""")
def _(v):
    b = v.withColumn("iter", F.floor(F.col("sample") / BLOCK))
    return PIPELINES["truncate"](b, 2, 9).select("sample", "ant", "re", "im")


@query("e4_power_pixels", "fx_voltages fx_weights")
def _(v, w):
    """Voltages to power pixels: beams, spectra, power."""
    from skysieve.plans.pipelines import power_pixels
    return rounded(power_pixels(v, w, 8, 4, 40), "power", 3)


@query("e4_streak_detection", "fx_streaks")
def _(p):
    return PIPELINES["streak_detection"](p, NC, NT, n_noise_blocks=3, filters=("pepper",))


@query("e4_track_points", "fx_streaks")
def _(p):
    """Pixels of two observations to detections that carry their track."""
    from skysieve.operators.noise import channel_noise, rolling_noise, subtract_noise
    p = p.withColumn("obs_id", F.col("beam_id") % 2)
    channel = ["obs_id", "iter", "beam_id", "channel_sample"]
    noise = rolling_noise(channel_noise(p, channel), 3, ["obs_id", "beam_id", "channel_sample"])
    blocks = p.select("obs_id", "iter").distinct().withColumn("t0_us", F.col("iter") * 15339168)
    t = PIPELINES["track_points"](subtract_noise(p, noise, channel), noise, blocks, NC, NT, 410.0, 0.00001043, SAMPLING_TIME,
                                  filters=("pepper",), gradient=(-1.0, -291.47), warm_up=0)
    return t.select("obs_id", "iter", "beam_id", "time_sample", "channel_sample", "track")


@query("e4_dbscan_detection", "fx_streaks")
def _(p):
    return PIPELINES["dbscan_detection"](p, NC, NT, CHANNEL_HZ, SAMPLING_TIME, linearity=0.8, gradient=(-1.0, -291.47))

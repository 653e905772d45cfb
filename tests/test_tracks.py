import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysieve.operators import association as an, calibrate as cal, schedule as sc, tracks as tr
from skysieve.sinks.keyed import KeyedTable
from skysieve.streaming import blocks as sb, state as ss, tables as stt

DT, DY = 0.1, 10.0


@pytest.fixture(scope="module")
def clusters(spark):
    """Two drifting objects over three blocks and four beams, plus scattered false clusters."""
    rng = np.random.default_rng(21)
    rows, cid = [], 0
    for it in range(3):
        for c0, rate, start, stop in ((900.0, -0.8, 0, 400), (700.0, -1.9, 100, 320)):
            for beam in range(4):
                times = [t for t in range(it * 160, it * 160 + 160) if start <= t < stop and t // 40 % 4 == beam]
                if len(times) < 5:
                    continue
                cid += 1
                rows += [(1, it, beam, cid, t, float(round(c0 + rate * t)), float(rng.uniform(5, 20)), t) for t in times]
        cid += 1
        rows += [(1, it, 9, cid, it * 160 + k, float(rng.integers(0, 900)), 5.0, k) for k in range(8)]
    pdf = pd.DataFrame(rows, columns=["obs_id", "iter", "beam_id", "cluster_id", "time_sample", "channel_sample", "snr", "event_id"]).astype({"beam_id": "int32"})
    schema = "obs_id bigint, iter bigint, beam_id int, cluster_id bigint, time_sample bigint, channel_sample double, snr double, event_id bigint"
    return pdf, spark.createDataFrame(pdf, schema)


def test_first_match_association_finds_the_objects(clusters):
    _, df = clusters
    out = an.associate_first_match(df, "obs_id", DT, DY).where("status <> 'cancelled'").collect()
    assert sorted(round(r.gradient, -1) for r in out) == [-190.0, -80.0]
    assert all(r.status == "terminated" for r in out)
    again = an.associate_first_match(df.repartition(6), "obs_id", DT, DY).where("status <> 'cancelled'").collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_order_free_association_agrees(clusters):
    _, df = clusters
    table = tr.cluster_table(df, ["obs_id", "iter", "beam_id", "cluster_id"], DT, DY)
    got = tr.associate(table, ["obs_id"], "cluster_id").groupBy("track").agg(
        F.count("*").alias("n"), F.avg("slope").alias("slope")).where("n > 1").collect()
    assert sorted(round(r.slope, -1) for r in got) == [-190.0, -80.0]


def test_similar_pairs_miss_nothing(clusters):
    _, df = clusters
    table = tr.cluster_table(df, ["obs_id", "iter", "beam_id", "cluster_id"], DT, DY)
    rows = table.collect()

    def fit(n, sx, sy, sxx, sxy):
        m = (n * sxy - sx * sy) / (n * sxx - sx * sx)
        return m, (sy - m * sx) / n

    want = set()
    for a in rows:
        for b in rows:
            if not (b.iter - a.iter in (0, 1) and (a.iter, a.cluster_id) < (b.iter, b.cluster_id)):
                continue
            m, c = fit(a.n + b.n, a.sx + b.sx, a.sy + b.sy, a.sxx + b.sxx, a.sxy + b.sxy)
            s, i = np.array([a.slope, b.slope, m]), np.array([a.intercept, b.intercept, c])
            if abs(s.std() / s.mean()) < 0.1 and abs(i.std() / i.mean()) < 0.1 and -291.47 <= m <= -57:
                want.add((a.cluster_id, b.cluster_id))
    got = tr.similar_pairs(table, ["obs_id"], "cluster_id").collect()
    assert {(r.src, r.dst) for r in got} == want and len(got) == len(want) and want


def land(df, path, by):
    """One file per block, with increasing modification times."""
    os.makedirs(path)
    for i, (_, g) in enumerate(sorted(df.groupby(by))):
        f = f"{path}/block_{i:05d}.parquet"
        g.to_parquet(f, index=False)
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))


def drain(spark, stream, tmp_path):
    stt.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_noise_stream_equals_batch(spark, tmp_path):
    from skysieve.operators.noise import rolling_noise
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame([(i, b, c, float(rng.normal()), float(rng.uniform())) for i in range(15) for b in range(2) for c in range(3)],
                       columns=["iter", "beam_id", "channel_sample", "noise", "noise_std"]).astype(
        {"beam_id": "int32", "channel_sample": "int32"})
    df = spark.createDataFrame(pdf, "iter bigint, beam_id int, channel_sample int, noise double, noise_std double")
    land(pdf, str(tmp_path / "in"), "iter")
    out = drain(spark, ss.rolling_noise_stream(sb.block_stream(spark, str(tmp_path / "in"), df.schema)), tmp_path)
    key = ["iter", "beam_id", "channel_sample"]
    a = {tuple(r[k] for k in key): (r.channel_noise, r.channel_noise_std) for r in out.collect()}
    b = {tuple(r[k] for k in key): (r.channel_noise, r.channel_noise_std) for r in rolling_noise(df).collect()}
    assert a == b and len(a) == 90


def test_upsert_stream_is_idempotent_per_batch(spark, tmp_path):
    pdf = pd.DataFrame([(1, 1, "a", False), (2, 2, "b", False), (1, 3, "c", False), (2, 4, "", True)], columns=["k", "v", "name", "deleted"])
    pdf["part"] = [0, 0, 1, 1]
    land(pdf, str(tmp_path / "in"), "part")
    s = sb.block_stream(spark, str(tmp_path / "in"), "k bigint, v bigint, name string, deleted boolean").select("k", "v", "name", "deleted")
    schema = "k bigint, v bigint, name string"
    stt.upsert_table(s, str(tmp_path / "t"), str(tmp_path / "cp"), "k", "v", schema).awaitTermination()
    assert [tuple(r) for r in KeyedTable(spark, str(tmp_path / "t"), "k", "v", schema).read().collect()] == [(1, 3, "c")]
    # the same stream from its start: every batch is known
    before = sorted(p.name for p in (tmp_path / "t").rglob("*.parquet"))
    stt.upsert_table(s, str(tmp_path / "t"), str(tmp_path / "cp2"), "k", "v", schema).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "t").rglob("*.parquet")) == before


def test_keyed_table_equals_a_dictionary_and_writes_what_changes(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "k bigint, v bigint, name string"
    table = lambda: KeyedTable(spark, str(tmp_path / "t"), "k", "v", schema, buckets=4)
    want, written = {}, []
    files = lambda: {p: p.stat().st_size for p in (tmp_path / "t").rglob("*.parquet")}
    for batch in range(8):
        n = 4000 if batch == 0 else 12
        rows = [(int(k), int(v), f"{batch}-{v}", bool(batch and rng.random() < 0.2)) for k, v in zip(
            rng.integers(0, 5000, n), rng.permutation(10 * n))]
        for k, v, name, gone in sorted(rows, key=lambda r: r[1]):
            if k not in want or v >= want[k][1]:
                want[k] = (k, v, None if gone else name)
        before = files() if batch else {}
        df = spark.createDataFrame([*rows, (None, 1, "no key", False)], schema + ", deleted boolean")
        if batch == 4:  # killed before the log: a folder without an entry, then the batch again
            (tmp_path / "t" / "batch" / "4" / "_bucket=0").mkdir(parents=True)
            (tmp_path / "t" / "batch" / "4" / "_bucket=0" / "part-x.parquet").write_bytes(b"half")
        table().apply(df, batch)
        table().apply(df, batch)
        written.append(sum(s for p, s in files().items() if p not in before))
        got = sorted(tuple(r) for r in table().read().collect())
        assert got == sorted(r for r in want.values() if r[2])
    assert max(written[1:]) < written[0] / 2  # a small batch does not write the table
    some = [int(k) for k in list(want)[:3]] + [99999]
    assert sorted(tuple(r) for r in table().read(some).collect()) == sorted(r for k, r in want.items() if k in some and r[2])
    n = len(files())
    table().vacuum()
    assert len(files()) <= n and sorted(tuple(r) for r in table().read().collect()) == got
    big = [(k, 10 ** 6, "all", False) for k in range(5000)]
    table().apply(spark.createDataFrame(big, schema + ", deleted boolean"), 8)
    assert any(h["base"] and h["base"][0] == 8 for h in table().state()["held"].values())  # grown batches are merged
    assert table().read().where("name = 'all'").count() == 5000
    assert KeyedTable(spark, str(tmp_path / "none"), "k", "v", schema).read().count() == 0


def test_subscribers_get_their_events(spark, tmp_path):
    pdf = pd.DataFrame({"event": ["created", "deleted", "created"], "x": [1, 2, 3]})
    pdf["part"] = 0
    land(pdf, str(tmp_path / "in"), "part")
    seen = {}
    s = sb.block_stream(spark, str(tmp_path / "in"), "event string, x bigint")
    stt.subscribe(s, {k: (lambda df, i, k=k: seen.__setitem__(k, df.count())) for k in ("created", "deleted")}, str(tmp_path / "cp")).awaitTermination()
    assert seen == {"created": 2, "deleted": 1}


def test_conflicts_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)), i, int(s := rng.integers(0, 400000)), None if i % 9 == 0 else int(s + rng.integers(0, 200000))) for i in range(60)]
    new, old = rows[:25], rows[25:]

    def clash(a, b):
        if a[3] is None or b[3] is None:
            return (b[3] is None and b[2] < a[2]) or (a[3] is None and a[2] < b[2])
        return a[2] <= b[3] and b[2] <= a[3]

    want = {(a[1], b[1]) for a in new for b in old if a[0] == b[0] and clash(a, b)}
    got = sc.conflicts(spark.createDataFrame(new, "station int, new_id int, start_s bigint, end_s bigint"),
                       spark.createDataFrame(old, "station int, obs_id int, start_s bigint, end_s bigint"), ["station"]).collect()
    assert {(r.new_id, r.obs_id) for r in got} == want and len(got) == len(want)


def test_latest_calibration_across_buckets(spark):
    rng = np.random.default_rng(8)
    c = [(1, i, int(rng.integers(0, 90)) * 86400, i) for i in range(40)]
    o = [(1, 100 + i, int(rng.integers(0, 90)) * 86400) for i in range(40)]
    got = cal.latest_calibration(spark.createDataFrame(o, "station int, obs_id bigint, t bigint"),
                                 spark.createDataFrame(c, "station int, calib_id bigint, t bigint, created bigint"), ["station"], 7).collect()
    for r in got:
        before = [x for x in c if x[2] <= r.t]
        assert r.calib_id == (max(before, key=lambda x: (x[2], -x[3]))[1] if before else None)
    assert len(got) == 40


def test_messages_are_ordered_per_track(spark, tmp_path):
    from skysieve.operators import tdm
    from skysieve.sinks.tables import message_files
    pts = spark.createDataFrame([(7, 2, 5, 9.0, 410.1, 1), (7, 1, 4, 8.0, 410.2, 2), (7, 1, 3, 7.0, 410.3, 3)],
                                "track_id bigint, beam_id int, time_sample bigint, snr double, channel double, event_id bigint").withColumn(
        "time", F.timestamp_seconds(F.lit(1700000000) + F.col("time_sample")))
    info = spark.createDataFrame([(1, 10.0, 80.0, 0.5), (2, 20.0, 70.0, 0.6)], "beam_id int, az double, el double, beam_noise double")
    message_files(tdm.messages(pts, info, info, 410.0, "X", 0.1), str(tmp_path / "tdm"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "tdm" / "track_id=7")).collect()]
    assert lines[0] == "CCSDS_TDM_VERS = 1.0" and lines.count("META_START") == 2 and lines[-1] == "DATA_STOP"
    assert lines.index("COMMENT beam_id=1") < lines.index("COMMENT beam_id=2")
    angles = [x for x in lines if x.startswith("ANGLE_1")]
    assert angles == sorted(angles[:2]) + angles[2:]


def tone_frames(spark, obs, drift, n_blocks=6, seed=0):
    """Frames of two antennas with a tone that drifts from block to block, in noise."""
    import numpy as np
    rng, rows, n = np.random.default_rng(seed), [], 64 * 40
    t = np.arange(n_blocks * n)
    phase = 2 * np.pi * np.cumsum((40 - drift * t / 64) / 64 - 0.5)
    x = 6 * np.exp(1j * phase)[:, None] + (rng.normal(size=(len(t), 2)) + 1j * rng.normal(size=(len(t), 2)))
    for i in range(len(t)):
        rows.append((obs, int(i // n), int(i), x[i].real.tolist(), x[i].imag.tolist()))
    return spark.createDataFrame(rows, "obs_id string, iter long, sample long, re array<double>, im array<double>")


def test_voltages_to_tracks_of_two_observations(spark):
    """Both observations together give what each gives alone, a drifting tone becomes one falling track."""
    from skysieve.plans import pipelines as pl
    from skysieve.session import cut
    weights = spark.createDataFrame([(b, a, 1.0, 0.0) for b in range(2) for a in range(2)], "beam_id int, ant int, re double, im double")
    a, b = cut(tone_frames(spark, "a", 0.1, seed=1)), cut(tone_frames(spark, "b", 0.1, seed=2))

    def tracks(frames):
        pixels, noise = pl.dense_pixels(frames, weights, 64, 4, 3)
        blocks = frames.select("obs_id", "iter").distinct().withColumn("t0_us", F.col("iter") * 40_000_000)
        points = cut(pl.track_points(pixels, noise, blocks, 64, 40, 400.0, 1e-6, 1.0, detector="dbscan", gradient=(-0.01, -5.0),
                                     warm_up=1, linearity=0.5))
        table = pl.track_table(points, blocks, 1.0, 1e-6, (-0.01, -5.0), linearity=0.5, max_missing=1.0)
        return sorted(map(str, points.drop("track").collect())), {(r.obs_id, r.track, r.status, round(r.gradient, 6)) for r in table.collect()}

    pa, ta = tracks(a)
    pb, tb = tracks(b)
    both, table = tracks(a.unionByName(b))
    assert pa and pb and both == sorted(pa + pb)
    assert table == ta | tb and all(-0.3 < g < -0.03 for *_, g in table)


def test_reader_to_detector_stream_equals_batch(spark, tmp_path):
    """Raw files of two observations, landed in parts, to detections and tracks by streams alone."""
    from skysieve.operators import beamform as bf
    from skysieve.plans import pipelines as pl
    from skysieve.session import cut
    from skysieve.sinks import tables as sinks
    from skysieve.sources import raw
    weights = spark.createDataFrame([(b, a, 1.0, 0.0) for b in range(2) for a in range(2)], "beam_id int, ant int, re double, im double")
    told = {"n_channels": 64, "n_times": 40, "start_mhz": 400.0, "channel_mhz": 1e-6, "sampling_time": 1.0, "detector": "dbscan",
            "gradient": (-0.01, -5.0), "warm_up": 1, "linearity": 0.5}
    starts = lambda df: df.select("obs_id", "iter").distinct().withColumn("t0_us", F.col("iter") * 40_000_000)
    both = {"a": cut(tone_frames(spark, "a", 0.1, seed=1)), "b": cut(tone_frames(spark, "b", 0.1, 5, seed=2))}
    root, out, state = str(tmp_path / "raw"), str(tmp_path / "found"), str(tmp_path / "cp")

    def detect(pixels, noise):
        return pl.detections(pixels, noise, starts(pixels), **told)

    def run():
        slices = bf.beam_slices(sb.voltage_stream(spark, root, 2, 2560, True), weights)
        stt.detection_stream(ss.channel_power_stream(slices, 2560, 64, 4, 3), out, state, detect).awaitTermination()

    for first, last, which in ((0, 1, "a"), (2, 3, "ab"), (0, 1, "b"), (4, 5, "ab")):  # b begins late, and with a gap to fill
        for o in which:
            sinks.raw_voltages(both[o].where(F.col("iter").between(first, last)), f"{root}/{o}", 1)
        if (first, which) != (2, "ab"):
            run()
    found = spark.read.parquet(out).drop("batch")
    frames = spark.read.format("voltage_raw").option("path", root).option("nants", 2).option("blocksamples", 2560).option(
        "observations", "true").load()
    pixels, noise = pl.dense_pixels(frames, weights, 64, 4, 3)
    batch = cut(pl.detections(pixels, noise, starts(frames), **told))
    place = ["obs_id", "iter", "beam_id", "time_sample", "channel_sample"]
    assert sorted(map(str, found.select(*place, F.round("snr", 6)).collect())) == sorted(map(str, batch.select(*place, F.round("snr", 6)).collect()))
    assert not (tmp_path / "found-late").exists() and found.select("obs_id").distinct().count() == 2
    # the detections as they landed, on to tracks
    rows = lambda df: sorted(map(str, pl.tracked(df, 1e-6, 1.0, (-0.01, -5.0)).select(
        "obs_id", "time_sample", "beam_id", "channel_sample", F.round("snr", 6)).collect()))
    assert rows(found) == rows(batch) and rows(found)


def test_late_samples_are_counted(spark, tmp_path):
    rows = [("o", b, 0, b * 8, [1.0] * 8, [0.0] * 8) for b in range(3)]
    schema = "obs_id string, iter long, beam_id int, first long, re array<double>, im array<double>"
    for i, part in enumerate(([rows[1]], [rows[0], rows[2]], [rows[0]])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = drain(spark, ss.channel_power_stream(sb.block_stream(spark, str(tmp_path / "in"), schema), 8, 4, 2, 2), tmp_path)
        left = [(r["iter"], r.late) for r in out.where("channel_sample = 0 OR late > 0").collect()]
        assert sorted(left) == [[], [(0, 0), (1, 0), (2, 0)], [(0, 0), (1, 0), (2, 0), (2, 8)]][i]


def test_heartbeat_is_written_while_streams_run(spark, tmp_path):
    pdf = pd.DataFrame({"event": ["created"] * 6, "x": range(6), "part": [0, 0, 1, 1, 2, 2]})
    land(pdf, str(tmp_path / "in"), "part")
    beats, seen = str(tmp_path / "beats"), []

    def look(df, i):
        df.count()
        seen.append(len(list((tmp_path / "beats").glob("*.json"))))

    def fail(df, i):
        raise ValueError("no")

    s = sb.block_stream(spark, str(tmp_path / "in"), "event string, x bigint, part bigint")
    with stt.heartbeat(spark, beats):
        stt.subscribe(s, {"created": look}, str(tmp_path / "cp")).awaitTermination()
        with pytest.raises(Exception):
            stt.subscribe(s, {"created": fail}, str(tmp_path / "cp2")).awaitTermination()
    rows = stt.heartbeat_rows(spark, beats)
    assert seen[-1] >= 1  # rows of the running stream
    count = {(r.event, r.n) for r in rows.groupBy("event").agg(F.count("*").alias("n")).collect()}
    assert {("started", 2), ("ended", 1), ("failed", 1)} <= count
    assert sorted(r.rows for r in rows.where("event = 'progress'").collect() if r.rows) == [2.0, 2.0, 2.0]

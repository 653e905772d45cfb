import numpy as np
import pytest

from pyspark.sql import functions as F
from skysieve.operators import packets as pk
from skysieve.sinks import tables as sinks
from skysieve.sources import files, raw, tables


def frames(spark, n=60, ants=3, block=10):
    rows = [(i // block, i, [float(i + a) for a in range(ants)], [float(-i - a) for a in range(ants)]) for i in range(n)]
    return spark.createDataFrame(rows, raw.VOLTAGE_SCHEMA)


def test_raw_round_trip_and_file_layout(spark, tmp_path):
    path = str(tmp_path / "raw")
    sinks.raw_voltages(frames(spark).repartition(5), path, 4)
    assert [p.rsplit("/", 1)[1] for p, _ in raw._list(path)] == ["raw_0.dat", "raw_1.dat"]
    first = np.fromfile(path + "/raw_0.dat", dtype=np.complex64).reshape(-1, 3)
    assert first.shape == (40, 3) and first[2, 1] == 3 - 3j
    back = spark.read.format("voltage_raw").option("path", path).option("nants", 3).option("blocksamples", 10).option("splitbytes", 100).load()
    assert sorted(map(str, back.collect())) == sorted(map(str, frames(spark).collect()))
    assert back.rdd.getNumPartitions() > 2


def test_block_bounds_prune_the_scan():
    from pyspark.sql.datasource import GreaterThanOrEqual, IsNotNull, LessThan
    r = raw.VoltageReader({"path": "", "nants": "3", "blocksamples": "10"})
    left = list(r.pushFilters([IsNotNull(("iter",)), GreaterThanOrEqual(("iter",), 2), LessThan(("iter",), 4)]))
    assert len(left) == 1 and (r.lo, r.hi) == (20, 40)


def test_numeric_file_order(tmp_path):
    for n in ("x.dat", "x_10.dat", "x_2.dat", "other.txt"):
        (tmp_path / n).write_bytes(b"1234")
    assert [p.rsplit("/", 1)[1] for p, _ in raw._list(str(tmp_path))] == ["x.dat", "x_2.dat", "x_10.dat"]


def test_packet_bytes(spark):
    items = [(0x5304 << 48), (0x8001 << 48) | 77, (0x8004 << 48) | 8, (0x9027 << 48) | 1000, (0x9600 << 48) | 5, (0xA004 << 48) | 7,
             (0xA002 << 48) | (3 << 8), 0xA003 << 48, 0x3300 << 48]
    packet = b"".join(i.to_bytes(8, "big") for i in items) + np.array([1, -2, 3, -4], "<i2").tobytes()
    df = spark.createDataFrame([(1, bytearray(packet)), (2, bytearray(b"short"))], "id int, packet binary")
    rows = {r.id: r for r in pk.decode_headers(pk.unpack(df)).collect()}
    a = rows[1]
    assert (a.counter, a.payload_length, a.sync_time, a.packet_ts, a.start_antenna, a.valid, a.iq) == (77, 8, 1000, 5, 3, True, [1, -2, 3, -4])
    assert rows[2].counter is None
    s = pk.payload_samples(pk.decode_headers(pk.unpack(df.where("id = 1"))).select("start_antenna", "iq"), 2).orderBy("ant").collect()
    assert [(r.sample, r.ant, r.re, r.im) for r in s] == [(0, 3, 1.0, -2.0), (0, 4, 3.0, -4.0)]


def test_schedule_file_keeps_bad_entries_apart(spark, tmp_path):
    p = tmp_path / "s.json"
    p.write_text('[{"name": "a", "pipeline": "p", "config_parameters": {"start_s": 5}}, {"name": "b", "config_parameters": {"start_s": "x"}}]')
    rows = tables.schedule_file(spark, str(p)).collect()
    assert [(r.name, r.ok) for r in rows] == [("a", True), ("b", False)]


def test_complex_text(spark):
    df = spark.createDataFrame([("1.5e+00-2.0e-01j",), ("(3+4j)",), ("junk",)], "line string")
    assert [(r.re, r.im) for r in tables.parse_complex(df, "line").collect()] == [(1.5, -0.2), (3.0, 4.0), (None, None)]


def test_skip_by_seconds(spark):
    df = spark.range(20).withColumnRenamed("id", "iter")
    assert [r.iter for r in files.block_range(df, skip_seconds=4.0, seconds=6.0, block_seconds=2.0).collect()] == [2, 3, 4]


def test_partial_frames_are_an_error(spark, tmp_path):
    (tmp_path / "obs_0.dat").write_bytes(b"\0" * (3 * 8 * 2 + 5))
    df = raw.register(spark).read.format("voltage_raw").option("path", str(tmp_path)).option("nants", 2).option("blocksamples", 2).load()
    with pytest.raises(Exception, match="ends within a frame"):
        df.count()


def test_beam_bounds_prune_the_scan(tmp_path):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    (tmp_path / "beam_0.dat").write_bytes(b"\0" * (20 * 3 * 2 * 4))
    reader = raw.BeamReader({"path": str(tmp_path), "nchans": "3", "nbeams": "2"})
    assert list(reader.pushFilters([GreaterThanOrEqual(("time_idx",), 5), LessThan(("time_idx",), 9), LessThan(("channel",), 1)])) == [
        LessThan(("channel",), 1)]
    assert [(f, m) for p in reader.partitions() for _, _, f, m in p.ranges] == [(5, 4)]


def test_binary_sink_shows_whole_jobs_only(spark, tmp_path):
    raw.register(spark)
    frames = spark.range(8).selectExpr("id div 2 AS iter", "id AS sample", "array(float(id), float(0)) AS re", "array(float(1), float(2)) AS im")
    write = lambda df, mode: df.coalesce(1).write.format("voltage_raw").option("path", str(tmp_path)).option(
        "nants", 2).option("blocksamples", 2).option("blocksperfile", 1).mode(mode).save()
    write(frames, "append")
    names = lambda: sorted(p.name for p in tmp_path.iterdir())
    assert names() == [f"raw_{i}.dat" for i in range(4)]
    with pytest.raises(Exception):
        write(frames.withColumn("sample", F.when(F.col("iter") < 2, F.col("sample")).otherwise(F.raise_error(F.lit("lost")))), "append")
    assert [n for n in names() if n.endswith(".dat")] == [f"raw_{i}.dat" for i in range(4)]
    write(frames.where("iter < 2"), "overwrite")
    assert [n for n in names() if n.endswith(".dat")] == ["raw_0.dat", "raw_1.dat"]


def recording(path, blocks, ants=2, block=5, first=0):
    """Raw files of consecutive blocks, a file each; sample numbers in the real parts."""
    path.mkdir(parents=True, exist_ok=True)
    for b in range(first, first + blocks):
        x = np.arange(b * block, b * block + block)[:, None] + 1j * np.arange(ants)
        x.astype(np.complex64).tofile(path / f"raw_{b}.dat")


def stream_run(spark, tmp_path, observations=False):
    from skysieve.streaming import blocks as sb, tables as stt
    stt.run_available(sb.voltage_stream(spark, str(tmp_path / "in"), 2, 5, observations), str(tmp_path / "out"), str(tmp_path / "cp"))
    return sorted((r["iter"], r["sample"], r["re"][1]) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_stream_source_repeats_no_block(spark, tmp_path):
    recording(tmp_path / "in", 3)
    with open(tmp_path / "in" / "raw_3.dat", "wb") as f:  # a file that still grows: less than a block, within a frame
        f.write(np.arange(3, dtype="<f4").tobytes())
    assert stream_run(spark, tmp_path) == [(s // 5, s, float(s)) for s in range(15)]
    recording(tmp_path / "in", 4, first=3)
    assert stream_run(spark, tmp_path) == [(s // 5, s, float(s)) for s in range(35)]
    assert stream_run(spark, tmp_path) == [(s // 5, s, float(s)) for s in range(35)]


def test_stream_source_follows_observations(spark, tmp_path):
    recording(tmp_path / "in" / "a", 2)
    assert len(stream_run(spark, tmp_path, True)) == 10
    recording(tmp_path / "in" / "b", 3)
    recording(tmp_path / "in" / "a", 1, first=2)
    stream_run(spark, tmp_path, True)
    rows = spark.read.parquet(str(tmp_path / "out")).groupBy("obs_id", "iter").count().collect()
    assert sorted(map(tuple, rows)) == [(o, i, 5) for o in "ab" for i in range(3)]


def test_observation_folders(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo
    recording(tmp_path / "x", 2)
    recording(tmp_path / "y", 3)
    options = {"path": str(tmp_path), "nants": "2", "blocksamples": "5", "observations": "true"}
    df = raw.register(spark).read.format("voltage_raw").options(**options).load()
    assert df.columns == ["obs_id", "iter", "sample", "re", "im"]
    assert sorted(map(tuple, df.groupBy("obs_id", "iter").count().collect())) == [
        (o, i, 5) for o, n in (("x", 2), ("y", 3)) for i in range(n)]
    assert df.where("obs_id = 'y' AND iter = 2").count() == 5
    reader = raw.VoltageReader(options)
    assert not list(reader.pushFilters([EqualTo(("obs_id",), "y")]))
    assert {raw._observation(p) for part in reader.partitions() for p, *_ in part.ranges} == {"y"}


def test_stream_sink_shows_whole_epochs_once(spark, tmp_path):
    recording(tmp_path / "in", 6)
    from skysieve.streaming import blocks as sb
    frames = sb.voltage_stream(spark, str(tmp_path / "in"), 2, 5)
    out, names = tmp_path / "out", lambda: sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix == ".dat")
    broken = frames.withColumn("re", F.when(F.col("iter") < 4, F.col("re")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception):
        sinks.raw_voltage_stream(broken, str(out), str(tmp_path / "cp")).awaitTermination()
    assert not out.exists() or not names()
    sinks.raw_voltage_stream(frames, str(out), str(tmp_path / "cp")).awaitTermination()
    back = spark.read.format("voltage_raw").option("path", str(out)).option("nants", 2).option("blocksamples", 5).load()
    want = [(s // 5, s, float(s)) for s in range(30)]
    assert sorted((r["iter"], r["sample"], r["re"][0]) for r in back.collect()) == want
    # the same epoch once more, as after a failure between its commit and the checkpoint's
    again = str(tmp_path / "cp2")
    sinks.raw_voltage_stream(frames, str(out), again).awaitTermination()
    assert sorted((r["iter"], r["sample"], r["re"][0]) for r in back.collect()) == want
    assert not [p for p in out.iterdir() if p.name.endswith(".part")]


def test_half_committed_epoch_is_completed(tmp_path):
    import pyarrow as pa
    batch = lambda a, z: pa.record_batch({"iter": pa.array(np.arange(a, z) // 5), "sample": pa.array(np.arange(a, z)),
                                          "re": pa.array([[float(i)] for i in range(a, z)], pa.list_(pa.float32())),
                                          "im": pa.array([[0.0]] * (z - a), pa.list_(pa.float32()))})
    writer = raw.VoltageStreamWriter({"path": str(tmp_path)})
    messages = [writer.write(iter([batch(5, 10), batch(0, 5)])), writer.write(iter([batch(15, 20)])), writer.write(iter([]))]
    part, name = messages[0].files[0]
    import os
    os.rename(part, name)  # killed after the first move
    messages = [writer.write(iter([batch(0, 10)])), writer.write(iter([batch(15, 20)])), None]
    writer.commit(messages, 0)
    assert sorted(p.name for p in tmp_path.glob("*.dat")) == ["raw_0.dat", "raw_3.dat"]
    assert np.fromfile(tmp_path / "raw_0.dat", np.complex64).real.tolist() == list(range(10))
    writer.commit([writer.write(iter([batch(0, 10)]))], 0)  # known: nothing new appears
    left = {p.name for p in tmp_path.iterdir()}
    assert {"raw_0.dat", "raw_3.dat", "_epochs"} <= left and np.fromfile(tmp_path / "raw_0.dat", np.complex64).size == 10


def test_beam_stream_sink(spark, tmp_path):
    rows = [(t, c, [float(t), float(c)]) for t in range(40) for c in range(3)]
    df = spark.createDataFrame(rows, raw.BEAM_SCHEMA)
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sinks.beam_power_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"), 10).awaitTermination()
    back = spark.read.format("beam_raw").option("path", str(tmp_path / "out")).option("nchans", 3).option("nbeams", 2).load()
    assert sorted((r.time_idx, r.channel, list(r.power)) for r in back.collect()) == [tuple(r) for r in rows]


def test_overwrite_deletes_only_after_the_new_files_are_there(tmp_path):
    recording(tmp_path, 3)
    writer = raw.VoltageWriter({"path": str(tmp_path), "blocksperfile": "1"}, True)
    (tmp_path / ".new.part").write_bytes(b"\0" * 80)
    bad = raw.Written([(str(tmp_path / ".new.part"), str(tmp_path / "raw_0.dat")), (str(tmp_path / ".none.part"), str(tmp_path / "raw_1.dat"))])
    with pytest.raises(Exception):
        writer.commit([bad])
    assert sorted(p.name for p in tmp_path.glob("*.dat")) == ["raw_0.dat", "raw_1.dat", "raw_2.dat"]

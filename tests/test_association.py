"""First-match association: parts against the sequential rule, the rule against points, streams against batches."""

import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skysieve.operators import association as an
from skysieve.streaming import blocks as sb, state as ss, tables as stt

SCHEMA = ("obs_id bigint, iter bigint, beam_id int, cluster_id bigint, time_sample bigint, channel_sample double, snr double, "
          "event_id bigint")
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
DT, DY, LEN = 0.1, 10.0, 40


def observations(seed, n_obs=6, n_blocks=9, overlap=False):
    """Drifting objects that appear, pause and end, over beams, with false clusters."""
    rng = np.random.default_rng(seed)
    rows, cid = [], 0
    for obs in range(n_obs):
        objects = [(rng.uniform(500, 5000), -rng.uniform(0.6, 2.8), int(rng.integers(0, n_blocks * LEN // 2)), int(rng.integers(20, 200)))
                   for _ in range(rng.integers(2, 7))]
        for it in range(n_blocks):
            if rng.random() < 0.15:
                continue
            for c0, rate, start, length in objects:
                for beam in rng.choice(5, rng.integers(1, 4), replace=False).tolist():
                    times = [t for t in range(it * LEN, it * LEN + LEN) if start <= t < start + length and rng.random() < 0.5]
                    if len(times) < 3:
                        continue
                    cid += 1
                    rows += [(obs, it, beam, cid, t, float(round(c0 + rate * t + rng.normal(0, 0.3))), float(rng.integers(5, 9)), len(rows))
                             for t in times]
                    if overlap and rng.random() < 0.5:  # a second cluster of the same places
                        cid += 1
                        rows += [(obs, it, beam, cid, t, float(round(c0 + rate * t + 2)), float(rng.integers(5, 9)), len(rows))
                                 for t in times]
            cid += 1
            rows += [(obs, it, 9, cid, it * LEN + k, float(rng.integers(0, 5000)), 5.0, len(rows)) for k in range(6)]
    pdf = pd.DataFrame(rows, columns=COLUMNS).astype({"beam_id": "int32"})
    return pdf


def by_points(pdf, rules):
    """The rule on plain lists of points, nothing carried over but the points."""
    def fit(p):
        x, y = p[:, 0] * rules.dt, p[:, 1] * rules.dy
        if len(p) < 2 or x.var() == 0:
            return np.nan, np.nan, np.nan
        slope = ((x - x.mean()) * (y - y.mean())).mean() / x.var()
        return slope, y.mean() - slope * x.mean(), np.corrcoef(x, y)[0, 1] if y.var() > 0 else np.nan

    def strongest(p):
        held = {}
        for t, y, s, b in p[np.lexsort((p[:, 1], -p[:, 2]))].tolist():
            held.setdefault((t, b), (t, y, s, b))
        return np.array(list(held.values()))

    def missing(p):
        t = set(p[:, 0])
        return (max(t) - min(t) - (len(t) - 1) + 1) / len(p)

    def good(p):
        slope, _, r = fit(p)
        a = min(abs(r), 1) if r == r else 0
        sure = len(p) >= 5 or len(p) == 4 and 1 - a <= 0.01 or len(p) == 3 and 1 - 2 * np.arcsin(a) / np.pi <= 0.01
        return r <= -0.99 and sure and rules.gradient[1] <= slope <= rules.gradient[0] and missing(p) <= rules.merge_missing

    def parent(a, b):
        v = np.array([fit(a), fit(b), fit(np.concatenate([a, b]))])
        with np.errstate(all="ignore"):
            cv = np.abs(v[:, :2].std(0) / v[:, :2].mean(0))
        return (cv < rules.max_cv).all() and rules.gradient[1] <= v[2, 0] <= rules.gradient[0]

    def valid(p):
        slope, _, r = fit(p)
        return len(set(p[:, 3])) > 5 or (len(set(p[:, 1])) >= 5 and len(set(p[:, 0])) >= 5 and abs(r) >= rules.linearity
                                         and rules.gradient[1] <= slope <= rules.gradient[0] and missing(p) <= rules.valid_missing)

    out = []
    for obs, part in pdf.groupby("obs_id"):
        tracks, names = [], 0
        for it in range(int(part["iter"].max()) + 1):
            block = part[part["iter"] == it]
            groups = sorted(((b, int(g["time_sample"].min()), c), g[["time_sample", "channel_sample", "snr", "beam_id"]].to_numpy(float))
                            for (b, c), g in block.groupby(["beam_id", "cluster_id"]))
            for _, c in groups:
                for t in tracks:
                    if t[1] == "pending" and parent(strongest(t[2]), strongest(c)) and good(np.concatenate([t[2], c])):
                        t[2] = np.concatenate([t[2], c])
                        break
                else:
                    if good(c):
                        tracks.append([names, "pending", c])
                        names += 1
            for t in tracks:
                if t[1] == "pending":
                    if len(block) and not valid(t[2]):
                        t[1] = "cancelled"
                    elif (it + 1) * rules.block_s > t[2][:, 0].max() * rules.dt + rules.expiry_s:
                        t[1] = "terminated"
        out += [(obs, n, s, len(p), int(p[:, 0].min()), int(p[:, 0].max())) for n, s, p in tracks]
    return sorted(out)


def plain(df):
    return sorted((r.obs_id, r.track_no, r.status, r.n, r.first_sample, r.last_sample) for r in df.collect())


@pytest.mark.parametrize("seed,expiry,overlap", [(1, 3.0, False), (2, 9.0, False), (3, 3.0, True), (4, 9.0, True)])
def test_parts_equal_the_rule_on_points(spark, seed, expiry, overlap):
    pdf = observations(seed, overlap=overlap)
    df = spark.createDataFrame(pdf, SCHEMA)
    limits = {"expiry_s": expiry, "merge_missing": 4.0, "valid_missing": 4.0}
    want = by_points(pdf, an.Rules(DT, DY, LEN, **limits))
    got = plain(an.associate_first_match(df.repartition(5), "obs_id", DT, DY, LEN, **limits))
    assert got == want and {s for _, _, s, *_ in want} >= {"terminated"}
    assert plain(an.sequential(df, "obs_id", DT, DY, LEN, **limits)) == want


def test_parts_are_smaller_than_observations(spark):
    pdf = observations(5, n_obs=1, n_blocks=20)
    df = spark.createDataFrame(pdf, SCHEMA)
    rules = an.Rules(DT, DY, LEN)
    sizes = an.part_sizes(an.association_parts(df, "obs_id", rules), "obs_id").collect()
    n = pdf[["iter", "beam_id", "cluster_id"]].drop_duplicates().shape[0]
    assert sum(r.clusters for r in sizes) == n and max(r.clusters for r in sizes) < n


def test_small_parts_share_their_calls(spark):
    """A call of Python for each part took the time of observations that are many and small."""
    pdf = observations(11, n_obs=40)
    rules = an.Rules(DT, DY, LEN, merge_missing=4.0, valid_missing=4.0)
    df = spark.createDataFrame(pdf, SCHEMA)
    parts = an.association_parts(df, "obs_id", rules)
    folded = an._folded(df.join(parts, ["obs_id", *an.CLUSTER]), "obs_id", rules)
    plan = folded._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan
    assert sorted((r.obs_id, r.status, r.n, r.first_sample, r.last_sample) for r in folded.collect()) == sorted(
        (o, s, *rest) for o, _, s, *rest in by_points(pdf, rules))


@pytest.mark.parametrize("seed", [12, 13])
def test_parts_in_tasks_equal_parts_by_joins(spark, monkeypatch, seed):
    pdf = observations(seed, n_obs=5, n_blocks=12, overlap=True)
    rng = np.random.default_rng(seed)
    rows = [[None if c not in ("beam_id", "cluster_id", "event_id") and rng.random() < 0.02 else v for c, v in zip(COLUMNS, row)]
            for row in pdf.astype(object).to_numpy().tolist()]
    df = spark.createDataFrame(rows, SCHEMA)
    rules = an.Rules(DT, DY, LEN, expiry_s=9.0)
    found = []
    for most in (an.TASK_CLUSTERS, 50, 0):  # all in tasks, some by joins, all by joins
        monkeypatch.setattr(an, "TASK_CLUSTERS", most)
        found.append(sorted(map(str, an.association_parts(df, "obs_id", rules).collect())))
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_plain_numbers_equal_arrays():
    rng = np.random.default_rng(14)
    for n in (1, 2, 3, 5, 7, 8, 30):
        x, y = np.sort(rng.integers(0, 700, n)) * DT, rng.integers(-900, 900, n) * DY
        a, b = an.moments(x, y), an.moments(x[: n // 2 + 1], -y[: n // 2 + 1])
        assert an._moments(x.tolist(), y.tolist()) == tuple(a) and an._together(tuple(a), tuple(b)) == tuple(an.together(a, b))
        want = [float(v) for v in an.lines(a)]
        assert np.array_equal(an._line(tuple(a)), want, equal_nan=True)
        v = rng.normal(size=3)
        assert an._spread(*v.tolist()) == an.spread(*v)


def test_many_open_tracks_are_compared_as_few():
    """Arrays and plain numbers pick the same track."""
    rules = an.Rules(DT, DY, LEN, expiry_s=60.0, merge_missing=9.0, valid_missing=9.0)
    rng = np.random.default_rng(15)
    few, many = an.FirstMatch(rules), an.FirstMatch(rules)
    for it in range(3):
        t = np.arange(it * LEN, it * LEN + LEN, 4)
        clusters = [an.Track.of(rules, it, (0, k), np.stack([t, np.round(9000 - 300 * (k % 60) - 1.0 * t), np.full(len(t), 5.0),
                                                              np.zeros(len(t))], 1)) for k in rng.permutation(90).tolist()]
        assert not list(many.block(clusters, it))
    assert len(many.tracks) > 24
    own = an.Track.of(rules, 3, (0, 1), np.stack([t + LEN, np.round(9000 - 300 * 7 - 1.0 * (t + LEN)), np.full(len(t), 5.0), np.zeros(len(t))], 1))
    found = list(many._near(own))
    each = []
    for i, track in enumerate(many.tracks):
        few.tracks = [track]
        each += [i for _ in few._near(own)]
    assert found == each and found


def test_strayed_tracks_fall_back_to_the_whole(spark, monkeypatch):
    pdf = observations(6, overlap=True)
    df = spark.createDataFrame(pdf, SCHEMA)
    want = plain(an.sequential(df, "obs_id", DT, DY, LEN))
    monkeypatch.setattr(an.FirstMatch, "_strays", lambda self, track, of: True)
    assert plain(an.associate_first_match(df, "obs_id", DT, DY, LEN)) == want


def test_no_clusters(spark):
    assert an.associate_first_match(spark.createDataFrame([], SCHEMA), "obs_id", DT, DY).count() == 0


def test_moments_merge():
    rng = np.random.default_rng(7)
    x, y = rng.normal(1e5, 30, 50), rng.normal(-1e4, 20, 50)
    for cut in (0, 1, 17, 50):
        m = an.together(an.moments(x[:cut], y[:cut]), an.moments(x[cut:], y[cut:]))
        assert np.allclose(m, an.moments(x, y), rtol=1e-9)


# --- streams ---------------------------------------------------------------------------------
def land(pdf, path, batches):
    """One file per batch, with increasing modification times."""
    os.makedirs(path, exist_ok=True)
    n = len(os.listdir(path))
    for i, g in enumerate(batches):
        f = f"{path}/batch_{n + i:05d}.parquet"
        g.astype({"obs_id": "Int64", "cluster_id": "Int64", "beam_id": "Int32", "time_sample": "Int64", "event_id": "Int64"}).to_parquet(f, index=False)
        os.utime(f, (1_700_000_000 + n + i, 1_700_000_000 + n + i))


def tick(block):
    return pd.DataFrame([(None, block, None, None, None, None, None, None)], columns=COLUMNS)


def drain(spark, tmp_path, **kw):
    stream = ss.track_stream(sb.block_stream(spark, str(tmp_path / "in"), SCHEMA), "obs_id", DT, DY, LEN, **kw)
    stt.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    return spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()


def ended(rows):
    return sorted((r.obs_id, r.track_no, r.status, r.n, r.first_sample, r.last_sample) for r in rows if r.event in ("transit", "deleted"))


def test_stream_equals_batch_over_many_batches(spark, tmp_path):
    pdf = observations(8, n_obs=3)
    limits = {"merge_missing": 4.0, "valid_missing": 4.0}
    rng = np.random.default_rng(9)
    batches = []
    for _, g in pdf.groupby("iter"):  # each block in two files, the second after the next block has begun
        first = rng.random(len(g)) < 0.5
        batches += [g[first], g[~first]]
    order = [0, *[j for i in range(1, len(batches) - 1, 2) for j in (i + 1, i)], len(batches) - 1]
    land(pdf, str(tmp_path / "in"), [batches[i] for i in order])
    land(pdf, str(tmp_path / "in"), [tick(500), tick(501)])
    rows = drain(spark, tmp_path, delay=f"{int(2.5 * LEN * DT)} seconds", **limits)
    batch = an.associate_first_match(spark.createDataFrame(pdf, SCHEMA), "obs_id", DT, DY, LEN, **limits)
    # at the end of time no track is open any more
    want = [(o, t, "terminated" if s == "pending" else s, *rest) for o, t, s, *rest in plain(batch)]
    assert ended(rows) == want and not [r for r in rows if r.event == "late"]
    kinds = [r.event for r in rows]
    assert kinds.count("created") >= len([w for w in want if w[2] == "terminated"]) and "modified" in kinds


def test_tracks_expire_in_silence_and_after_a_restart(spark, tmp_path):
    pdf = observations(10, n_obs=2)
    first = pdf[pdf.obs_id == 0]
    first = first[first["iter"] <= 4]
    land(pdf, str(tmp_path / "in"), [first])
    before = drain(spark, tmp_path)
    still_open = {r.track_no for r in before if r.event == "created"} - {r.track_no for r in before if r.event in ("transit", "deleted")}
    assert still_open
    # only another observation goes on: the tracks of the first one end all the same
    other = pdf[(pdf.obs_id == 1) & (pdf["iter"] > 5)]
    land(pdf, str(tmp_path / "in"), [other, tick(400), tick(401)])
    rows = [r for r in drain(spark, tmp_path) if r.obs_id == 0]
    batch = an.associate_first_match(spark.createDataFrame(first, SCHEMA), "obs_id", DT, DY, LEN)
    assert ended(rows) == [(o, t, "terminated" if s == "pending" else s, *rest) for o, t, s, *rest in plain(batch)]
    assert still_open <= {r.track_no for r in rows if r.event == "transit"}
    # nothing is left behind once all tracks have ended
    again = len(drain(spark, tmp_path))
    assert again == len(spark.read.parquet(str(tmp_path / "out")).collect())


def test_observations_of_a_bucket_share_state_rows_and_calls(spark, tmp_path):
    """A state of its own for each block of each observation took the time of observations that are many and small."""
    pdf = observations(16, n_obs=30)
    limits = {"merge_missing": 4.0, "valid_missing": 4.0}
    land(pdf, str(tmp_path / "in"), [pdf.iloc[::2], pdf.iloc[1::2], tick(5000), tick(5001)])
    stream = ss.track_stream(sb.block_stream(spark, str(tmp_path / "in"), SCHEMA), "obs_id", DT, DY, LEN, delay="1 hour", **limits, **(
        {"buckets": 3} if "buckets" in ss.track_stream.__code__.co_varnames else {}))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"])
    assert held < pdf[["obs_id", "iter"]].drop_duplicates().shape[0] / 2
    batch = an.associate_first_match(spark.createDataFrame(pdf, SCHEMA), "obs_id", DT, DY, LEN, **limits)
    want = [(o, t, "terminated" if s == "pending" else s, *rest) for o, t, s, *rest in plain(batch)]
    assert ended(spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()) == want


@pytest.mark.parametrize("buckets", [1, 50])
def test_several_key_columns_nulls_and_times_of_their_own(spark, tmp_path, buckets):
    pdf = observations(17, n_obs=6)
    limits = {"merge_missing": 4.0, "valid_missing": 4.0}
    batch = an.associate_first_match(spark.createDataFrame(pdf, SCHEMA), "obs_id", DT, DY, LEN, **limits)
    big = 2 ** 60 + 1  # no number of floating point
    names = {0: ("a", big), 1: ("a", big + 1), 2: (None, big), 3: ("a", None), 4: (None, None), 5: ("b", big)}
    landed = pdf.assign(site=pdf.obs_id.map(lambda o: names[o][0]), obs_id=pd.array([names[o][1] for o in pdf.obs_id], "Int64"),
                        start=(pdf.obs_id * 1700).astype("Int64"))
    late = landed[landed["iter"] == 0]
    parts = [g for _, g in landed.groupby(landed["iter"] // 2)]
    empty = dict.fromkeys(landed.columns)
    ticks = [pd.DataFrame([empty | {"iter": b}], columns=landed.columns).astype({"start": "Int64", "site": "string"}) for b in (600, 601)]
    land(landed, str(tmp_path / "in"), [*parts, ticks[0], late, ticks[1]])  # what comes after the time has passed changes nothing
    stream = ss.track_stream(sb.block_stream(spark, str(tmp_path / "in"), SCHEMA + ", site string, start bigint"), ["site", "obs_id"], DT, DY,
                             LEN, delay="20 seconds", start_ms="start", buckets=buckets, **limits)
    stt.run_available(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    rows = spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()
    number = {v: k for k, v in names.items()}
    got = sorted((number[r.site, r.obs_id], r.track_no, r.status, r.n, r.first_sample, r.last_sample) for r in rows if r.event in ("transit", "deleted"))
    assert got == [(o, t, "terminated" if s == "pending" else s, *rest) for o, t, s, *rest in plain(batch)] and {g[0] for g in got} >= {2, 3}


class Store:
    """State of one key, with a count of the calls that would cross to the state store."""

    def __init__(self):
        self.calls, self.timers = 0, set()

    def getMapState(self, *_):
        return Held(self)

    getValueState = getMapState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Held:
    def __init__(self, store):
        self.store, self.values, self.value = store, {}, None

    def __getattr__(self, name):
        self.store.calls += 1
        return {"exists": lambda: self.value is not None, "get": lambda: self.value, "update": lambda v: setattr(self, "value", v),
                "keys": lambda: list(self.values), "getValue": self.values.get, "updateValue": self.values.__setitem__,
                "removeKey": self.values.pop}[name]


class Now:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_a_bucket_takes_its_observations_together_and_counts_late_rows():
    rules = an.Rules(DT, DY, LEN, merge_missing=9.0, valid_missing=9.0)
    names = ["obs_id", "iter", "beam_id", "cluster_id", "time_sample", "channel_sample", "snr", "start_ms"]
    rows = pa.schema([(n, pa.float64() if n in names[4:7] else pa.int64()) for n in names])
    out = pa.schema([("obs_id", pa.int64()), *((c.split()[0], {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[c.split()[1]])
                                               for c in ss.TRACK_OUT.split(", "))])
    bucket, store = ss.OpenTracks(rules, ["obs_id"], rows, out), Store()
    bucket.init(store)

    def block(number, some):  # a falling line for each observation
        points = [(o, number, 0, number, t, float(9000 + 50 * o - t), 5.0, 0) for o in some for t in range(number * LEN, number * LEN + LEN, 4)]
        table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*points), rows)], schema=rows).combine_chunks()
        return {"end_ms": 4000 * (number + 1), "rows": table.to_batches()[0].serialize().to_pybytes()}

    def told(rows):
        return [r for x in rows for r in pa.ipc.read_record_batch(pa.py_buffer(x["rows"]), out).to_pylist()]

    def fire(now):
        found = []
        while min(store.timers, default=now + 1) <= now:
            at = min(store.timers)
            found += told(bucket.handleExpiredTimer((0,), Now(now), None))
            store.timers.discard(at)
        return found

    assert not list(bucket.handleInputRows((0,), iter([block(n, range(300)) for n in (0, 1)]), Now(0)))
    events = fire(8000)
    assert [r["event"] for r in events].count("created") == [r["event"] for r in events].count("modified") == 300
    assert store.calls < 50 and len(store.timers) == 1
    late = told(bucket.handleInputRows((0,), iter([block(1, [7, 8]), block(1, [500]), block(2, [7])]), Now(8000)))
    assert sorted((r["obs_id"], r["event"], r["n"], r["track_no"]) for r in late) == [(7, "late", 10, None), (8, "late", 10, None)]
    ended = fire(10 ** 7)
    assert not store.timers and sorted((r["obs_id"], r["n"]) for r in ended if r["event"] == "transit") == sorted(
        [(o, 30 if o == 7 else 20) for o in range(300)] + [(500, 10)])


def test_state_does_not_grow_with_a_track():
    rules = an.Rules(DT, DY, LEN, merge_missing=9.0, valid_missing=9.0)
    match, sizes = an.FirstMatch(rules), []
    for it in range(60):
        t = np.arange(it * LEN, it * LEN + LEN, 2)
        rows = np.stack([t, np.round(9000 - 1.0 * t), np.full(len(t), 5.0), np.full(len(t), it % 9)], 1)
        assert not list(match.block([an.Track.of(rules, it, (it % 9, it), rows)], it))
        held = ss.OpenTracks._stored(match.tracks[0], 0)
        sizes.append(len(str(held)))
        match.tracks = [ss.OpenTracks._track(match.tracks[0].founder, held)]
    assert len(match.tracks) == 1 and match.tracks[0].raw[0] == 60 * LEN / 2 and max(sizes[10:]) < 1.2 * sizes[10]

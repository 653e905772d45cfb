"""Steps that grew faster than their input: what their plans hold, and their results on odd rows."""

import inspect

import numpy as np
import pytest

from skysieve.operators import calibrate as cal, graph, hough, image, partition as pt, streaks as st, thresholds as th

PIXELS = "iter bigint, beam_id int, channel_sample int, time_idx int, power double"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(3)
    rows = {(int(i), int(b), int(c), int(t)): float(p) for i, b, c, t, p in zip(
        rng.integers(0, 9, 3000), rng.integers(0, 3, 3000), rng.integers(0, 32, 3000), rng.integers(0, 40, 3000), rng.integers(-3, 9, 3000))}
    rows = [(*k, p) for k, p in rows.items()]
    return rows, spark.createDataFrame(rows, PIXELS)


def test_votes_are_not_shuffled(spark, pixels):
    rows, df = pixels
    odd = [(None, 1, 3, 4, 1.0), (None, 1, 3, 4, 2.0), (5, None, 7, None, 1.0), (0, 0, 1, 1, None)]
    got = hough.votes(df.unionByName(spark.createDataFrame(odd, PIXELS)), 20)
    assert "Generate" not in plan(got) and "theta" not in "".join(x for x in plan(got).splitlines() if "Exchange" in x)
    want = {}
    for i, b, c, t, p in rows + odd:
        for k in range(20 if p and p > 0 else 0):
            a = -np.pi / 2 + k * (np.pi / 19)
            cell = (i, b, k, None if t is None else int(np.floor(t * np.cos(a) + c * np.sin(a) + 0.5)))
            want[cell] = want.get(cell, 0) + 1
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(want) and {r[:4]: r[4] for r in found} == want


def test_minimum_smooths_once_in_all_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, 0, float(x)) for i in range(30) for x in [*rng.normal(20, 4, 60), *rng.normal(70, 4, 60)]]
    got = th.minimum(spark.createDataFrame(rows, "iter bigint, beam_id int, power double"), 64)
    p = plan(got)
    assert "ArrowEvalPython" not in p and p.count("MapInArrow") == 1 and "Generate" not in p
    want = {}
    for i in range(30):
        n, edges = np.histogram([r[2] for r in rows if r[0] == i], 64)
        if (v := th._valleys(n[None].astype(float))[0]) is not None:
            want[i] = (edges[v] + edges[v + 1]) / 2
    assert len(want) > 20 and {r.iter: r.threshold for r in got.collect()} == pytest.approx(want)


def test_rows_of_a_block_of_histograms_are_their_own():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 4, (70, 50)).astype(float)
    assert th._valleys(h, 300) == [th._valleys(h[i:i + 1], 300)[0] for i in range(70)] == th._valleys(h, 300, together=7)


def test_median_of_sparse_and_negative_windows(pixels):
    rows, df = pixels
    got = image.median_filter(df, 32, 40, 6, tile=8)
    assert "FlatMapGroupsInPandas" not in plan(got)
    m = {}
    for i, b, c, t, p in rows:
        m.setdefault((i, b), np.zeros((32, 40)))[c, t] = p
    m = {k: np.pad(x, 3, mode="symmetric") for k, x in m.items()}
    found = got.collect()
    assert len(found) == len(rows)
    for r in found:
        box = m[r.iter, r.beam_id][r.channel_sample: r.channel_sample + 6, r.time_idx: r.time_idx + 6]
        assert r.filtered == np.sort(box.ravel())[18]


def test_calibrator_windows_hold_no_lists(spark):
    rng = np.random.default_rng(5)
    requests = [(int(k), int(a), int(a + w)) for k, a, w in zip(rng.integers(0, 60, 80), rng.integers(0, 5000, 80), rng.integers(-50, 4000, 80))]
    requests += [(None, 100, 3000), (7, None, 9), (8, 1000, 2000)]
    transits = [(int(s), int(t)) for s, t in zip(rng.integers(0, 4, 90), rng.integers(0, 8000, 90))] + [(None, 1500), (1, None), (2, 1990), (2, 1990)]
    got = cal.calibrator_windows(spark.createDataFrame(requests, "request_id long, from_s long, to_s long"),
                                 spark.createDataFrame(transits, "source long, transit_s long"), 10, 5, 1000)
    assert "collect_set" not in plan(got)
    want = {}
    for k, a, b in requests:
        for s, t in transits:
            if a is not None and t is not None and a + 10 < t < b - 5:
                want[k, s] = max(t, want.get((k, s), t))
    found = got.collect()
    assert len(found) == len(want) and {(r.request_id, r.source): r.transit_s for r in found} == want


def test_lines_are_drawn_together(spark):
    from skysieve.functions.table_functions import register
    lines = [(i, i % 17, i % 5, (i * 7) % 60, (i * 3) % 40) for i in range(700)]
    df = spark.createDataFrame(lines, "id int, t0 int, c0 int, t1 int, c1 int")
    got = register(spark).sql("SELECT * FROM rasterise(TABLE(SELECT * FROM {d}))", d=df)
    assert "ArrowEvalPythonUDTF" in plan(got)
    assert sorted(map(tuple, got.select("id", "time_idx", "channel_sample").collect())) == sorted(
        map(tuple, hough.rasterise(df).select("id", "time_idx", "channel_sample").collect()))


def test_leaves_are_made_once_and_links_not_shuffled(spark, pixels):
    rows, df = pixels
    noise = df.groupBy("iter", "beam_id").agg({"power": "avg"}).withColumnRenamed("avg(power)", "beam_noise")
    leaves = pt.kd_partition(df, 32, 40, 10)
    kept = pt.leaf_gate(leaves, noise)
    assert plan(kept).count("MapInArrow") == 1 and "FlatMapGroupsInPandas" not in plan(kept)
    edges = st.leaf_edges(leaves)
    assert "Generate" not in plan(edges)
    of = {(r.iter, r.beam_id, r.channel_sample, r.time_idx): r.leaf for r in leaves.collect()}
    steps = st.link_offsets()
    want = {(i, b, c, t, c + dc, t + dt) for (i, b, c, t), leaf in of.items() for dc, dt in steps if of.get((i, b, c + dc, t + dt)) == leaf}
    found = edges.collect()
    assert {(r.iter, r.beam_id, r.c1, r.t1, r.c2, r.t2) for r in found} == want and len(found) == len(want)


def test_contraction_holds_few_edges():
    assert inspect.signature(graph._contract).parameters["buffer_rows"].default <= 100_000

import numpy as np
import pytest

from skysieve.operators import dbscan as db, graph, partition as pt, streaks as st
from skysieve.session import cut

NC, NT = 48, 30
PIXELS = "iter bigint, beam_id int, channel_sample int, time_idx int, power double"


def union_find(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("name", ["random", "chain", "hub"])
def test_components(spark, name):
    rng = np.random.default_rng(7)
    n = 200
    edges = {"random": [tuple(map(int, rng.integers(0, n, 2))) for _ in range(130)],
             "chain": [(i, i + 1) for i in range(n - 1)],
             "hub": [(0, i) for i in range(1, n, 2)]}[name]
    want = union_find(n, edges)
    df = spark.createDataFrame(edges, "src bigint, dst bigint")
    for parts in (1, 5):
        got = {r.node: r.component for r in graph.connected_components(df.repartition(parts)).collect()}
        touched = {x for e in edges if e[0] != e[1] for x in e}
        assert got == {x: want[x] for x in touched}


def test_components_by_rounds_only(spark, monkeypatch):
    """Without the local step, the distributed rounds alone give the same answer."""
    n = 60
    edges = [(i, i + 1) for i in range(n - 1)] + [(100, 101), (101, 150)]
    monkeypatch.setattr(graph, "_contract", lambda keys: (lambda it: it))
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(n)}, 100: 100, 101: 100, 150: 100}


@pytest.fixture(scope="module")
def pixels(spark):
    rng = np.random.default_rng(11)
    m = rng.random((NC, NT)) < 0.06
    m[5:9, 3:9] = True
    rows = [(0, 0, int(c), int(t), 1.0 + int(c)) for c, t in zip(*np.nonzero(m))]
    return rows, spark.createDataFrame(rows, PIXELS)


def brute_dbscan(pts, eps=5, k=5):
    p = np.array(pts)
    near = ((p[:, None] - p[None]) ** 2).sum(-1) <= eps * eps
    core = near.sum(1) >= k
    idx = np.flatnonzero(core)
    lab = union_find(len(p), [(a, b) for a in idx for b in idx if a < b and near[a, b]])
    out = {}
    for i in range(len(p)):
        if core[i]:
            out[tuple(p[i])] = p[lab[i]] @ [NT, 1]
        elif (near[i] & core).any():
            out[tuple(p[i])] = min(p[lab[j]] @ [NT, 1] for j in np.flatnonzero(near[i] & core))
    return out


@pytest.mark.parametrize("tile", [8, 16, 256])
def test_dbscan_matches_brute_force(pixels, tile):
    rows, df = pixels
    want = brute_dbscan([r[2:4] for r in rows])
    got = {(r.channel_sample, r.time_idx): r.cluster_id for r in db.dbscan(df, NC, NT, tile=tile).collect()}
    assert got == want


def test_neighbour_pairs(pixels, spark):
    from pyspark.sql import functions as F
    rows, df = pixels
    p = np.array([r[2:4] for r in rows])
    want = {(int(p[i] @ [NT, 1]), int(p[j] @ [NT, 1])) for i in range(len(p)) for j in range(i + 1, len(p)) if ((p[i] - p[j]) ** 2).sum() <= 9}
    d = df.withColumn("ident", F.col("channel_sample") * NT + F.col("time_idx"))
    got = graph.neighbour_pairs(d, ["iter"], ["channel_sample", "time_idx"], 3, "ident").collect()
    assert {(r.a_ident, r.b_ident) for r in got} == want and len(got) == len(want)


def test_partition_rounds_equal_local_splits(pixels):
    _, df = pixels
    a = {(r.channel_sample, r.time_idx): (r.leaf, r.x1, r.x2, r.y1, r.y2) for r in pt.kd_partition(df, NC, NT, 10).collect()}
    b = {(r.channel_sample, r.time_idx): (r.leaf, r.x1, r.x2, r.y1, r.y2) for r in pt.kd_partition(df, NC, NT, 10, task_points=25).collect()}
    assert a == b
    sizes = {}
    for leaf, *_ in a.values():
        sizes[leaf] = sizes.get(leaf, 0) + 1
    assert max(sizes.values()) <= 10


def test_link_rule_equals_direct_form():
    """Lattice steps against the direct pair test (difference quotient with small offset)."""
    steps = set(st.link_offsets())
    for dc in range(-6, 7):
        for dt in range(0, 7):
            if (dc, dt) == (0, 0):
                continue
            first = (0, 0) if dc > 0 or (dc == 0 and dt > 0) else (dc, dt)
            d = np.array([first[0] - (dc if first == (0, 0) else 0), first[1] - (dt if first == (0, 0) else 0)], float)
            if (d[0] == 0 and abs(d[1]) > 1) or (d[1] == 0 and abs(d[0]) > 1):
                linked = False
            else:
                e = d + 1e-6
                linked = st.MIN_SLOPE <= e[0] / e[1] <= 0 and np.hypot(*e) <= 4
            assert linked == ((dc, dt) in steps), (dc, dt)


def streak_image(seed, slope=-0.45, noise=0.01, nc=128, nt=160):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((nc, nt)) < noise, rng.uniform(1, 5, (nc, nt)), 0.0)
    truth = set()
    for t in range(nt):
        c = int(round(110 + slope * t))
        if 0 <= c < nc:
            m[c, t] = 40.0
            truth.add((c, t))
    return m, truth


def test_injected_streak_is_found(spark):
    rows, truths = [], {}
    for beam in range(3):
        m, truths[beam] = streak_image(beam)
        rows += [(2, beam, int(c), int(t), float(m[c, t])) for c, t in zip(*np.nonzero(m))]
    df = spark.createDataFrame(rows, PIXELS)
    level = spark.createDataFrame([(2, b, 1.0) for b in range(3)], "iter bigint, beam_id int, beam_noise double")
    got = st.detect_streaks(df, level, 128, 160).collect()
    for beam, truth in truths.items():
        found = {(r.channel_sample, r.time_idx) for r in got if r.beam_id == beam}
        assert len(found & truth) / len(truth) > 0.8
        assert len(found - truth) <= 0.1 * len(found)


def test_robust_lines_ignore_outliers_and_order(spark):
    rng = np.random.default_rng(9)
    pts = {(100 - t // 2, t) for t in range(80)} | {(int(rng.integers(0, 128)), int(rng.integers(0, 160))) for _ in range(20)}
    rows = [(0, 0, 1, c, t, 1.0) for c, t in pts]
    df = spark.createDataFrame(rows, "iter bigint, beam_id int, group_id bigint, channel_sample int, time_idx int, power double")
    a = cut(st.robust_lines(df, ["iter", "beam_id", "group_id"]))
    b = st.robust_lines(df.repartition(5), ["iter", "beam_id", "group_id"])
    inl = {(r.channel_sample, r.time_idx) for r in a.where("inlier").collect()}
    assert len(inl & {(100 - t // 2, t) for t in range(80)}) >= 76
    assert inl == {(r.channel_sample, r.time_idx) for r in b.where("inlier").collect()}


def test_partition_of_equal_pixels_ends(spark):
    """More pixels in one place than a leaf or a task may hold."""
    rows = [(0, 0, 5, 7, 1.0)] * 300 + [(0, 0, c, c, 1.0) for c in range(20)]
    df = spark.createDataFrame(rows, PIXELS)
    for limit in (20_000, 50):
        got = pt.kd_partition(df, 128, 160, task_points=limit).groupBy("leaf").count().collect()
        assert sum(r["count"] for r in got) == 320 and max(r["count"] for r in got) >= 300


def test_groups_without_a_line_stay(spark):
    df = spark.createDataFrame([(0, 0, 1, 5, t, 1.0) for t in range(4)] + [(0, 0, 2, 100_000 + t, 70_000 + t, 1.0) for t in range(5)],
                               "iter bigint, beam_id int, group_id bigint, channel_sample int, time_idx int, power double")
    got = st.robust_lines(df, ["iter", "beam_id", "group_id"]).collect()
    assert len(got) == 9 and all(r.inlier == (r.group_id == 2) for r in got)

import numpy as np
import pytest

from skysieve.operators import evaluate as ev, image, noise as nz, thresholds as th

NC, NT = 40, 24


@pytest.fixture(scope="module")
def picture(spark):
    rng = np.random.default_rng(3)
    m = np.where(rng.random((NC, NT)) < 0.25, np.floor(rng.exponential(40, (NC, NT)) * 8) / 8, 0)
    rows = [(0, 0, int(c), int(t), float(m[c, t])) for c in range(NC) for t in range(NT) if m[c, t] > 0]
    return m, spark.createDataFrame(rows, "iter bigint, beam_id int, channel_sample int, time_idx int, power double")


def cells(df):
    return {(r.channel_sample, r.time_idx) for r in df.collect()}


@pytest.mark.parametrize("radius", [1, 2])
def test_isolated(picture, radius, monkeypatch):
    m, df = picture
    keep = set()
    for c, t in zip(*np.nonzero(m)):
        box = m[max(0, c - radius): c + radius + 1, max(0, t - radius): t + radius + 1]
        if (box != 0).sum() > 1:
            keep.add((int(c), int(t)))
    assert cells(image.remove_isolated(df, NC, NT, radius)) == keep


def test_opening(picture):
    m, df = picture
    keep = set()
    for c in range(NC - 1):
        for t in range(NT - 1):
            if (m[c: c + 2, t: t + 2] != 0).all():
                keep |= {(c, t), (c + 1, t), (c, t + 1), (c + 1, t + 1)}
    assert cells(image.opening(df, NC, NT)) == keep


@pytest.mark.parametrize("tile", [8, 64])
def test_median_filter(picture, tile):
    m, df = picture
    size, half = 6, 3
    p = np.pad(m, half, mode="symmetric")
    for r in image.median_filter(df, NC, NT, size, tile=tile).collect():
        box = p[r.channel_sample: r.channel_sample + size, r.time_idx: r.time_idx + size]
        assert r.filtered == np.sort(box.ravel())[size * size // 2]


@pytest.mark.parametrize("tile", [16, 64])
def test_adaptive_threshold(picture, tile, monkeypatch):
    m, df = picture
    sigma, radius = 10 / 6, int(4 * 10 / 6 + 0.5)
    k = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    k /= k.sum()
    p = np.pad(m, radius, mode="symmetric")
    orig = image.over_tiles
    monkeypatch.setattr(image, "over_tiles", lambda *a, **kw: orig(*a, **{**kw, "tile": tile}))
    for r in image.adaptive_threshold(df, NC, NT, 11).collect():
        box = p[r.channel_sample: r.channel_sample + 2 * radius + 1, r.time_idx: r.time_idx + 2 * radius + 1]
        assert np.isclose(r.threshold, k @ box @ k)


def test_cfar(picture):
    m, df = picture
    alpha = 10 * (1e-3 ** -0.1 - 1)
    want = set()
    for t in range(NT):
        x = m[:, t]
        for i in range(6, NC - 6):
            w = x[i - 6: i + 7]
            if np.argmax(w) == 6 and x[i] > alpha * (w.sum() - x[i - 1: i + 2].sum()) / 10 and x[i] > 0:
                want.add((i, t))
    assert cells(image.cfar_peaks(df, NC, NT)) == want


def smoothed_valley(h):
    """Lowest bin between the two tops left by repeated 3-bin means, tops found as ends of rising runs."""
    x, smooth = np.asarray(h, float), np.ones(3) / 3
    while True:
        x = np.convolve(np.pad(x, 1, mode="edge"), smooth, mode="valid")
        moves = [(i, s) for i, s in enumerate(np.sign(np.diff(x))) if s]
        tops = [i for (i, s), (_, before) in zip(moves, [(-1, 1.0), *moves]) if s < 0 < before]
        if len(tops) < 3:
            return tops[0] + int(x[tops[0]:tops[1] + 1].argmin()) if len(tops) == 2 else None


def test_minimum_threshold():
    rng = np.random.default_rng(2)
    for _ in range(5):
        h = np.histogram(np.concatenate([rng.normal(20, 5, 300), rng.normal(60, 6, 200)]), 64, (0, 80))[0]
        assert th._valleys(np.array([h], float))[0] == smoothed_valley(h)


def test_minimum_threshold_on_spark(spark):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(20, 4, 200), rng.normal(70, 4, 200)])
    df = spark.createDataFrame([(0, 0, float(x)) for x in v], "iter bigint, beam_id int, power double")
    h, edges = np.histogram(v, 64)
    row = th.minimum(df, 64).first()
    assert np.isclose(row.threshold, (edges[:-1] + edges[1:])[smoothed_valley(h)] / 2)


def test_flat_image_has_threshold_one(spark):
    df = spark.createDataFrame([(0, 0, 5.0), (0, 0, 5.0)], "iter bigint, beam_id int, power double")
    assert th.triangle(df).first().threshold == 1.0


def test_doppler_window_is_strict_and_renumbers(spark):
    df = spark.createDataFrame([(i,) for i in range(100)], "channel_sample int")
    out = nz.doppler_window(df, 410.0, 1e-5, 410.0, 200.0, 500.0).collect()
    assert [r.channel_sample for r in out] == list(range(len(out)))
    assert all(410.0002 < r.channel < 410.0005 for r in out)


def test_empty_prediction_scores_zero_precision(spark):
    t = spark.createDataFrame([(0, 1, 1)], "img int, channel_sample int, time_idx int")
    s = ev.scores(ev.confusion(t, t.limit(0), ["img"], 100), 100).first()
    assert (s.tp, s.fp, s.fn, s.tn, s.precision) == (0, 0, 1, 99, 0.0)


def test_images_without_a_threshold_keep_their_pixels(spark):
    df = spark.createDataFrame([(0, 0, 5.0)] * 4 + [(0, 1, float(x)) for x in range(50)], "iter bigint, beam_id int, power double")
    got = th.above(df, th.otsu(df)).groupBy("beam_id").count().collect()
    assert {r.beam_id: r["count"] for r in got}[0] == 4

"""Whitening against exact integers and numpy's own eigenvectors."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysieve.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        df = df.select("*", *[F.lit("x").alias(c) for c in ("x", "dim", "n", "component", "Whitening", "_at")])
    return df


def brute(rows, k=4):
    """Rows by vector and component, up to sign, and the trace; with exact sums."""
    usable = [(i, [math.floor(256 * float(c)) for c in map(np.float32, v)]) for i, v, *_ in rows
              if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(x) for _, x in usable]
    dim = max(set(sizes), key=lambda d: (sizes.count(d), d))
    usable = [(i, x) for i, x in usable if len(x) == dim]
    fit = sorted({tuple(x) for _, x in usable})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array([float(Fraction(s, n)) for s in sums])
    d = np.array(fit, float) - mean
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u.T[::-1][:k]
    out = []
    for i, x in usable:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        for c in range(min(k, dim)):
            out.append((i, c + 1, n, deviation, float((np.array(x) - mean) @ u[c] / math.sqrt(e[c])), e[c] / np.trace(v)))
    return out


def compare(got, want):
    got = sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in got)
    assert len(got) == len(want)
    sign = {}
    for a, b in zip(got, sorted(want)):
        assert a[:4] == b[:4]
        if abs(b[4]) > 0.01:
            assert sign.setdefault(a[1], np.sign(a[4] * b[4])) == np.sign(a[4] * b[4])
        assert abs(abs(a[4]) - abs(b[4])) < 1e-8 and abs(a[5] / b[5] - 1) < 1e-10


def test_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(0.2, 2, 12)
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(base)]
    rows += [(1000 + i, rows[5][1], 0) for i in range(400)]  # one very common vector counts once
    rows += [(2000, None, 0), (2001, [], 0), (2002, [float("nan")] * 12, 0), (2003, [1.0] * 11 + [None], 0),
             (2004, [float("inf")] + [0.0] * 11, 0), (2005, [1.0] * 5, 0), (5, rows[5][1], 0), (2006, [-0.0] * 12, 0)]
    got = wh.digest(frame(spark, rows, True).repartition(7)).collect()
    compare(got, brute(rows))
    errors = {r.identity_error for r in got}
    assert len(errors) == 1 and errors.pop() < 1e-10
    assert not {r.vec_id for r in got} & {2000, 2001, 2002, 2003, 2004, 2005}


def test_given_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    compare(wh.digest(df).collect(), brute([(r.vec_id, r.embedding) for r in df.collect()]))


def test_rows_and_columns_stay(spark):
    rows = [(i, [float(i % 3), float(i % 5)], i) for i in range(30)] + [(None, [0.5, 0.5], None), (31, None, 1)]
    df = frame(spark, rows, True)
    fit, dim = wh.fit_list(df)
    out = wh.whiten(df, wh.fit_components(fit, dim, 4))
    assert dim == 2 and out.count() == 32 and out.columns == [c for c in df.columns if c != "Whitening"] + ["whitening"]
    assert [len(r.whitening.whitened) for r in out.where("vec_id = 3").collect()] == [2]
    assert out.where("whitening IS NULL").count() == 1


def test_little_or_no_variance(spark):
    assert wh.digest(frame(spark, [])).count() == 0
    assert wh.digest(frame(spark, [(1, None, 0)])).count() == 0
    one = wh.digest(frame(spark, [(1, [1.0, 2.0, 3.0], 0), (2, [1.0, 2.0, 3.0], 0)])).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one} == {(1, 0, None, None, None)}
    flat = wh.digest(frame(spark, [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(9)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1}
    assert all(abs(r.explained - 1) < 1e-12 for r in flat if r.component == 1) and flat[0].identity_error < 1e-12


def test_huge_entries(spark):
    rows = [(0, [3e38, 0.0], 0), (1, [-3e38, 1.0], 0), (2, [0.0, 2.0], 0)]
    got = wh.digest(frame(spark, rows)).collect()
    assert len(got) == 6 and all(r.deviation is None for r in got if r.vec_id < 2)
    big = [(i, [4_000.0 * i, -7_000.0 * i], 0) for i in range(50)]
    compare(wh.digest(frame(spark, big)).where("component = 1").collect(), brute(big, 1))


@pytest.mark.parametrize("n", [1, 2, 3, 7, 32, 65])
def test_spectral_division(n):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    half = rng.standard_normal((n, 2 * n))
    one = rng.standard_normal((n, 1))
    cases = [half @ half.T, np.diag(np.arange(n) // 2 * 1.0), 3 * np.eye(n), one @ one.T, np.zeros((n, n)),
             q @ np.diag(10.0 ** -np.arange(n)) @ q.T, q @ np.diag(np.where(np.arange(n) % 2, 5.0, -5.0)) @ q.T]
    for a in cases:
        a = (a + a.T) / 2
        for k in {1, min(4, n), n}:
            values, rows = wh.spectrum(a, k)
            size = max(1.0, np.abs(a).max()) * n
            assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:k], atol=1e-13 * size, rtol=0)
            assert np.abs(rows @ rows.T - np.eye(k)).max() < 1e-12 and np.abs(a @ rows.T - rows.T * values).max() < 1e-12 * size


def test_polar_factor():
    rng = np.random.default_rng(3)
    for spread in (1, 6, 12):
        q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
        e = np.where(rng.random(20) < 0.5, -1, 1) * 10.0 ** -rng.uniform(0, spread, 20)
        u = wh.polar(q @ np.diag(e) @ q.T)
        assert np.abs(u - q @ np.diag(np.sign(e)) @ q.T).max() < 1e-14 * 10 ** spread * 100


def test_packing_round_trip():
    rng = np.random.default_rng(4)
    rows = [rng.integers(-2 ** b, 2 ** b, 6, endpoint=True) for b in (3, 14, 15, 16, 31, 32, 62) for _ in range(20)]
    rows += [np.array([-(1 << 63), (1 << 63) - 1, 0, 0, 0, 0])]
    assert (wh.unpacked([wh.packed(r) for r in rows], 6) == np.array(rows)).all()

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skysieve.operators import sequences as sq


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows, t = [], 0
    for key, n in (("hot", 400), ("cold", 7)):  # one key holds nearly everything
        t = 0
        for i in range(n):
            t += int(rng.integers(1, 9))
            rows.append((key, t, float(rng.integers(0, 100))))
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    return pdf, spark.createDataFrame(pdf).withColumn("b", F.floor(F.col("t") / 50)).repartition(7)


def as_dict(df, col):
    return {(r.k, r.t): r[col] for r in df.collect()}


def expected(pdf, fn):
    out = {}
    for k, g in pdf.sort_values("t").groupby("k"):
        for t, x in zip(g.t, fn(g.v)):
            out[k, t] = x
    return out


def test_row_index(table):
    pdf, df = table
    got = as_dict(sq.row_index(df, ["k"], ["t"], "b"), "row_index")
    assert got == expected(pdf, lambda v: range(1, len(v) + 1))


@pytest.mark.parametrize("how,ref", [(F.sum, "cumsum"), (F.max, "cummax"), (F.min, "cummin")])
def test_running(table, how, ref):
    pdf, df = table
    got = as_dict(sq.running(df, ["k"], ["t"], "b", F.col("v"), "r", how), "r")
    assert got == expected(pdf, lambda v: getattr(v, ref)())


def test_previous(table):
    pdf, df = table
    got = as_dict(sq.previous(df, ["k"], ["t"], "b", {"p": "v"}), "p")
    assert got == expected(pdf, lambda v: [None, *v.tolist()[:-1]])


@pytest.mark.parametrize("chunk", [10, 64, 4096])
def test_rolling_median_crosses_chunks(table, chunk):
    pdf, df = table
    got = as_dict(sq.rolling(df, ["k"], ["t"], "b", 10, {"m": F.percentile("v", F.lit(0.5))}, chunk), "m")
    assert got == expected(pdf, lambda v: v.rolling(10, min_periods=1).median())


def test_small_only_hints_checked_sizes(spark):
    assert "broadcast" in sq.small(spark.range(10), 10)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in sq.small(spark.range(11), 10)._jdf.queryExecution().analyzed().toString().lower()

"""Every registered query against its SQL twin on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import rows  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# whole flows that leave no cluster of the few pixels in the smallest tables
NOTHING_TO_FIND = {"e4_dbscan_detection", "e4_streak_detection"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["beam_id", "chunk", "power", "power_db", "noise_db"]


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows(df.columns, got) == rows(cols, cur.fetchall())
    else:
        assert got or name in NOTHING_TO_FIND

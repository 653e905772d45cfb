"""Registration of queries and the derived views they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_TWINS: dict[str, tuple[str, list[str]]] = {}

# Views over the given tables; every statement runs unchanged in Spark SQL and in DuckDB.
VIEWS = {
    "fx_voltages": """
        SELECT CAST(l_suppkey % 8 AS INT) AS ant, CAST(l_partkey AS BIGINT) AS sample,
               CAST(SUM(l_quantity - 25.5) AS DOUBLE) AS re,
               CAST(SUM(l_discount * 100 - 5) AS DOUBLE) AS im
        FROM lineitem GROUP BY 1, 2""",
    "fx_weights": """
        SELECT CAST(c_nationkey % 5 AS INT) AS beam_id, CAST(c_custkey % 8 AS INT) AS ant,
               COS(0.1e0 * SUM(c_nationkey)) AS re, -SIN(0.1e0 * SUM(c_nationkey)) AS im
        FROM customer GROUP BY 1, 2""",
    "fx_pixels": """
        SELECT CAST(FLOOR(l_orderkey / 2000) AS BIGINT) AS iter, CAST(l_suppkey % 8 AS INT) AS beam_id,
               CAST(l_partkey % 64 AS INT) AS channel_sample, CAST(l_orderkey % 160 AS INT) AS time_idx,
               MAX(FLOOR(8 * l_extendedprice / l_quantity) / 8) AS power
        FROM lineitem GROUP BY 1, 2, 3, 4""",
    "fx_detections": """
        SELECT CAST(user_id AS BIGINT) AS track_id, CAST(event_id % 32 AS INT) AS beam_id,
               CAST(EXTRACT(DAY FROM ts) * 24 + EXTRACT(HOUR FROM ts) AS BIGINT) AS time_sample,
               CAST(FLOOR(600 - (EXTRACT(DAY FROM ts) * 24 + EXTRACT(HOUR FROM ts)) / 2)
                    + event_id % 3 AS DOUBLE) AS channel_sample,
               ts AS time, value AS snr, event_id
        FROM events""",
    "fx_blocks": """
        SELECT CAST(o_orderkey AS BIGINT) AS obs_id, o_orderdate AS start_ts,
               o_orderstatus AS status, CAST(o_custkey AS BIGINT) AS station
        FROM orders""",
}
# views each view itself reads
_SOURCES = {
    "fx_voltages": ["lineitem"], "fx_weights": ["customer"], "fx_pixels": ["lineitem"],
    "fx_detections": ["events"], "fx_blocks": ["orders"],
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def add_view(name: str, sql: str, sources: list[str]) -> None:
    """A further derived view; ``sources`` are tables or earlier views."""
    VIEWS[name] = sql
    _SOURCES[name] = sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view derived from the given tables."""
    if name in VIEWS:
        parts = {s: table(spark, sf_dir, s) for s in _SOURCES[name]}
        # qualified names stay valid: each source is passed as a named parameter
        sql = VIEWS[name]
        for s in sorted(parts, key=len, reverse=True):
            for word in ("FROM", "JOIN"):
                sql = sql.replace(f"{word} {s}", f"{word} {{{s}}}")
        return spark.sql(sql, **parts)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        if n in VIEWS and n not in out:
            for s in _SOURCES[n]:
                visit(s)
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle(body: str, views: list[str]) -> str:
    """SQL text with the used views as common table expressions."""
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in _closure(views)]
    body = body.strip()
    plain_with = body.upper().startswith("WITH RECURSIVE")
    used = _closure(views)
    recursive = "RECURSIVE " if plain_with or any("RECURSIVE" in VIEWS[n] for n in used) else ""
    if body.upper().startswith("WITH"):
        body = body[len("WITH RECURSIVE") if plain_with else len("WITH"):]
        return f"WITH {recursive}{', '.join(ctes + [body.strip()])}" if ctes else f"WITH {recursive}{body}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def oracles() -> dict[str, str]:
    """SQL twin of every query that has one, built once all views are known."""
    return {name: oracle(sql, views) for name, (sql, views) in _TWINS.items()}


def query(name: str, views: str = "", sql: str | None = None, sql_views: str = ""):
    """Register ``fn(*views as DataFrames)``; ``views`` lists tables and views by name.

    ``sql_views`` are needed by the SQL twin only.
    """
    names = views.split()

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(*[table(spark, sf_dir, n) for n in names])

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            _TWINS[name] = (sql, names + sql_views.split())
        return fn

    return wrap

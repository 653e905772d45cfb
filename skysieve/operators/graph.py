"""Connected components and neighbour joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.session import cut


def connected_components(edges: DataFrame, keys: Sequence[str] = (), max_rounds: int = 60) -> DataFrame:
    """Smallest node of the component for every node that has an edge.

    ``edges(keys, src, dst)`` -> ``(keys, node, component)``.  Alternating star contraction:
    every node passes the smallest neighbour on, first to its larger neighbours, then to its
    smaller ones, until each component is a star.  Minima combine map-side, so a node with
    very many edges costs no more than its share; each round ends in a written table.
    """
    keys = list(keys)
    e = cut(edges.select(*keys, F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where(
        "u <> v").distinct())
    # neighbours in the ordering meet in one task: most of a graph collapses before any round
    e = cut(e.repartitionByRange(*keys, "v", "u").mapInPandas(_contract(keys), e.schema).distinct())
    for _ in range(max_rounds):
        if _is_star_forest(e, keys):
            break
        e = cut(_small_star(_large_star(e, keys), keys))
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(*keys, F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(*keys, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _contract(keys: list[str], buffer_rows: int = 100_000):
    """Replace the edges of a slice by stars around its smallest nodes; connectivity stays."""

    def stars(parts: list[pd.DataFrame]) -> pd.DataFrame:
        e = pd.concat(parts, ignore_index=True)
        ends = pd.concat([e[keys + [c]].rename(columns={c: "node"}) for c in "uv"], ignore_index=True)
        ids = ends.groupby(keys + ["node"], sort=False).ngroup().to_numpy()
        nodes = ends.assign(_i=ids).drop_duplicates("_i").sort_values("_i")
        label = local_components(len(nodes), ids[: len(e)], ids[len(e):])
        low = nodes["node"].groupby(label).transform("min")
        out = nodes[keys].assign(u=nodes["node"], v=low)
        return out[out["u"] != out["v"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows = [], 0
        for b in batches:
            parts.append(b)
            rows += len(b)
            if rows >= buffer_rows:
                yield stars(parts)
                parts, rows = [], 0
        if rows:
            yield stars(parts)

    return run


def _is_star_forest(e: DataFrame, keys: list[str]) -> bool:
    """Every node points at one root and no root points anywhere."""
    ends = e.select(*keys, F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        e.select(*keys, F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    bad = ends.groupBy(*keys, "node").agg(F.sum("out").alias("o"), F.max("in").alias("i")).where(
        "o > 1 OR (o = 1 AND i = 1)")
    return bad.isEmpty()


def _large_star(e: DataFrame, keys: list[str]) -> DataFrame:
    both = e.unionByName(e.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that both sides of the join are plain shuffles and the rows of a hub can be split
    low = cut(both.groupBy(*keys, "u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
    return both.join(low, keys + ["u"]).where("v > u").select(
        *keys, F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame, keys: list[str]) -> DataFrame:
    low = cut(e.groupBy(*keys, "u").agg(F.min("v").alias("m")))
    moved = e.join(low, keys + ["u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select(*keys, "u", F.col("m").alias("v"))
    return moved.unionByName(own).where("u <> v").distinct()


def label_nodes(nodes: DataFrame, edges: DataFrame, node: str, keys: Sequence[str] = ()) -> DataFrame:
    """Component of every node; nodes without an edge are their own component."""
    keys = list(keys)
    comp = connected_components(edges, keys).withColumnRenamed("node", node)
    return nodes.join(comp, keys + [node], "left").withColumn("component", F.coalesce("component", node))


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest member index of each node's component, for one small graph."""
    label = np.arange(n)
    while len(u):
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def neighbour_pairs(points: DataFrame, keys: Sequence[str], coords: Sequence[str], eps, ident: str,
                    carry: Sequence[str] = ()) -> DataFrame:
    """Pairs of points at most ``eps`` apart, each pair once (lower ``ident`` first).

    Points fall into cells of width ``eps`` (a number or a column); one side is listed in its
    own and all adjacent cells, so the distance join is an equality join on the cell.
    """
    keys, coords = list(keys), list(coords)
    e = eps if isinstance(eps, Column) else F.lit(float(eps))
    cells = points.withColumn("_eps", e)
    for i, c in enumerate(coords):
        cells = cells.withColumn(f"_g{i}", F.floor(F.col(c) / F.col("_eps")))
    grid = [f"_g{i}" for i in range(len(coords))]
    cols = [ident, *coords, *carry]
    right = cells.select(*keys, *grid, *[F.col(c).alias("b_" + c) for c in cols])
    left = cells.select(*keys, *grid, "_eps", *[F.col(c).alias("a_" + c) for c in cols])
    for g in grid:
        left = left.withColumn(g, F.explode(F.array(F.col(g) - 1, F.col(g), F.col(g) + 1)))
    d2 = sum((F.col("a_" + c) - F.col("b_" + c)) * (F.col("a_" + c) - F.col("b_" + c)) for c in coords)
    return (
        left.join(right, keys + grid)
        .where((F.col("a_" + ident) < F.col("b_" + ident)) & (d2 <= F.col("_eps") * F.col("_eps")))
        .withColumn("distance", F.sqrt(d2)).drop(*grid, "_eps")
    )

"""Embedding whitening: principal components by spectral divide and conquer, then a broadcast projection.

Entries become whole numbers ``floor(256 * c)``.  Mean and covariance are taken over the distinct
vectors, distributed; the covariance is split on the driver, where it has the square of the
dimension.  The polar factor of the shifted covariance is the matrix sign of it; half of its sum with
the identity projects on the components above the shift, so each half is an invariant subspace and
is split again until single components are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.text import boxed, field, unboxed
from skysieve.session import cut

MAX_DIM = 4096  # the covariance of more dimensions is not brought to the driver
SCALE = 256
_LEAST, _MOST = float(-(1 << 63)), float((1 << 63) - 1024)  # whole doubles that a long can hold
_KINDS = {2: "<i2", 4: "<i4", 8: "<i8"}


def whole_numbers(vectors: pa.Array) -> Iterator[np.ndarray | None]:
    """``floor(256 * c)`` of each vector as 64-bit integers (the nearest one, beyond their range).

    None for a null or empty vector and for null, infinite or undefined entries.
    """
    vectors = vectors.cast(pa.list_(pa.float64()))
    values = vectors.values.to_numpy(zero_copy_only=False)  # null entries become nan
    bounds, null = vectors.offsets.to_numpy(), vectors.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.clip(np.floor(values * float(SCALE)), _LEAST, _MOST)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    x = np.where(np.isfinite(values), scaled, 0.0).astype(np.int64)
    for i in range(len(vectors)):
        lo, hi = bounds[i], bounds[i + 1]
        yield None if null[i] or lo == hi or bad[hi] > bad[lo] else x[lo:hi]


def packed(x: np.ndarray) -> bytes:
    """A vector of integers in the fewest bytes an entry, so that equal vectors are equal bytes."""
    low, high = int(x.min()), int(x.max())
    width = next(w for w in _KINDS if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + x.astype(_KINDS[width]).tobytes()


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    out = np.empty((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i] = np.frombuffer(r, _KINDS[r[0]], offset=1)
    return out


@dataclass(frozen=True)
class Components:
    """Size and exact sums of the fit list, its first unit eigenvectors (rows) with their variances, and the trace."""

    dim: int
    n: int
    sums: tuple[int, ...]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return _mean(self.n, self.sums)

    def rows(self) -> np.ndarray:
        """Projection rows over the root of the variance; nan where there is no variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.vectors / np.sqrt(np.where(self.values > 0, self.values, np.nan))[:, None]


def _mean(n: int, sums: tuple[int, ...]) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


# --- spectral divide and conquer -------------------------------------------------------------
def polar(a: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by dynamically weighted Halley steps in QR form."""
    n = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # the Frobenius norm is at least the largest singular value
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, 1e-17), 1.0)
    for _ in range(rounds):
        q = low * low
        d = (4 * (1 - q) / (q * q)) ** (1 / 3)
        ha = np.sqrt(1 + d) + np.sqrt(8 - 4 * d + 8 * (2 - q) / (q * np.sqrt(1 + d))) / 2
        hb = (ha - 1) ** 2 / 4
        hc = ha + hb - 1
        both = np.linalg.qr(np.concatenate([np.sqrt(hc) * x, np.eye(n)]))[0]
        new = hb / hc * x + (ha - hb / hc) / np.sqrt(hc) * both[:n] @ both[n:].T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(low * (ha + hb * q) / (1 + hc * q), 1.0)
        if 1 - low < 1e-15 and moved < 1e-8 * np.sqrt(n):
            break
    return x


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift; None if no shift separates any.

    The median of the diagonal halves most spectra; its mean lies strictly inside every spectrum
    that has two values.  A shift that meets an eigenvalue leaves no projector and is moved.
    """
    n, diagonal = len(a), np.diag(a)
    spread = np.linalg.norm(a - diagonal.mean() * np.eye(n)) / np.sqrt(n)
    rng = np.random.default_rng(n)
    for shift in (np.median(diagonal), diagonal.mean(), *(diagonal.mean() + spread * t for t in (
            1e-3, -1e-3, 1e-2, -1e-2, 0.05, -0.05, 0.1, -0.1, 0.2, -0.2))):
        moved = a - shift * np.eye(n)
        if not np.linalg.norm(moved):
            continue
        p = (polar(moved) + np.eye(n)) / 2
        k = round(np.trace(p))
        if not 0 < k < n or np.linalg.norm(p @ p - p) > 1e-9 * n:
            continue
        basis = np.linalg.qr(p @ rng.standard_normal((n, k)))[0]
        basis = np.linalg.qr(p @ basis, mode="complete")[0]
        upper, lower = basis[:, :k], basis[:, k:]
        if np.linalg.norm(lower.T @ a @ upper) <= 1e-10 * max(np.linalg.norm(a), 1e-300):
            return upper, lower
    return None


def spectrum(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows.

    Only subspaces that can hold one of them are split.  Of equal eigenvalues, up to rounding,
    any orthonormal basis of their space is taken.
    """
    floor = 4 * np.finfo(float).eps * np.linalg.norm(a)
    values, vectors, found = [], [], 0
    open_parts = [(a, np.eye(len(a)))]  # the part with the largest values last
    while open_parts and found < k:
        part, basis = open_parts.pop()
        n = len(part)
        split = None
        if n > 1 and np.linalg.norm(part - np.trace(part) / n * np.eye(n)) > floor:
            split = halves(part)
        if split is None:
            values += [*np.diag(part)]
            vectors += [*basis.T]
            found += n
            continue
        for q in reversed(split):
            inner = q.T @ part @ q
            open_parts.append(((inner + inner.T) / 2, basis @ q))
    order = np.argsort(-np.array(values), kind="stable")[:k]
    rows = np.array(vectors).reshape(-1, len(a))[order]
    rows = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return np.einsum("ij,jk,ik->i", rows, a, rows), rows


# --- fit list --------------------------------------------------------------------------------
def fit_list(vectors: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """Each distinct vector of whole numbers once, as packed bytes ``x``, and their dimension.

    The dimension is the most frequent one among usable vectors, the larger of equally frequent ones.
    """
    @F.arrow_udf("binary")
    def coded(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else packed(x) for x in whole_numbers(v)], pa.binary())

    rows = vectors.select(F.size(vector).alias("dim"), coded(F.col(f"`{vector}`").cast("array<double>")).alias("x")).where(
        "x IS NOT NULL")
    distinct = cut(rows.groupBy("dim", "x").agg(F.count("*").alias("rows")), "fit-list")
    most = distinct.groupBy("dim").agg(F.sum("rows").alias("rows")).orderBy(F.desc("rows"), F.desc("dim")).first()
    dim = 0 if most is None else most["dim"]
    return distinct.where(F.col("dim") == dim).select("x"), dim


def exact_sums(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Number of vectors and the sum of each dimension, exact."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dim
        for batch in batches:
            x = unpacked(batch.column(0).to_pylist(), dim)
            safe = len(x) * float(np.abs(x.astype(float)).max(initial=0)) < 2.0 ** 62
            add = x.sum(0).tolist() if safe else x.astype(object).sum(0).tolist()
            n, sums = n + len(x), [s + t for s, t in zip(sums, add)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()),
                                              pa.array(map(str, sums), pa.string())], ["at", "n", "s"])

    rows = fit.mapInArrow(run, "at int, n long, s string").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {r["at"]: int(r["s"]) for r in rows}
    return (rows[0]["n"] if rows else 0), tuple(sums.get(i, 0) for i in range(dim))


def _summed(df: DataFrame, run, size: int) -> np.ndarray:
    """Sum of one array of ``size`` doubles per task: within partitions, then over about the root of their number."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for b in batch.column(0).to_pylist():
                total = np.frombuffer(b) + (0 if total is None else total)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = cut(df.mapInArrow(run, "m binary"), "partial-sums")
    total = np.zeros(size)
    for r in parts.repartition(max(1, int(parts.count() ** 0.5))).mapInArrow(add, "m binary").toLocalIterator():
        total += np.frombuffer(r["m"])
    return total


def covariance(fit: DataFrame, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """Covariance of the fit list, divisor n: differences from the mean are multiplied."""
    dim, mean = len(sums), _mean(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            d = unpacked(batch.column(0).to_pylist(), dim) - mean
            total += d.T @ d
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    v = _summed(fit, run, dim * dim).reshape(dim, dim) / n
    return (v + v.T) / 2


def fit_components(fit: DataFrame, dim: int, k: int = 4) -> Components | None:
    """The first ``k`` components of a fit list (all, if it has fewer dimensions); None if it is empty."""
    if not dim:
        return None
    if dim > MAX_DIM:
        raise ValueError(f"{dim} dimensions; the covariance of more than {MAX_DIM} is too large for the driver")
    n, sums = exact_sums(fit, dim)
    v = covariance(fit, n, sums)
    values, vectors = spectrum(v, min(k, dim))
    least = 16 * np.finfo(float).eps * dim * max(float(values[0]), 0.0)
    return Components(dim, n, sums, vectors, np.where(values > least, values, 0.0), float(np.trace(v)))


def identity_error(fit: DataFrame, c: Components) -> float | None:
    """Largest entry of the whitened fit list's covariance minus the identity; None without any variance."""
    used = c.values > 0
    k = int(used.sum())
    if not k:
        return None
    rows, mean, dim = c.rows()[used], c.mean, c.dim

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += ((unpacked(batch.column(0).to_pylist(), dim) - mean) @ rows.T).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    centre = _summed(fit, first, k) / c.n

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = (unpacked(batch.column(0).to_pylist(), dim) - mean) @ rows.T - centre
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return float(np.abs(_summed(fit, second, k * k).reshape(k, k) / c.n - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exact; None beyond 64 bits."""
    most = n * float(np.abs(x.astype(float)).max(initial=0)) + max((abs(s) for s in sums), default=0)
    if most * most * x.shape[1] < 2.0 ** 62:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(1).tolist()
    out = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
    return [v if v < 1 << 63 else None for v in out]


def whiten(vectors: DataFrame, c: Components, vector: str = "embedding", name: str = "whitening") -> DataFrame:
    """``vectors`` with the struct ``whitening(deviation, whitened)``, null for vectors that the fit list has not.

    These are null and empty vectors, those with null or non-finite entries, and those of another
    dimension.  ``whitened`` is null for components without variance.  Rows and other columns are left
    alone; a column of the result's name is replaced.
    """
    sent = vectors.sparkSession.sparkContext.broadcast(c)  # components times at most MAX_DIM doubles

    @F.arrow_udf("deviation long, whitened array<double>")
    def projected(v: pa.Array) -> pa.Array:
        c = sent.value
        rows, mean = c.rows(), c.mean
        found = [(i, x) for i, x in enumerate(whole_numbers(v)) if x is not None and len(x) == c.dim]
        x = np.array([x for _, x in found], np.int64).reshape(-1, c.dim)
        white = (x - mean) @ rows.T
        out: list[dict | None] = [None] * len(v)
        for (i, _), d, w in zip(found, deviations(x, c.n, c.sums), white.tolist()):
            out[i] = {"deviation": d, "whitened": [None if y != y else y for y in w]}
        return pa.array(out, pa.struct([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]))

    return unboxed(boxed(vectors), vectors.columns, {name: projected(field(vector).cast("array<double>"))})


def digest(embeddings: DataFrame, k: int = 4) -> DataFrame:
    """A row for each usable vector and component; repeated rows and ids are rows of their own."""
    fit, dim = fit_list(embeddings)
    c = fit_components(fit, dim, k)
    schema = "component int, n long, explained double, identity_error double"
    spark = embeddings.sparkSession
    if c is None:
        return embeddings.select("vec_id").limit(0).select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"),
            *[F.lit(0.0).alias(x) for x in ("whitened", "explained", "identity_error")])
    error = identity_error(fit, c)
    shares = [(i + 1, c.n, float(v) / c.trace if c.trace > 0 else None, error) for i, v in enumerate(c.values)]
    rows = whiten(embeddings.select("vec_id", "embedding"), c).where("whitening IS NOT NULL").select(
        "vec_id", F.col("whitening.deviation").alias("deviation"), F.posexplode("whitening.whitened").alias("_at", "whitened"))
    return rows.withColumn("component", F.col("_at") + 1).join(F.broadcast(spark.createDataFrame(shares, schema)), "component").select(
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")

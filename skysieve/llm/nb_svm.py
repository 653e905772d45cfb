"""Text quality by naive Bayes support vectors.

A text is the set of its n-grams: which runs of one to four bytes it holds, and, without regard to
the words themselves, how often a word follows itself or an earlier one.  Each indicator is scaled
by its log-count ratio between the classes, rows are brought to unit length, and a linear
hinge-loss model is fitted to them by dual coordinate descent.  Margins become probabilities by a
logistic curve through rows the fit has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm.text import boxed, field, filtered_scans, unboxed, whole
from skysieve.session import cut

BITS = 18  # indicators are numbered by hashes of so many bits
LENGTHS = (1, 2, 3, 4)  # of byte n-grams
SAMPLE = 10_000  # labelled rows the model is fitted on, those with the smallest hashes of their ids
SAMPLE_IDS = 64_000_000  # indicators of these rows that the fitting task holds; later rows are left out
THRESHOLD = 0.7
_CHUNK = 1 << 20  # bytes of a text hashed together
_REPEATS = (0.01, 0.03, 0.06, 0.1, 0.2, 0.4, 0.7)  # shares of words equal to the one before
_AGAIN = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)  # shares of words that came before
_OWN = 96  # first numbers, not for hashes


@dataclass(frozen=True)
class Model:
    """Weights of the scaled indicators, squares of the scales, and the curve from margin to probability.

    Without labels of both classes there are no weights and every score is ``prior``.
    """

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    slope: float
    shift: float
    prior: float

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(texts), self.prior)
        margins = np.empty(len(texts))
        for i, ids in enumerate(indicators(texts)):
            margins[i] = self.weights[ids].sum() / np.sqrt(self.squares[ids].sum() or 1.0)
        return _logistic(self.slope * (margins + self.bias) + self.shift)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def indicators(texts: list[bytes | None]) -> Iterator[np.ndarray]:
    """Numbers of the n-grams each text holds, in order and without repeats; null counts as empty."""
    flags = np.zeros(1 << BITS, bool)
    room, lift = np.uint32((1 << BITS) - _OWN), np.uint32(_OWN)
    for text in texts:
        raw = text or b""
        for start in range(0, len(raw), _CHUNK):
            b = np.frombuffer(raw, np.uint8)[start:start + _CHUNK + max(LENGTHS) - 1].astype(np.uint32)
            rolled = np.zeros(len(b), np.uint32)
            for n in range(1, max(LENGTHS) + 1):
                if len(b) < n:
                    break
                rolled = rolled[: len(b) - n + 1] * np.uint32(0x01000193) ^ b[n - 1:]
                if n in LENGTHS:
                    h = (rolled ^ np.uint32(n)) * np.uint32(0x9E3779B1)
                    flags[(h >> np.uint32(7)) % room + lift] = True
        words = raw.split()
        same = sum(map(eq, words, words[1:])) / max(len(words) - 1, 1)
        again = 1 - len(set(words)) / max(len(words), 1)
        flags[[i for i, x in enumerate(_REPEATS) if same > x]] = True
        flags[[16 + i for i, x in enumerate(_AGAIN) if again > x]] = True
        flags[32 + min(len(words).bit_length(), 63)] = True
        ids = np.flatnonzero(flags)
        flags[ids] = False
        yield ids.astype(np.int32)


def known(labels: DataFrame, learnt: Column, label: str = "quality") -> DataFrame:
    """``(doc_id, label)`` of the ids to learn from: those whose labels are 0 or 1 and all alike."""
    held = labels.where(learnt & F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(
        F.min(label).alias("_min"), F.max(label).alias("_max"))
    return held.where("_min = _max").select("doc_id", F.col("_min").cast("int").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, learnt: Column | None = None, label: str = "quality", sample: int = SAMPLE,
        smoothing: float = 1.0, cost: float = 1.0, epochs: int = 20) -> Model:
    """A model of ``labels(doc_id, <label>)`` from ``docs(doc_id, text)``.

    ``learnt`` says by ``doc_id`` which labels may be used.  Log-count ratios are taken over all
    these labels, the hinge-loss model is fitted on ``sample`` of them at most.  Rows of a repeated
    id each count; ids with a null label, another value or labels that disagree teach nothing.
    """
    learnt = F.lit(True) if learnt is None else learnt
    told = cut(known(labels, learnt, label).withColumn("at", F.xxhash64("doc_id")), "labels").where("label >= 0")
    last = told.select("at").orderBy("at").limit(sample).agg(F.max("at")).first()[0]
    if last is None:
        return _flat(0, 0)
    with filtered_scans(docs.sparkSession):  # texts without a label are not shuffled
        rows = docs.where(learnt).select("doc_id", whole().cast("binary").alias("text")).join(told, "doc_id").select(
            "text", "label", F.when(F.col("at") <= last, F.col("at")).alias("at"))
        seen = cut(rows.mapInArrow(_seen, "at long, label int, ids binary, good binary, bad binary"), "indicators")
    counts = seen.where("at IS NULL").mapInArrow(_added, "id int, good long, bad long").groupBy("id").agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    good, bad = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for side, name in ((good, "good"), (bad, "bad")):
        side[counts["id"].to_numpy()] = counts[name].to_numpy()
    n = np.array([0, 0])
    for r in seen.where("at IS NOT NULL").groupBy("label").count().collect():
        n[r["label"]] = r["count"]
    if not n.all():
        return _flat(*n)
    scale = np.log((good + smoothing) / (good + smoothing).sum()) - np.log((bad + smoothing) / (bad + smoothing).sum())
    # the bounded sample goes to one task
    fitted = seen.where("at IS NOT NULL").select("at", "label", "ids").repartition(1).sortWithinPartitions(
        "at", "label", "ids").mapInArrow(_fitting(scale, cost, epochs), "weights binary, bias double, slope double, shift double").first()
    w = np.frombuffer(fitted["weights"])
    return Model(w * scale, scale * scale, fitted["bias"], fitted["slope"], fitted["shift"], float(n[1] / n.sum()))


def _flat(bad: int, good: int) -> Model:
    none = np.zeros(0)
    return Model(none, none, 0.0, 0.0, 0.0, (int(good) + 1) / (int(good) + int(bad) + 2))


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The indicators of the sample's rows; at the end in how many rows of each class each indicator is."""
    names = ["at", "label", "ids", "good", "bad"]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        out = []
        label, at = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for ids, y, a in zip(indicators(batch.column(0).to_pylist()), label, at):
            count[y, ids] += 1
            if a is not None:
                out.append((a, y, ids.tobytes(), None, None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)
    ids = np.flatnonzero(count.any(0)).astype(np.int32)
    if len(ids):
        row = (None, None, ids.tobytes(), count[1, ids].tobytes(), count[0, ids].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, kinds)], names)


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the counts in a partition."""
    count = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        for ids, good, bad in zip(*(batch.column(n).to_pylist() for n in ("ids", "good", "bad"))):
            at = np.frombuffer(ids, np.int32)
            count[1, at] += np.frombuffer(good, np.int64)
            count[0, at] += np.frombuffer(bad, np.int64)
    ids = np.flatnonzero(count.any(0))
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(count[1, ids]), pa.array(count[0, ids])],
                                         ["id", "good", "bad"])


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, cost: float, epochs: int,
            tolerance: float = 0.01, seed: int = 11) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights, bias and dual variables of the hinge-loss model, by dual coordinate descent.

    Rows have unit length; the bias is the weight of a further column of ones.  Ends after
    ``epochs``, or when no projected gradient of a pass exceeds ``tolerance``.
    """
    w, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    size = [1 / np.sqrt((scale[x] ** 2).sum() or 1.0) for x in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, s, a = rows[i], signs[i], alpha[i]
            v = scale[x] * size[i]
            slope = s * (w[x] @ v + bias) - 1
            steep = min(slope, 0.0) if a <= 0 else max(slope, 0.0) if a >= cost else slope
            if steep:
                worst = max(worst, abs(steep))
                alpha[i] = min(max(a - slope / 2, 0.0), cost)
                step = (alpha[i] - a) * s
                w[x] += step * v
                bias += step
        if worst <= tolerance:
            break
    return w, bias, alpha


def curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through margins, by Newton steps on smoothed targets."""
    n1 = labels.sum()
    n0 = len(labels) - n1
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))])
    at = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-6 * at @ at)

    now = loss(at)
    for _ in range(rounds):
        p = _logistic(at @ x)
        slope = x @ (p - target) + 2e-6 * at
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 2e-6 * np.eye(2), slope)
        share = 1.0
        while share > 1e-6 and loss(at - share * step) > now:
            share /= 2
        new = loss(at - share * step)
        if new >= now - 1e-10:
            break
        at, now = at - share * step, new
    return float(at[0]), float(at[1])


def _fitting(scale: np.ndarray, cost: float, epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, held = [], [], 0
        for batch in batches:
            for y, ids in zip(batch.column("label").to_pylist(), batch.column("ids").to_pylist()):
                held += len(ids) // 4
                if held <= SAMPLE_IDS or len(rows) < 10:
                    rows.append(np.frombuffer(ids, np.int32))
                    labels.append(y)
        y = np.array(labels)
        # each fifth row of a class only shapes the curve
        nth = np.where(y > 0, np.cumsum(y > 0), np.cumsum(y == 0))
        kept = nth % 5 == 0
        learnt = np.flatnonzero(~kept)
        w, bias, _ = descend([rows[i] for i in learnt], np.where(y[learnt] > 0, 1.0, -1.0), scale, cost, epochs)
        at = np.flatnonzero(kept) if len(set(y[kept])) == 2 else np.arange(len(y))
        margins = np.array([(w[rows[i]] * scale[rows[i]]).sum() / np.sqrt((scale[rows[i]] ** 2).sum() or 1.0) for i in at]) + bias
        slope, shift = curve(margins, y[at])
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), *(
            pa.array([float(x)]) for x in (bias, slope, shift))], ["weights", "bias", "slope", "shift"])

    return run


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 for each whole text; null counts as empty.

    Rows and other columns are left alone; a column of the result's name is replaced.  The model
    is sent to the executors once: two arrays of ``2 ** BITS`` numbers.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(sent.value.scores(texts.tolist()))

    return unboxed(boxed(docs), docs.columns, {name: scored(whole(field(text)).cast("binary"))})


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt; a null id has none."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: whether it was held out, its score and the prediction."""
    model = fit(docs, labels, ~held_out())
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

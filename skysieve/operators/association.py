"""First-match association: each cluster joins the first open track that it fits, in order.

The rule depends on order, but only among tracks that can take the same cluster.  Clusters that
could meet in one track form connected parts, found on Spark before anything is folded; a part
is folded by itself, on moments that merge by addition, and the result is that of one pass over
the whole observation.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skysieve.operators.graph import label_nodes, local_components
from skysieve.operators.sequences import row_index
from skysieve.operators.tracks import GRADIENT, best_detections, fits
from skysieve.session import cut, numbers, whole_groups

CLUSTER = ("iter", "beam_id", "cluster_id")
TRACK_SCHEMA = "track_no long, status string, n long, first_sample long, last_sample long, gradient double, r double"


@dataclass(frozen=True)
class Rules:
    """Units of a sample and a channel, and the limits of the gates."""

    dt: float
    dy: float
    block_len: int = 160
    gradient: tuple[float, float] = GRADIENT
    max_cv: float = 0.1
    linearity: float = 0.99
    expiry_s: float = 3.0
    merge_missing: float = 1.0
    valid_missing: float = 0.25

    @property
    def block_s(self) -> float:
        return self.block_len * self.dt

    @property
    def reach(self) -> float:
        """Logarithm of the largest ratio of two values whose spread with a third stays below ``max_cv``."""
        q = min(1.1 * self.max_cv * math.sqrt(1.5), 0.95)
        return math.log((1 + q) / (1 - q))

    @property
    def blocks(self) -> int:
        """A cluster can still meet a track that was last extended so many blocks before."""
        return 1 + math.floor(self.expiry_s / self.block_s + 1e-9)


# --- moments ---------------------------------------------------------------------------------
NONE = np.zeros(6)  # count, means of x and y, centred sums of xx, xy and yy


def moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if not len(x):
        return NONE
    a, b = x.mean(), y.mean()
    return np.array([len(x), a, b, ((x - a) ** 2).sum(), ((x - a) * (y - b)).sum(), ((y - b) ** 2).sum()])


def together(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of the union; rows of ``a`` and ``b`` pair up."""
    n = a[..., 0] + b[..., 0]
    share = np.divide(b[..., 0], n, out=np.zeros_like(n * 1.0), where=n > 0)
    dx, dy = b[..., 1] - a[..., 1], b[..., 2] - a[..., 2]
    w = a[..., 0] * share
    return np.stack([n, a[..., 1] + dx * share, a[..., 2] + dy * share, a[..., 3] + b[..., 3] + w * dx * dx,
                     a[..., 4] + b[..., 4] + w * dx * dy, a[..., 5] + b[..., 5] + w * dy * dy], axis=-1)


def lines(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slope, intercept and correlation; nan where undefined."""
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = np.where(m[..., 3] > 0, m[..., 4] / m[..., 3], np.nan)
        r = np.where((m[..., 3] > 0) & (m[..., 5] > 0), m[..., 4] / np.sqrt(m[..., 3] * m[..., 5]), np.nan)
        return slope, m[..., 2] - slope * m[..., 1], r


def spread(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """|population standard deviation / mean| of three values."""
    v = np.stack(np.broadcast_arrays(a, b, c))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.abs(v.std(0) / v.mean(0))


def _inside(rules: Rules, slope: np.ndarray) -> np.ndarray:
    return (slope >= rules.gradient[1]) & (slope <= rules.gradient[0])


# The same on plain numbers, in the same order of operations: an array costs more than a few numbers.
Moments = tuple[float, float, float, float, float, float]
_NONE = (0.0,) * 6


def _moments(x: list[float], y: list[float]) -> Moments:
    n = len(x)
    if not n:
        return _NONE
    if n >= 8:  # numpy adds longer ones in another order
        return tuple(moments(np.array(x), np.array(y)).tolist())
    a = b = xx = xy = yy = 0.0
    for p, q in zip(x, y):
        a += p
        b += q
    a /= n
    b /= n
    for p, q in zip(x, y):
        p -= a
        q -= b
        xx += p * p
        xy += p * q
        yy += q * q
    return float(n), a, b, xx, xy, yy


def _together(a: Moments, b: Moments) -> Moments:
    n = a[0] + b[0]
    share = b[0] / n if n > 0 else 0.0
    dx, dy = b[1] - a[1], b[2] - a[2]
    w = a[0] * share
    return (n, a[1] + dx * share, a[2] + dy * share, a[3] + b[3] + w * dx * dx, a[4] + b[4] + w * dx * dy, a[5] + b[5] + w * dy * dy)


def _line(m: Moments) -> tuple[float, float, float]:
    slope = m[4] / m[3] if m[3] > 0 else math.nan
    both = math.sqrt(m[3] * m[5]) if m[3] > 0 and m[5] > 0 else 0.0
    return slope, m[2] - slope * m[1], m[4] / both if both else math.nan


def _spread(a: float, b: float, c: float) -> float:
    mean = (a + b + c) / 3
    p, q, r = a - mean, b - mean, c - mean
    return abs(math.sqrt((p * p + q * q + r * r) / 3) / mean) if mean else math.inf


# --- tracks ----------------------------------------------------------------------------------
@dataclass
class Track:
    """All that is kept of a track (or a cluster): moments, and details of its last block alone.

    ``strongest`` moments are those of the strongest detection of each (sample, beam).  Repeats
    of these and of sample numbers only occur inside a block, so ``top`` and ``samples`` hold one
    block; beams and channels are counted only up to what the gates ask for.
    """

    founder: tuple[int, int, int, int]  # block, beam, first sample, cluster
    block: int
    raw: Moments
    past: Moments  # strongest of earlier blocks
    top: dict[tuple[int, int], tuple[float, float]]  # (sample, beam): signal, channel
    n_samples: int  # of earlier blocks
    samples: set[int]
    beams: set[int]
    channels: set[float]
    first: int
    last: int
    noticed: int = 0  # samples when its growth was last looked at
    loose: bool = False
    _strongest: Moments | None = field(default=None, repr=False, compare=False)
    _line: tuple[float, float, float] | None = field(default=None, repr=False, compare=False)

    @classmethod
    def of(cls, rules: Rules, block: int, key: tuple[int, int], rows: np.ndarray) -> Track:
        """A cluster from rows ``(sample, channel, signal, beam)``; equal signals: the lowest channel."""
        points = rows.tolist()
        if any(p[2] != p[2] or p[1] != p[1] for p in points):  # as sorted by numpy: what is no number comes last
            points = rows[np.lexsort((-rows[:, 1], rows[:, 2]))].tolist()
            top = {(int(t), int(beam)): (signal, y) for t, y, signal, beam in points}
        else:
            top = {}
            for t, y, signal, beam in points:
                place = int(t), int(beam)
                held = top.get(place)
                if held is None or signal > held[0] or (signal == held[0] and y < held[1]):
                    top[place] = (signal, y)
        raw = _moments((rows[:, 0] * rules.dt).tolist(), (rows[:, 1] * rules.dy).tolist())
        samples = {int(p[0]) for p in points}
        first, last = min(samples), max(samples)
        return cls((block, key[0], first, key[1]), block, raw, _NONE, top, 0, samples, {int(p[3]) for p in points}, {p[1] for p in points},
                   first, last)

    def strongest(self, rules: Rules) -> Moments:
        if self._strongest is None:
            at = sorted(self.top.items())
            new = _moments([t * rules.dt for (t, _), _ in at], [y * rules.dy for _, (_, y) in at])
            self._strongest = _together(self.past, new) if self.past[0] else new
        return self._strongest

    def line(self, rules: Rules) -> tuple[float, float, float]:
        """Of the strongest detections."""
        if self._line is None:
            self._line = _line(self.strongest(rules))
        return self._line

    def missing(self, n_samples: int, first: int, last: int, n: float) -> float:
        return (last - first - (n_samples - 1) + 1) / n

    def with_cluster(self, rules: Rules, c: Track) -> Track:
        """The union; what was the last block's detail becomes moments when a later block comes."""
        past, top, n, samples = self.past, dict(self.top), self.n_samples, set(self.samples)
        if c.block > self.block:
            past, top, n, samples = self.strongest(rules), {}, n + len(samples), set()
        for place, (signal, channel) in c.top.items():
            if place not in top or signal > top[place][0]:
                top[place] = (signal, channel)
        return Track(self.founder, c.block, _together(self.raw, c.raw), past, top, n, samples | c.samples,
                     set(sorted(self.beams | c.beams)[:6]), set(sorted(self.channels | c.channels)[:5]),
                     min(self.first, c.first), max(self.last, c.last), self.noticed, self.loose)

    def size(self) -> int:
        return self.n_samples + len(self.samples)

    def fits(self, rules: Rules) -> bool:
        slope, _, r = _line(self.raw)
        if not (r <= -0.99 and rules.gradient[1] <= slope <= rules.gradient[0]):
            return False
        n, a = self.raw[0], min(abs(r), 1.0)
        sure = n >= 5 or (n == 4 and 1 - a <= 0.01) or (n == 3 and 1 - 2 * math.asin(a) / math.pi <= 0.01)
        return sure and self.missing(self.size(), self.first, self.last, n) <= rules.merge_missing

    def valid(self, rules: Rules) -> bool:
        if len(self.beams) > 5:
            return True
        slope, _, r = _line(self.raw)
        return (len(self.channels) >= 5 and self.size() >= 5 and abs(r) >= rules.linearity and rules.gradient[1] <= slope <= rules.gradient[0]
                and self.missing(self.size(), self.first, self.last, self.raw[0]) <= rules.valid_missing)

    def row(self) -> tuple:
        slope, _, r = _line(self.raw)
        return int(self.raw[0]), self.first, self.last, *(None if v != v else v for v in (slope, r))


class FirstMatch:
    """Open tracks in the order of their founders, extended block by block."""

    def __init__(self, rules: Rules, tracks: Iterable[Track] = ()):
        self.rules, self.tracks = rules, sorted(tracks, key=lambda t: t.founder)

    def block(self, clusters: Iterable[Track], number: int) -> Iterator[tuple[Track, str]]:
        """Take in a block; yields the tracks it closes, and before them those that silence has closed."""
        yield from self.silence(number - 1)
        for c in sorted(clusters, key=lambda c: c.founder):
            self._place(c)
        judged = [(t, t.valid(self.rules)) for t in self.tracks]
        self.tracks = [t for t, valid in judged if valid]
        yield from ((t, "cancelled") for t, valid in judged if not valid)
        yield from self.silence(number)

    def silence(self, number: int) -> Iterator[tuple[Track, str]]:
        """Close the tracks whose last sample lies too far before the end of block ``number``."""
        end = (number + 1) * self.rules.block_s
        gone = [t for t in self.tracks if end > t.last * self.rules.dt + self.rules.expiry_s]
        self.tracks = [t for t in self.tracks if end <= t.last * self.rules.dt + self.rules.expiry_s]
        return ((t, "terminated") for t in gone)

    def _place(self, c: Track) -> None:
        """The first open track that fits takes the cluster."""
        for i in self._near(c) if self.tracks else ():
            grown = self.tracks[i].with_cluster(self.rules, c)
            if grown.fits(self.rules):
                grown.loose |= self._strays(grown, c.line(self.rules))
                self.tracks[i] = grown
                return
        if c.fits(self.rules):
            self.tracks.append(c)

    def _near(self, c: Track) -> Iterator[int]:
        """Open tracks whose line is like the cluster's; many are compared at once."""
        rules, own, b = self.rules, c.strongest(self.rules), c.line(self.rules)
        if len(self.tracks) > 24:
            held = np.array([t.strongest(rules) for t in self.tracks])
            a, m = lines(held), lines(together(held, np.broadcast_to(np.array(own), held.shape)))
            near = (spread(a[0], b[0], m[0]) < rules.max_cv) & (spread(a[1], b[1], m[1]) < rules.max_cv)
            yield from np.flatnonzero(near & _inside(rules, m[0])).tolist()
            return
        steep, shallow = rules.gradient[1], rules.gradient[0]
        for i, t in enumerate(self.tracks):
            m = _line(_together(t.strongest(rules), own))
            if steep <= m[0] <= shallow:
                a = t.line(rules)
                if _spread(a[0], b[0], m[0]) < rules.max_cv and _spread(a[1], b[1], m[1]) < rules.max_cv:
                    yield i

    def _strays(self, track: Track, of: tuple) -> bool:
        """Whether a track's line lies farther from its last cluster than parts are told apart by.

        Repeated (sample, beam) places in a block can do that; parts are not safe then.
        """
        return not all(q and p / q > 0 and abs(math.log(p / q)) <= self.rules.reach for p, q in zip(track.line(self.rules)[:2], of[:2]))


# --- on Spark --------------------------------------------------------------------------------
def association_parts(points: DataFrame, obs: str, rules: Rules) -> DataFrame:
    """``(obs, iter, beam_id, cluster_id, part, last_block)``: parts of clusters that could meet in one track.

    A track's line stays within a ratio of its last cluster's line, and a cluster can only join
    within that ratio of the track, so clusters that follow each other in a track differ by less
    than its square, in slope and in intercept.  Both are cut into logarithmic cells; occupied cells
    within reach, over the blocks a track stays open, are linked, and parts are the components of
    the cells.  There is a row for each cluster, and links grow with the cells, not with pairs.
    Observations of up to ``TASK_CLUSTERS`` clusters are linked many at a time inside tasks, larger ones by joins.
    """
    best = best_detections(points.select(obs, *CLUSTER, "time_sample", "channel_sample", "snr"), [obs, *CLUSTER, "time_sample"], ["channel_sample"])
    c = fits(best, [obs, *CLUSTER], dt=rules.dt, dy=rules.dy)
    width = 2 * rules.reach

    def cell(x: str) -> Column:  # a line without a slope or through zero meets nothing
        return F.when(F.col(x) != 0, F.floor(F.log(F.abs(F.col(x))) / width))

    c = c.withColumns({"_s": cell("slope"), "_i": cell("intercept"), "_g": F.signum("slope") * 3 + F.signum("intercept")})
    alone = F.col("_s").isNull() | F.col("_i").isNull()
    node = F.when(alone, F.xxhash64(*CLUSTER)).otherwise(F.xxhash64("iter", "_s", "_i", "_g"))
    c = cut(c.withColumn("node", node).select(obs, *CLUSTER, "node", "_s", "_i", "_g"), "cells")
    large = cut(c.groupBy(obs).agg(F.count("*").alias("n")).where(F.col("n") > TASK_CLUSTERS).select(obs), "large")
    some = not large.isEmpty()
    parts = _parts_in_tasks(c.join(large, obs, "left_anti") if some else c, obs, rules)
    return parts.unionByName(_parts_by_join(c.join(large, obs, "left_semi"), obs, rules)) if some else parts


TASK_CLUSTERS = 50_000  # an observation of more clusters is linked by joins


def _parts_by_join(c: DataFrame, obs: str, rules: Rules) -> DataFrame:
    """Cells meet by equality joins; parts are found by distributed components."""
    steps = 1
    cells = c.where("_s IS NOT NULL AND _i IS NOT NULL").select(obs, "iter", "_s", "_i", "_g", "node").distinct()
    near = F.sequence(F.lit(-steps), F.lit(steps))
    moved = cells.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(rules.blocks)))).withColumn("_ds", F.explode(near)).withColumn(
        "_di", F.explode(near)).where("_b > 0 OR _ds > 0 OR (_ds = 0 AND _di > 0)").select(
        obs, (F.col("iter") + F.col("_b")).alias("iter"), (F.col("_s") + F.col("_ds")).alias("_s"),
        (F.col("_i") + F.col("_di")).alias("_i"), "_g", F.col("node").alias("src"))
    edges = moved.join(cells.withColumnRenamed("node", "dst"), [obs, "iter", "_s", "_i", "_g"]).select(obs, "src", "dst")
    nodes = c.select(obs, "node").distinct()
    part = label_nodes(nodes, edges, "node", [obs]).select(obs, "node", F.col("component").alias("part"))
    last = c.groupBy(obs).agg(F.max("iter").alias("last_block"))
    return c.select(obs, *CLUSTER, "node").join(part, [obs, "node"]).join(last, obs).select(obs, *CLUSTER, "part", "last_block")


def _parts_in_tasks(c: DataFrame, obs: str, rules: Rules) -> DataFrame:
    """The same parts, many whole observations of a task linked together."""
    schema = T.StructType([*c.select(obs, *CLUSTER).schema.fields, T.StructField("part", T.LongType()),
                           T.StructField("last_block", c.schema["iter"].dataType)])
    names, arrow = [obs, *CLUSTER], to_arrow_schema(schema)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        has = ~table.column("iter").is_null().to_numpy()
        none = np.iinfo(np.int64).min
        block = np.where(has, table.column("iter").fill_null(0).to_numpy().astype(np.int64), none)
        last = np.maximum.reduceat(block, starts)[group]
        part = _linked(group, block, has, *(numbers(table, x, pa.float64()) for x in ("_s", "_i", "_g")), numbers(table, "node", pa.int64()),
                       rules.blocks)
        found = [pa.array(part), pa.array(last, mask=last == none)]
        return pa.table([*(table.column(x) for x in names), *found], [f.name for f in arrow]).cast(arrow)

    return whole_groups(c.where(F.col(obs).isNotNull()), [obs], run, schema)


def _linked(group: np.ndarray, block: np.ndarray, has: np.ndarray, s: np.ndarray, i: np.ndarray, g: np.ndarray, node: np.ndarray,
            blocks: int) -> np.ndarray:
    """Smallest node of the cells within reach of each other, for clusters of many observations; ``s``, ``i`` are whole or NaN."""
    meets = has & (s == s) & (i == i)
    if not meets.any():
        return node.copy()
    at = np.lexsort((block[meets], group[meets]))
    at = np.flatnonzero(meets)[at]

    def ranks(x: np.ndarray) -> np.ndarray:  # neighbours stay neighbours, wider gaps become two
        known, place = np.unique(x, return_inverse=True)
        return np.append(0, np.cumsum(np.minimum(np.diff(known), 2)))[place].astype(np.int64)

    new = np.append(True, (np.diff(group[at]) != 0) | (np.diff(block[at]) != 0))
    row = np.cumsum(new) - 1  # (observation, block), in order
    of, number = group[at][new], block[at][new]
    rs, ri, rg = ranks(s[at]), ranks(i[at]), np.unique(g[at], return_inverse=True)[1]
    wi, wg = ri.max() + 3, rg.max() + 1
    ws = rs.max() + 3
    cell = ((row * ws + rs + 1) * wi + ri + 1) * wg + rg
    cells, first, place = np.unique(cell, return_index=True, return_inverse=True)
    row, low = row[first], node[at][first]
    np.minimum.at(low, place, node[at])
    u, v = [], []
    for later in range(blocks + 1):
        to = np.minimum(row + later, len(of) - 1)
        reached = (row + later < len(of)) & (of[to] == of[row]) & (number[to] - number[row] <= blocks)
        if not reached.any():
            break
        for ds in (-1, 0, 1):
            for di in (-1, 0, 1):
                if later or (ds, di) > (0, 0):
                    want = cells[reached] + ((later * ws + ds) * wi + di) * wg
                    there = np.minimum(np.searchsorted(cells, want), len(cells) - 1)
                    hit = cells[there] == want
                    u.append(np.flatnonzero(reached)[hit])
                    v.append(there[hit])
    label = local_components(len(cells), np.concatenate(u), np.concatenate(v))
    part, least = node.copy(), low.copy()
    np.minimum.at(least, label, low)
    part[at] = least[label][place]
    return part


def part_sizes(parts: DataFrame, obs: str) -> DataFrame:
    """Clusters and blocks of each part: what one task has to fold in order."""
    return parts.groupBy(obs, "part").agg(F.count("*").alias("clusters"), F.count_distinct("iter").alias("blocks"))


def may_found(rules: Rules, n: np.ndarray, raw: np.ndarray, first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether clusters could fit by themselves; sums here may differ in the last digits, so limits are a little wider than the rule's.

    Nothing begins a track but a cluster that fits by itself: until one comes, a part has no tracks.
    """
    slope, _, r = lines(raw)
    with np.errstate(divide="ignore", invalid="ignore"):
        missing = (last - first - (size - 1) + 1) / n
        low, high = sorted(rules.gradient)
        edge = 1e-6 * max(abs(low), abs(high))
        never = (n < 3) | (r > -0.99 + 1e-6) | ((n == 3) & (r > -0.9998)) | ((n == 4) & (r > -0.99 + 1e-6))
        return ~(never | (slope < low - edge) | (slope > high + edge) | (missing > rules.merge_missing * (1 + 1e-6) + 1e-6))


def cluster_moments(rules: Rules, x: np.ndarray, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Counts, moments, first and last and number of samples of the clusters that begin at ``at``; rows in order of sample ``x``."""
    n = np.diff(np.append(at, len(x)))
    t, c = x * rules.dt, y * rules.dy
    mt, mc = np.add.reduceat(t, at) / n, np.add.reduceat(c, at) / n
    dt, dc = t - np.repeat(mt, n), c - np.repeat(mc, n)
    raw = np.stack([n, mt, mc, *(np.add.reduceat(v, at) for v in (dt * dt, dt * dc, dc * dc))], axis=-1)
    new = np.append(True, np.diff(x) != 0)
    new[at] = True
    return n, raw, x[at], x[at + n - 1], np.add.reduceat(new.astype(np.int64), at)


def block_clusters(rules: Rules, keys: np.ndarray, rows: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, list[Track]]]:
    """Blocks in order, each with its clusters, which begin and end at ``edges``; ``keys`` are (block, beam, cluster) of each."""
    number, held = None, []
    for (block, beam, cluster), a, z in zip(keys.tolist(), edges, edges[1:]):
        if block != number:
            if held:
                yield number, held
            number, held = block, []
        held.append(Track.of(rules, block, (beam, cluster), rows[a:z]))
    if held:
        yield number, held


_FOUND = "f_iter long, f_beam long, f_time long, f_cluster long, loose boolean, " + TRACK_SCHEMA.split(", ", 1)[1]


def _folded(points: DataFrame, obs: str, rules: Rules) -> DataFrame:
    """Tracks of each (obs, part), with their founders and whether the part was safe to fold alone.

    Clusters that may found a track are picked for all parts of a table together; parts are folded from
    their first such cluster on.
    """
    columns = [obs, *CLUSTER, "time_sample", "channel_sample", "snr", "part", "last_block"]
    schema = T.StructType([points.schema[obs], *T._parse_datatype_string(_FOUND).fields])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        keys = np.stack([group, *(numbers(table, x, pa.int64()) for x in CLUSTER)], axis=-1)
        t, y, snr = (numbers(table, x, pa.float64()) for x in ("time_sample", "channel_sample", "snr"))
        order = np.lexsort((t, *keys.T[::-1]))
        keys, rows = keys[order], np.stack([t, y, snr, keys[:, 2]], axis=-1)[order]
        at = np.flatnonzero(np.append(True, (np.diff(keys, axis=0) != 0).any(1)))
        able = np.flatnonzero(may_found(rules, *cluster_moments(rules, rows[:, 0], rows[:, 1], at)))
        edges, keys = np.append(at, len(rows)), keys[at]
        parts, begin = np.unique(keys[able, 0], return_index=True)
        ends = np.searchsorted(keys[:, 0], parts, "right")
        last = table.column("last_block").take(pa.array(starts[parts])).to_pylist()
        done, of = [], []
        for part, a, z, final in zip(parts.tolist(), able[begin].tolist(), ends.tolist(), last):
            match, before = FirstMatch(rules), len(done)
            for number, clusters in block_clusters(rules, keys[a:z, 1:], rows, edges[a:z + 1]):
                done += match.block(clusters, number)
            done += match.silence(final)
            done += [(track, "pending") for track in match.tracks]
            of += [int(starts[part])] * (len(done) - before)
        found = [(*track.founder, track.loose, status, *track.row()) for track, status in done]
        values = [pa.array(v, f.type) for v, f in zip(zip(*found) if found else [()] * (len(arrow) - 1), list(arrow)[1:])]
        return pa.table([table.column(obs).take(pa.array(of, pa.int64())), *values], [f.name for f in arrow]).cast(arrow)

    return whole_groups(points.select(*columns), [obs, "part"], run, schema)


def associate_first_match(points: DataFrame, obs: str, dt: float, dy: float, block_len: int = 160, **limits) -> DataFrame:
    """Tracks of each observation with their status at the end of its last block.

    ``points(obs, iter, beam_id, cluster_id, time_sample, channel_sample, snr)``; blocks without a
    cluster pass in silence.  Tracks are numbered from 0 in order of their founding clusters.  Parts are
    folded in parallel; an observation in which some track strays from its part is folded as a
    whole, so the result never depends on the parts.
    """
    rules = Rules(dt, dy, block_len, **limits)
    columns = [obs, *CLUSTER, "time_sample", "channel_sample", "snr"]
    parts = cut(association_parts(points, obs, rules), "parts")
    dealt = points.select(*columns).join(parts, [obs, *CLUSTER])
    tracks = cut(_folded(dealt, obs, rules), "part-tracks")
    strayed = tracks.where("loose").select(obs).distinct()
    if not strayed.isEmpty():
        whole = dealt.join(strayed, obs, "left_semi").withColumn("part", F.lit(0).cast("long"))
        tracks = cut(tracks.join(strayed, obs, "left_anti").unionByName(_folded(whole, obs, rules)), "tracks")
    order = ["f_iter", "f_beam", "f_time", "f_cluster"]
    return row_index(tracks, [obs], order, "f_iter", "_no").select(
        obs, (F.col("_no") - 1).alias("track_no"), "status", "n", "first_sample", "last_sample", "gradient", "r")


def sequential(points: DataFrame, obs: str, dt: float, dy: float, block_len: int = 160, **limits) -> DataFrame:
    """The same rule with one group per observation: for short ones, and to compare."""
    rules = Rules(dt, dy, block_len, **limits)
    last = points.groupBy(obs).agg(F.max("iter").alias("last_block"))
    columns = [obs, *CLUSTER, "time_sample", "channel_sample", "snr"]
    tracks = _folded(points.select(*columns).join(last, obs).withColumn("part", F.lit(0).cast("long")), obs, rules)
    return row_index(tracks, [obs], ["f_iter", "f_beam", "f_time", "f_cluster"], "f_iter", "_no").select(
        obs, (F.col("_no") - 1).alias("track_no"), "status", "n", "first_sample", "last_sample", "gradient", "r")

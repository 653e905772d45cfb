"""Neighbourhood operators on images.

An image is cut into tiles along the channel axis; every tile also gets the rows within the
halo of the operator.  A tile is bounded by its area whatever the image size or the number
of images, so each is one small dense matrix inside a task.  Cells without a row are zero.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skysieve.session import numbers, whole_groups

IMAGE = ("iter", "beam_id")


def over_tiles(pixels: DataFrame, kernel: Callable, halo: int, n_channels: int, n_times: int,
               keys: Sequence[str] = IMAGE, tile: int = 256, keep: bool = True,
               value: str = "result", places: bool = False) -> DataFrame:
    """Run ``kernel(matrix, lo, hi, top) -> matrix`` on every tile.

    ``matrix`` covers channels lo..hi-1 of an image with ``top`` channels.  With ``keep`` the
    result is read at the pixels that exist; without, at all cells where it is not zero.  With
    ``places`` the kernel gets the rows and columns of those pixels too and returns their values alone.
    """
    keys = list(keys)
    last = (n_channels - 1) // tile
    c = F.col("channel_sample")
    copies = pixels.select(*keys, "channel_sample", "time_idx", "power").withColumn(
        "_tile", F.explode(F.sequence(
            F.greatest(F.lit(0), F.floor((c - halo) / tile)).cast("int"),
            F.least(F.lit(last), F.floor((c + halo) / tile)).cast("int"))))

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        channel, time = (numbers(table, x, pa.int64()) for x in ("channel_sample", "time_idx"))
        tiles, power = numbers(table, "_tile", pa.int64()), numbers(table, "power", pa.float64())
        found = []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            own = int(tiles[a]) * tile
            lo, hi = max(0, own - halo), min(n_channels, own + tile + halo)
            ch, t = channel[a:b], time[a:b]
            m = np.zeros((hi - lo, n_times))
            m[ch - lo, t] = power[a:b]
            if keep:
                mine = (ch >= own) & (ch < own + tile)
                ch, t = ch[mine], t[mine]
                out = kernel(m, lo, hi, n_channels, ch - lo, t) if places else kernel(m, lo, hi, n_channels)[ch - lo, t]
            else:
                out = kernel(m, lo, hi, n_channels)
                ch, t = np.nonzero(out)
                mine = (ch + lo >= own) & (ch + lo < own + tile)
                ch, t = ch[mine] + lo, t[mine]
                out = out[ch - lo, t]
            found.append((np.full(len(ch), a), ch, t, m[ch - lo, t], out.astype(float)))
        group, ch, t, power, out = (np.concatenate(x) for x in zip(*found))
        res = table.select(keys).take(pa.array(group))
        for name, v in (("channel_sample", ch.astype(np.int32)), ("time_idx", t.astype(np.int32)), ("power", power), (value, out)):
            res = res.append_column(name, pa.array(v))
        return res

    schema = T.StructType([pixels.schema[k] for k in keys] + [
        T.StructField("channel_sample", T.IntegerType()), T.StructField("time_idx", T.IntegerType()),
        T.StructField("power", T.DoubleType()), T.StructField(value, T.DoubleType())])
    return whole_groups(copies, [*keys, "_tile"], run, schema)


def _window_sum(m: np.ndarray, rc: int, rt: int) -> np.ndarray:
    """Sum over the (2 rc + 1) x (2 rt + 1) neighbourhood, zero outside."""
    p = np.pad(m, ((rc + 1, rc), (rt + 1, rt))).cumsum(0).cumsum(1)
    h, w = 2 * rc + 1, 2 * rt + 1
    return p[h:, w:] - p[:-h, w:] - p[h:, :-w] + p[:-h, :-w]


def remove_isolated(pixels: DataFrame, n_channels: int, n_times: int, radius: int = 1,
                    keys: Sequence[str] = IMAGE) -> DataFrame:
    """Drop pixels whose whole neighbourhood (3x3, or 5x5 with radius 2) is zero."""

    def kernel(m, lo, hi, top):
        return _window_sum((m != 0).astype(float), radius, radius)

    out = over_tiles(pixels, kernel, radius, n_channels, n_times, keys, value="_n")
    return out.where((F.col("_n") > 1) | (F.col("power") == 0)).drop("_n")


def opening(pixels: DataFrame, n_channels: int, n_times: int, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Morphological opening with a 2x2 block: keep pixels covered by a full 2x2 block."""

    def kernel(m, lo, hi, top):
        b = np.pad(m != 0, 1)
        full = b[1:, 1:] & b[:-1, 1:] & b[1:, :-1] & b[:-1, :-1]
        return full[1:, 1:] | full[:-1, 1:] | full[1:, :-1] | full[:-1, :-1]

    return over_tiles(pixels, kernel, 2, n_channels, n_times, keys, value="_k").where("_k > 0").drop("_k")


def adaptive_threshold(pixels: DataFrame, n_channels: int, n_times: int, block: int = 151,
                       keys: Sequence[str] = IMAGE) -> DataFrame:
    """Gaussian-weighted local mean (sigma = (block-1)/6, cut at 4 sigma, mirrored edges)."""
    sigma = (block - 1) / 6.0
    radius = int(4.0 * sigma + 0.5)
    k = np.arange(-radius, radius + 1)
    weights = np.exp(-0.5 * (k / sigma) ** 2)
    weights /= weights.sum()

    def fold(first: int, last: int, lo: int, hi: int, size: int) -> np.ndarray:
        """Weights of cells lo..hi-1 for outputs first..last-1 of an axis with mirrored ends."""
        out = np.zeros((last - first, hi - lo))
        src = np.mod(np.arange(first, last)[:, None] + k[None, :], 2 * size)
        src = np.where(src >= size, 2 * size - 1 - src, src)
        inside = (src >= lo) & (src < hi)
        rows = np.broadcast_to(np.arange(last - first)[:, None], src.shape)
        np.add.at(out, (rows[inside], src[inside] - lo), np.broadcast_to(weights, src.shape)[inside])
        return out

    def kernel(m, lo, hi, top):
        return fold(lo, hi, lo, hi, top) @ m @ fold(0, n_times, 0, n_times, n_times).T

    return over_tiles(pixels, kernel, radius, n_channels, n_times, keys, value="threshold")


def median_filter(pixels: DataFrame, n_channels: int, n_times: int, size: int = 20,
                  keys: Sequence[str] = IMAGE, tile: int = 64) -> DataFrame:
    """Median over a size x size neighbourhood (offsets -size/2 .. size/2-1), mirrored edges."""
    half, middle = size // 2, size * size // 2
    some = 2_000_000 // (size * size) + 1  # windows put in order at a time

    def kernel(m, lo, hi, top, r, c):
        edge = ((half if lo == 0 else 0, half if hi == top else 0), (half, half))
        p = np.pad(m, edge, mode="symmetric")
        r = r if lo == 0 else r - half

        def within(flags):
            s = np.pad(flags.astype(np.int64), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
            return s[r + size, c + size] - s[r, c + size] - s[r + size, c] + s[r, c]

        # in a window that is mostly empty the median is zero; only the others are put in order
        below = within(p < 0)
        open_ones = np.flatnonzero((below > middle) | (below + within(p == 0) <= middle))
        out = np.zeros(len(r))
        windows = np.lib.stride_tricks.sliding_window_view(p, (size, size))
        for a in range(0, len(open_ones), some):
            at = open_ones[a:a + some]
            out[at] = np.partition(windows[r[at], c[at]].reshape(len(at), -1), middle, axis=1)[:, middle]
        return out

    return over_tiles(pixels, kernel, half, n_channels, n_times, keys, tile, value="filtered", places=True)


def cfar_peaks(pixels: DataFrame, n_channels: int, n_times: int, train: int = 10, guard: int = 2,
               false_alarm: float = 1e-3, keys: Sequence[str] = IMAGE) -> DataFrame:
    """Constant-false-alarm peaks along the channel axis, per time column.

    A peak is the first maximum of its window and exceeds the training mean by the factor
    n (Pfa^(-1/n) - 1); the outermost cells of the axis are not tested.
    """
    side, inner = train // 2 + guard // 2, guard // 2
    alpha = train * (false_alarm ** (-1.0 / train) - 1)

    def kernel(m, lo, hi, top):
        noise = (_window_sum(m, side, 0) - _window_sum(m, inner, 0)) / train
        p = np.pad(m, ((side, side), (0, 0)), constant_values=-np.inf)
        n = m.shape[0]
        before = np.max([p[i: i + n] for i in range(side)], axis=0)
        after = np.max([p[i: i + n] for i in range(side + 1, 2 * side + 1)], axis=0)
        ch = np.arange(lo, hi)[:, None]
        return (m > before) & (m >= after) & (m > alpha * noise) & (ch >= side) & (ch < top - side)

    return over_tiles(pixels, kernel, side, n_channels, n_times, keys, value="_k").where("_k > 0").drop("_k")

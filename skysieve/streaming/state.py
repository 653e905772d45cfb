"""Keyed state: rolling noise and open tracks."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skysieve.operators.association import CLUSTER, FirstMatch, Rules, Track, block_clusters, cluster_moments, may_found
from skysieve.operators.channelise import block_spectra
from skysieve.session import numbers

NOISE_OUT = "iter long, beam_id int, channel_sample int, channel_noise double, channel_noise_std double"
NOISE_STATE = "channel array<int>, noise array<array<double>>, std array<array<double>>"


def rolling_noise_stream(noise: DataFrame, n_blocks: int = 10, channels_per_key: int = 64) -> DataFrame:
    """Running median of block noise per channel, on a stream of block estimates.

    State is the last ``n_blocks`` values of a group of channels of one beam: bounded, and
    independent of the length of the observation.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past: dict[int, tuple[list, list]] = {}
        if state.exists:
            past = {c: (list(a), list(b)) for c, a, b in zip(*state.get)}
        rows = pd.concat(list(batches), ignore_index=True).sort_values("iter")
        out = []
        for r in rows.itertuples(index=False):
            a, b = past.setdefault(int(r.channel_sample), ([], []))
            a.append(float(r.noise))
            b.append(float(r.noise_std))
            del a[:-n_blocks], b[:-n_blocks]
            out.append((int(r.iter), int(r.beam_id), int(r.channel_sample), float(np.median(a)), float(np.median(b))))
        state.update((list(past), [v[0] for v in past.values()], [v[1] for v in past.values()]))
        yield pd.DataFrame(out, columns=["iter", "beam_id", "channel_sample", "channel_noise", "channel_noise_std"])

    keyed = noise.withColumn("_g", F.floor(F.col("channel_sample") / channels_per_key))
    return keyed.groupBy("beam_id", "_g").applyInPandasWithState(
        run, NOISE_OUT, NOISE_STATE, "append", GroupStateTimeout.NoTimeout)


TRACK_OUT = ("track_no long, status string, n long, first_sample long, last_sample long, gradient double, r double, "
             "event string")
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class OpenTracks(StatefulProcessor):
    """First-match association of a bucket of observations: blocks wait for the watermark, tracks for a timer.

    Rows come packed, all of a bucket and a block's end together, and wait as they come.  State is
    the rows of blocks the watermark has not passed, what is known of each observation and, for each
    open track, moments and the details of one block, whatever the length of the observation.
    """

    def __init__(self, rules: Rules, keys: Sequence[str], rows: pa.Schema, out: pa.Schema):
        self.rules, self.keys, self.rows, self.out = rules, list(keys), rows, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "end_ms long, part long", "rows array<binary>")
        self.held = handle.getValueState("held", "observations binary")
        self.clock = handle.getValueState("clock", "fired_ms long, timer_ms long, parts long")

    def _observations(self) -> dict[tuple, tuple]:
        """``(last block taken in, tracks so far, time of block 0, stored open tracks)`` by key."""
        return pickle.loads(self.held.get()[0]) if self.held.exists() else {}

    def _end_ms(self, block: int, start_ms: int) -> int:
        return start_ms + math.ceil((block + 1) * self.rules.block_s * 1000)

    def _passed(self, watermark_ms: int, start_ms: int) -> int:
        """The last block that ends at or before the watermark."""
        block = math.floor((watermark_ms - start_ms) / (self.rules.block_s * 1000)) - 1
        while self._end_ms(block + 1, start_ms) <= watermark_ms:
            block += 1
        while self._end_ms(block, start_ms) > watermark_ms:
            block -= 1
        return block

    def _table(self, parts: Sequence[bytes]) -> pa.Table:
        return pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(p), self.rows) for p in parts], self.rows)

    def _codes(self, table: pa.Table) -> tuple[np.ndarray, list[tuple]]:
        """Numbers of the observations of the rows, and their keys."""
        code = np.zeros(table.num_rows, np.int64)
        for k in self.keys:
            found = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * len(found.dictionary) + found.indices.to_numpy(), return_inverse=True)[1]
        first = pa.array(np.unique(code, return_index=True)[1])
        return code, list(zip(*(table.column(k).take(first).to_pylist() for k in self.keys)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fired, timer, parts = self.clock.get() if self.clock.exists() else (None, None, 0)
        ends: dict[int, list[bytes]] = {}
        for r in rows:
            if r["rows"] is not None:  # else a tick: only its time counts
                ends.setdefault(r["end_ms"], []).append(bytes(r["rows"]))
        if not ends:
            return
        late: dict[tuple, int] = {}
        for end in [e for e in ends if fired is not None and e <= fired]:
            ends[end] = self._in_time(ends[end], late)
        ends = {end: held for end, held in ends.items() if held}
        for end, held in ends.items():
            self.waiting.updateValue((end, parts), (held,))
            parts += 1
        if ends and (timer is None or min(ends) < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = min(ends)
            self.handle.registerTimer(timer)
        self.clock.update((fired, timer, parts))
        yield from self._packed([(*k, None, "late", n, None, None, None, None, "late") for k, n in late.items()])

    def _in_time(self, parts: list[bytes], late: dict[tuple, int]) -> list[bytes]:
        """Rows of blocks that have not been taken in; counts the others."""
        table, known = self._table(parts), self._observations()
        code, keys = self._codes(table)
        done = np.array([-math.inf if (o := known.get(k)) is None else o[0] for k in keys])
        gone = numbers(table, "iter", pa.int64()) <= done[code]
        for c, n in zip(*np.unique(code[gone], return_counts=True)):
            late[keys[c]] = late.get(keys[c], 0) + int(n)
        return [b.serialize().to_pybytes() for b in table.filter(pa.array(~gone)).combine_chunks().to_batches()]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        _, _, parts = self.clock.get()
        places = [tuple(k) for k in self.waiting.keys()]
        due = sorted(k for k in places if k[0] <= now)
        table = self._table([p for k in due for p in self.waiting.getValue(k)[0]])
        for k in due:
            self.waiting.removeKey(k)
        known, out = self._observations(), []
        blocks, starts = self._blocks(table, {k for k, o in known.items() if o[3]})
        following = [k[0] for k in places if k[0] > now]
        for k in [*starts, *(k for k, o in known.items() if o[3] and k not in starts)]:
            done, counter, start, stored = known.get(k) or (None, 0, starts[k], ())
            passed = self._passed(now, start)
            match, numbered = FirstMatch(self.rules), {}
            for founder, value in stored:
                match.tracks.append(self._track(founder, value))
                numbered[founder] = value[0]
            for number, clusters in blocks.get(k, ()):
                closed = list(match.block(clusters, number))
                opened = [t for t in (*match.tracks, *(t for t, _ in closed)) if t.founder not in numbered]
                for t in sorted(opened, key=lambda t: t.founder):
                    numbered[t.founder] = counter
                    counter += 1
                for t, status in closed:
                    out.append((*k, numbered[t.founder], status, *t.row(), "transit" if status == "terminated" else "deleted"))
                for t in match.tracks:
                    size = t.size()
                    if not t.noticed or (size - t.noticed) / size > 0.10:
                        out.append((*k, numbered[t.founder], "pending", *t.row(), "modified" if t.noticed else "created"))
                    t.noticed = size
            out += [(*k, numbered[t.founder], status, *t.row(), "transit") for t, status in match.silence(passed)]
            for t in match.tracks:
                limit = t.last * self.rules.dt + self.rules.expiry_s
                block = math.floor(limit / self.rules.block_s)
                block += (block + 1) * self.rules.block_s <= limit
                following.append(self._end_ms(block, start))
            known[k] = (max(passed, -1 if done is None else done), counter, start,
                        [(t.founder, self._stored(t, numbered[t.founder])) for t in match.tracks])
        timer = min(following, default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        self.held.update((pickle.dumps(known),))
        self.clock.update((now, timer, parts))
        yield from self._packed(out)

    def _blocks(self, table: pa.Table, tracked: set[tuple]) -> tuple[dict, dict]:
        """Blocks with their clusters for each observation that has or may found tracks, and the times of block 0 of all."""
        if not table.num_rows:
            return {}, {}
        code, keys = self._codes(table)
        first = np.unique(code, return_index=True)[1]
        starts = dict(zip(keys, numbers(table, "start_ms", pa.int64())[first].tolist()))
        ids = np.stack([code, *(numbers(table, c, pa.int64()) for c in CLUSTER)], axis=-1)
        t, y, snr = (numbers(table, c, pa.float64()) for c in ("time_sample", "channel_sample", "snr"))
        order = np.lexsort((t, *ids.T[::-1]))
        ids, rows = ids[order], np.stack([t, y, snr, ids[:, 2]], axis=-1)[order]
        at = np.flatnonzero(np.append(True, (np.diff(ids, axis=0) != 0).any(1)))
        edges, ids = np.append(at, len(rows)), ids[at]
        able = may_found(self.rules, *cluster_moments(self.rules, rows[:, 0], rows[:, 1], at))
        able |= np.array([k in tracked for k in keys])[ids[:, 0]]
        able = np.flatnonzero(able)
        some, begin = np.unique(ids[able, 0], return_index=True)
        ends = np.searchsorted(ids[:, 0], some, "right")
        return {keys[c]: block_clusters(self.rules, ids[a:z, 1:], rows, edges[a:z + 1])
                for c, a, z in zip(some.tolist(), able[begin].tolist(), ends.tolist())}, starts

    def _packed(self, rows: list[tuple], at_once: int = 50_000) -> Iterator[Row]:
        for i in range(0, len(rows), at_once):
            columns = zip(*rows[i:i + at_once])
            batch = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, self.out)], schema=self.out)
            yield Row(rows=batch.serialize().to_pybytes())

    def close(self) -> None:
        pass

    @staticmethod
    def _stored(t: Track, number: int) -> tuple:
        top = [[float(a), float(b), s, y] for (a, b), (s, y) in t.top.items()]
        return (number, t.block, list(t.raw), list(t.past), top, t.n_samples, sorted(t.samples), sorted(t.beams),
                sorted(t.channels), t.first, t.last, t.noticed)

    @staticmethod
    def _track(founder: tuple, stored: tuple) -> Track:
        _, block, raw, past, top, n, samples, beams, channels, first, last, noticed = stored
        return Track(founder, block, tuple(raw), tuple(past), {(int(a), int(b)): (s, y) for a, b, s, y in top}, n, set(samples),
                     set(beams), set(channels), first, last, noticed)


def track_stream(points: DataFrame, obs: str | Sequence[str], dt: float, dy: float, block_len: int = 160, delay: str = "0 seconds",
                 start_ms: int | str = 0, buckets: int = 1024, **limits) -> DataFrame:
    """First-match association on a stream of cluster points, with its event notices.

    A block is taken in once the watermark has passed its end, so its rows may come in any order and
    over several batches, as long as they are not later than ``delay``; rows of a block already
    taken in are counted in an event ``late``.  A row is emitted when a track is created, has
    grown by more than 10 %, is cancelled or has been silent for too long; timers end tracks
    without any further row of their key.  Rows without a cluster only move the time on.  ``obs``
    may name several columns whose values never share a track.  ``start_ms`` is the time of block 0, or the
    column that has it for each observation: needed where observations do not run at the same time.
    Observations are dealt to ``buckets``, whose state and rows Python gets together; what is known of the
    observations of a bucket is written again when one of them goes on, so more of them need more buckets.
    """
    keys = [obs] if isinstance(obs, str) else list(obs)
    _rocks(points.sparkSession)
    rules = Rules(dt, dy, block_len, **limits)
    start = F.coalesce(F.col(start_ms) if isinstance(start_ms, str) else F.lit(start_ms), F.lit(0)).cast("long")
    end = start + F.ceil((F.col("iter") + 1) * rules.block_s * 1000).cast("long")
    rows = points.select(*keys, *(F.col(c).cast("long").alias(c) for c in CLUSTER), F.col("time_sample").cast("double").alias("time_sample"),
                         F.col("channel_sample").cast("double").alias("channel_sample"), F.col("snr").cast("double").alias("snr"),
                         start.alias("start_ms"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), end.alias("_end_ms"))
    kept = to_arrow_schema(rows.drop("_bucket", "_end_ms").schema)
    out = T.StructType([*(points.schema[k] for k in keys), *T._parse_datatype_string(TRACK_OUT).fields])
    out_rows = to_arrow_schema(out)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column(0):
                yield pa.ipc.read_record_batch(packed.as_buffer(), out_rows)

    packed = rows.mapInArrow(_packer(kept), "bucket long, end_ms long, rows binary")
    timed = packed.withColumn("block_end", F.timestamp_millis("end_ms")).withWatermark("block_end", delay)
    return timed.groupBy("bucket").transformWithState(OpenTracks(rules, keys, kept, out_rows), "rows binary", "Append", "EventTime").mapInArrow(
        unpack, out)


def _packer(kept: pa.Schema, at_once: int = 500_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a bucket and a block's end in one row; rows without a cluster leave only their times."""
    names = kept.names

    def packed(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        none = pc.is_null(table.column("cluster_id"))
        ticks = pc.drop_null(pc.unique(table.filter(none).column("_end_ms"))).to_pylist()
        table = table.filter(pc.invert(none))
        if any(table.column(c).null_count for c in ("iter", "beam_id", "time_sample")):
            raise ValueError("a row with a cluster needs its block, beam and sample")
        bucket, end = (numbers(table, c, pa.int64()) for c in ("_bucket", "_end_ms"))
        order = np.lexsort((end, bucket))
        bucket, end = bucket[order], end[order]
        at = np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(end) != 0))) if len(order) else order
        rows = table.select(names).cast(kept).take(pa.array(order)).combine_chunks()
        whole = rows.to_batches()[0] if len(order) else None
        values = [whole.slice(a, z - a).serialize() for a, z in zip(at.tolist(), np.append(at[1:], len(order)).tolist())]
        return pa.RecordBatch.from_arrays([
            pa.array([0] * len(ticks) + bucket[at].tolist(), pa.int64()), pa.array(ticks + end[at].tolist(), pa.int64()),
            pa.array([None] * len(ticks) + [v.to_pybytes() for v in values], pa.binary())], ["bucket", "end_ms", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= at_once:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


class ChannelPower(StatefulProcessor):
    """Runs of samples of one beam to channel powers above the rolling noise, a block at a time.

    A block leaves when all its samples have come, and only after the one before it.  State is the
    runs of blocks that are not complete, the tail of the last block, and the noise of the last blocks.
    """

    def __init__(self, columns: Sequence[str], samples: int, n_chans: int, n_taps: int, n_noise_blocks: int):
        self.columns, self.samples = list(columns), samples
        self.n_chans, self.n_taps, self.n_noise = n_chans, n_taps, n_noise_blocks

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.runs = handle.getMapState("runs", "iter long", "first array<long>, samples array<binary>")
        self.past = handle.getValueState("past", "block long, tail binary, noise binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        done, tail, noise = -1, np.zeros(self.n_chans * self.n_taps, complex), np.zeros((0, self.n_chans))
        if self.past.exists():
            done, *held = self.past.get()
            tail, noise = np.frombuffer(held[0], complex), np.frombuffer(held[1]).reshape(-1, self.n_chans)
        new, late = {}, 0
        for b in rows:
            for number, first, re, im in zip(b["iter"], b["first"], b["re"], b["im"]):
                if number <= done:
                    late += len(re)
                    continue
                new.setdefault(int(number), []).append((int(first), np.asarray(re) + 1j * np.asarray(im)))
        for number, runs in new.items():
            if self.runs.containsKey((number,)):
                first, held = self.runs.getValue((number,))
                runs += [(f, np.frombuffer(x, complex)) for f, x in zip(first, held)]
                new[number] = runs
        while True:
            number = done + 1
            runs = new.pop(number, None)
            if runs is None and self.runs.containsKey((number,)):
                first, held = self.runs.getValue((number,))
                runs = [(f, np.frombuffer(x, complex)) for f, x in zip(first, held)]
            if runs is None or sum(len(x) for _, x in runs) < self.samples:
                if runs is not None:
                    new[number] = runs
                break
            x = np.concatenate([x for _, x in sorted(runs, key=lambda r: r[0])])
            y = block_spectra(tail, x, self.n_chans, self.n_taps)
            p = y.real ** 2 + y.imag ** 2 + 1e-14
            noise = np.concatenate([noise, np.median(p, axis=1)[None]])[-self.n_noise:]
            level = np.median(noise, axis=0)
            tail, done = np.concatenate([tail, x])[-len(tail):], number
            if self.runs.containsKey((number,)):
                self.runs.removeKey((number,))
            yield self._frame(key, number, np.arange(self.n_chans), list(p - level[:, None]), level, 0)
        for number, runs in new.items():
            self.runs.updateValue((number,), ([f for f, _ in runs], [x.tobytes() for _, x in runs]))
        self.past.update((done, tail.tobytes(), noise.tobytes()))
        if late:
            yield self._frame(key, done, [None], [None], [None], late)

    def _frame(self, key, number, channel, power, level, late) -> pd.DataFrame:
        obs, beam = key
        return pd.DataFrame({self.columns[0]: obs, "iter": number, "beam_id": beam, "channel_sample": pd.array(channel, "Int32"),
                             "power": power, "channel_noise": level, "late": late})[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return iter(())

    def close(self) -> None:
        pass


def channel_power_stream(slices: DataFrame, samples: int, n_chans: int, n_taps: int, n_noise_blocks: int = 10,
                         obs: str = "obs_id") -> DataFrame:
    """Stream of ``beam_slices`` to ``(obs, iter, beam_id, channel_sample, power[], channel_noise, late)``.

    A block has ``samples`` samples and blocks count from 0 in each observation; samples of a block
    that has left are counted in a row of their own, without channel and power.  With a source that
    gives whole blocks, all beams of a block leave in the same batch.
    """
    _rocks(slices.sparkSession)
    out = f"{obs} {slices.schema[obs].dataType.simpleString()}, iter long, beam_id int, channel_sample int, power array<double>, " \
          "channel_noise double, late long"
    processor = ChannelPower([c.split()[0] for c in out.split(", ")], samples, n_chans, n_taps, n_noise_blocks)
    return slices.groupBy(obs, "beam_id").transformWithStateInPandas(processor, out, "Append", "None")


def _rocks(spark: SparkSession) -> None:
    """Map state and timers need this store."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != _ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)


def channelise_stream(strips: DataFrame, n_chans: int, n_taps: int, key: str) -> DataFrame:
    """Channeliser on a stream of blocks; state is the tail of the last block of each stream."""
    kind = strips.schema[key].dataType.simpleString()
    tail = n_chans * n_taps

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = np.zeros(tail, complex)
        if state.exists:
            re, im = state.get
            before = np.asarray(re) + 1j * np.asarray(im)
        for row in pd.concat(list(batches), ignore_index=True).sort_values("iter").itertuples(index=False):
            x = np.asarray(row.re) + 1j * np.asarray(row.im)
            y = block_spectra(before, x, n_chans, n_taps)
            before = np.concatenate([before, x])[-tail:]
            yield pd.DataFrame({key: group[0], "iter": row.iter, "channel": np.arange(n_chans, dtype="int32"),
                                "re": list(y.real), "im": list(y.imag)})
        state.update((before.real.tolist(), before.imag.tolist()))

    return strips.groupBy(key).applyInPandasWithState(
        run, f"{key} {kind}, iter long, channel int, re array<double>, im array<double>",
        "re array<double>, im array<double>", "append", GroupStateTimeout.NoTimeout)

"""Flat binary recordings as Spark data sources.

``voltage_raw``: frames of complex numbers (pairs of 32-bit floats, antennas innermost).
``beam_raw``: 32-bit power values ordered (time, channel, beam).

Files of a set (base.dat, base_1.dat, ...) are read in numeric order; each input partition is
a range of whole frames of one file, so reading scales with the bytes, not the files.  Paths go
through pyarrow file systems: local folders and shared stores alike.

With the option ``observations`` each folder below the path is the file set of one observation, named
by the column ``obs_id``.  As a stream, ``voltage_raw`` gives whole blocks as they land; both formats can be
the sink of a stream.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter,
                                    DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual,
                                    InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage)

VOLTAGE_SCHEMA = "iter bigint, sample bigint, re array<float>, im array<float>"
BEAM_SCHEMA = "time_idx bigint, channel int, power array<float>"


def _filesystem(path: str):
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _list(path: str) -> list[tuple[str, int]]:
    """Files of the set in numeric order, with sizes."""
    fs, root = _filesystem(path)
    infos = [i for i in fs.get_file_info(pafs.FileSelector(root)) if i.is_file and i.base_name.endswith(".dat")]

    def number(i):
        m = re.search(r"_(\d+)\.dat$", i.base_name)
        return int(m.group(1)) if m else 0

    return [(i.path, i.size) for i in sorted(infos, key=lambda i: (number(i), i.base_name))]


def _sets(path: str, observations: bool) -> dict[str, list[tuple[str, int]]]:
    """File sets by observation; a flat folder is one set without a name."""
    if not observations:
        return {"": _list(path)}
    fs, root = _filesystem(path)
    folders = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if i.type == pafs.FileType.Directory)
    scheme = path[: len(path) - len(root.lstrip("/"))] if "://" in path else ""
    names = {f.rstrip("/").rsplit("/", 1)[1]: f for f in folders}
    return {n: _list(scheme + f.lstrip("/") if scheme else f) for n, f in names.items() if not n.startswith((".", "_"))}


def _observation(path: str) -> str:
    return path.rsplit("/", 2)[1]


def _flag(options, name: str) -> bool:
    return str(options.get(name, "false")).lower() == "true"


class FrameRanges(InputPartition):
    """Ranges (path, byte offset, first frame, frames) that one task reads."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _FrameReader(DataSourceReader):
    """Splits a file set into ranges of whole frames; bounds on ``bounded`` become frame ranges."""

    frame_bytes, bounded, per_value = 0, "", 1  # column and how many frames one value of it has

    def __init__(self, options):
        self.root = options["path"]
        self.split = int(options.get("splitBytes", 64 << 20))
        self.observations = _flag(options, "observations")
        self.lo, self.hi, self.only = 0, None, None  # frames and the observation kept by pushed filters

    def partitions(self):
        sets = _sets(self.root, self.observations)
        for files in sets.values():
            for path, size in files:
                if size % self.frame_bytes:
                    raise ValueError(f"{path} ends within a frame: {size} bytes, {self.frame_bytes} to a frame")
        return self._ranges({o: (f, self.lo, self.hi) for o, f in sets.items() if self.only in (None, o)})

    def _ranges(self, sets: dict[str, tuple[list[tuple[str, int]], int, int | None]]) -> list[FrameRanges]:
        """Large files are split, small ones packed, so that tasks get about equal bytes."""
        out, pack, load = [], [], 0
        step = max(1, self.split // self.frame_bytes)
        for files, lo, hi in sets.values():
            frame = 0
            for path, size in files:
                n = size // self.frame_bytes
                a, z = max(frame, lo), frame + n if hi is None else min(frame + n, hi)
                for f in range(a, z, step):
                    m = min(step, z - f)
                    if load + m > step and pack:
                        out.append(FrameRanges(pack))
                        pack, load = [], 0
                    pack.append((path, (f - frame) * self.frame_bytes, f, m))
                    load += m
                frame += n
        return [*out, FrameRanges(pack)]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Everything but bounds on the one column, and the one observation, stays with Spark."""
        for f in filters:
            if self.observations and self.only is None and isinstance(f, EqualTo) and f.attribute == ("obs_id",):
                self.only = f.value
                continue
            if getattr(f, "attribute", None) != (self.bounded,) or not isinstance(
                    f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                yield f
                continue
            low = {EqualTo: f.value, GreaterThanOrEqual: f.value, GreaterThan: f.value + 1}.get(type(f))
            top = {EqualTo: f.value + 1, LessThanOrEqual: f.value + 1, LessThan: f.value}.get(type(f))
            if low is not None:
                self.lo = max(self.lo, low * self.per_value)
            if top is not None:
                self.hi = top * self.per_value if self.hi is None else min(self.hi, top * self.per_value)

    def _frames(self, ranges: FrameRanges) -> Iterator[tuple[str, int, np.ndarray]]:
        """(file, first frame, 32-bit floats of the frames) in pieces of bounded size."""
        fs, _ = _filesystem(self.root)
        piece = max(1, (8 << 20) // self.frame_bytes)
        for path, offset, first, n in ranges.ranges:
            with fs.open_input_file(path) as f:
                f.seek(offset)
                for a in range(0, n, piece):
                    m = min(piece, n - a)
                    yield path, first + a, np.frombuffer(f.read(m * self.frame_bytes), dtype="<f4").reshape(m, -1)


class VoltageReader(_FrameReader):
    def __init__(self, options):
        super().__init__(options)
        self.n_ants, self.block = int(options["nants"]), int(options["blocksamples"])
        self.frame_bytes, self.bounded, self.per_value = self.n_ants * 8, "iter", self.block

    def read(self, partition: FrameRanges):
        for path, first, x in self._frames(partition):
            part = x.reshape(len(x), self.n_ants, 2)
            sample = np.arange(first, first + len(part))
            ends = pa.array(np.arange(len(part) + 1, dtype="int32") * self.n_ants)
            columns = {"iter": pa.array(sample // self.block), "sample": pa.array(sample),
                       "re": pa.ListArray.from_arrays(ends, pa.array(part[:, :, 0].ravel())),
                       "im": pa.ListArray.from_arrays(ends, pa.array(part[:, :, 1].ravel()))}
            if self.observations:
                columns = {"obs_id": pa.array([_observation(path)] * len(part)), **columns}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


class VoltageStream(DataSourceStreamReader):
    """Whole blocks of each observation as they land; an offset is the number of blocks given out so far.

    A file set may grow in its last file and by new files, and new observations may appear.  What
    is left of a block waits; blocks already given out are never read again, whatever the restart.
    """

    def __init__(self, options):
        self.reader = VoltageReader(options)
        self.bytes = self.reader.frame_bytes * self.reader.block

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        sets = _sets(self.reader.root, self.reader.observations)
        return {o: n for o, files in sets.items() if (n := sum(size for _, size in files) // self.bytes)}

    def partitions(self, start: dict, end: dict) -> list[FrameRanges]:
        sets, block = _sets(self.reader.root, self.reader.observations), self.reader.block
        return self.reader._ranges({o: (sets[o], start.get(o, 0) * block, n * block) for o, n in end.items() if n > start.get(o, 0)})

    def read(self, partition: FrameRanges):
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Recordings are kept."""


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: where they are and what they are to be called."""

    files: list[tuple[str, str]]


class _Staged(DataSourceArrowWriter):
    """Tasks write under names of their own; files get their names only when the whole job is done."""

    def __init__(self, options, overwrite: bool):
        self.root, self.overwrite = options["path"], overwrite

    def _open(self, fs, root: str, name: str, files: list[tuple[str, str]]):
        files.append((f"{root}/.{name}-{uuid.uuid4().hex}.part", f"{root}/{name}"))
        return fs.open_output_stream(files[-1][0])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        before = {path.rsplit("/", 1)[1] for path, _ in _list(self.root)} if self.overwrite else set()
        for m in messages:
            for part, name in m.files if m else ():
                fs.move(part, name)
                before.discard(name.rsplit("/", 1)[1])
        for name in before:  # only once the new files are there
            fs.delete_file(f"{root}/{name}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, _ = _filesystem(self.root)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


class VoltageWriter(_Staged):
    """One file per group of blocks; rows must arrive sorted with a group in one task."""

    def __init__(self, options, overwrite: bool = False):
        super().__init__(options, overwrite)
        self.group = int(options.get("blocksperfile", 4))

    def write(self, batches) -> WriterCommitMessage:
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        current, out, files = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            number = np.asarray(batch.column("iter")) // self.group
            frames = np.stack([np.asarray(batch.column(c).flatten()) for c in ("re", "im")], axis=-1).astype("<f4")
            frames = frames.reshape(len(number), -1)
            edges = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for a, z in zip(edges, edges[1:]):
                if number[a] != current:
                    if out:
                        out.close()
                    current = number[a]
                    out = self._open(fs, root, f"raw_{current}.dat", files)
                out.write(frames[a:z].tobytes())
        if out:
            out.close()
        return Written(files)


class _StagedStream(DataSourceStreamArrowWriter):
    """A file for each run of consecutive numbers; files get their names when the epoch is committed.

    The names follow from the rows, so an epoch that is written again replaces its own files; one that
    was committed before is dropped.  A task holds its share of an epoch to put it in order.
    """

    stem, order, values = "", (), ()

    def __init__(self, options):
        self.root = options["path"]

    def write(self, batches) -> WriterCommitMessage:
        fs, root = _filesystem(self.root)
        held = [b for b in batches if b.num_rows]
        if not held:
            return Written([])
        fs.create_dir(root, recursive=True)
        table = pa.Table.from_batches(held)
        table = table.sort_by([(c, "ascending") for c in self.order])
        frames = np.stack([np.asarray(table.column(c).combine_chunks().flatten()) for c in self.values], axis=-1).astype("<f4")
        frames = frames.reshape(table.num_rows, -1)
        number = np.asarray(table.column(self.order[0]))
        edges = [0, *(np.flatnonzero(np.diff(number) > 1) + 1), len(number)]
        files = []
        for a, z in zip(edges, edges[1:]):
            files.append((f"{root}/.{self.stem}-{uuid.uuid4().hex}.part", f"{root}/{self.stem}_{number[a]}.dat"))
            with fs.open_output_stream(files[-1][0]) as out:
                out.write(frames[a:z].tobytes())
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, root = _filesystem(self.root)
        done = f"{root}/_epochs/{batchId}"
        fs.create_dir(f"{root}/_epochs", recursive=True)
        if fs.get_file_info(done).type != pafs.FileType.NotFound:
            return self.abort(messages, batchId)
        for m in messages:
            for part, name in m.files if m else ():
                fs.move(part, name)
        with fs.open_output_stream(done):
            pass

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        fs, _ = _filesystem(self.root)
        for m in messages:
            for part, _ in m.files if m else ():
                fs.delete_file(part)


class VoltageStreamWriter(_StagedStream):
    stem, order, values = "raw", ("iter", "sample"), ("re", "im")


class BeamStreamWriter(_StagedStream):
    stem, order, values = "beam", ("time_idx", "channel"), ("power",)


class VoltageRaw(DataSource):
    @classmethod
    def name(cls) -> str:
        return "voltage_raw"

    def schema(self) -> str:
        return ("obs_id string, " if _flag(self.options, "observations") else "") + VOLTAGE_SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return VoltageStream(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return VoltageStreamWriter(self.options)

    def reader(self, schema) -> DataSourceReader:
        return VoltageReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return VoltageWriter(self.options, overwrite)


class BeamReader(_FrameReader):
    def __init__(self, options):
        super().__init__(options)
        self.n_chans, self.n_beams = int(options["nchans"]), int(options["nbeams"])
        self.frame_bytes, self.bounded = self.n_chans * self.n_beams * 4, "time_idx"

    def read(self, partition: FrameRanges):
        for _, first, frames in self._frames(partition):
            m, x = len(frames), frames.reshape(-1, self.n_beams)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(first, first + m), self.n_chans)),
                pa.array(np.tile(np.arange(self.n_chans, dtype="int32"), m)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="int32") * self.n_beams), pa.array(x.ravel()))],
                names=["time_idx", "channel", "power"])


class BeamWriter(_Staged):
    """Writes (time, channel) rows in order; one task writes one file."""

    def write(self, batches) -> WriterCommitMessage:
        fs, root = _filesystem(self.root)
        fs.create_dir(root, recursive=True)
        out, files = None, []
        for batch in batches:
            if batch.num_rows:
                out = out or self._open(fs, root, f"beam_{batch.column('time_idx')[0].as_py()}.dat", files)
                out.write(np.asarray(batch.column("power").flatten()).astype("<f4").tobytes())
        if out:
            out.close()
        return Written(files)


class BeamRaw(DataSource):
    @classmethod
    def name(cls) -> str:
        return "beam_raw"

    def schema(self) -> str:
        return BEAM_SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return BeamStreamWriter(self.options)

    def reader(self, schema) -> DataSourceReader:
        return BeamReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return BeamWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Make both formats known to the session and let filters reach them."""
    spark.dataSource.register(VoltageRaw)
    spark.dataSource.register(BeamRaw)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark

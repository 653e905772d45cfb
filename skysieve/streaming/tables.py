"""Streams that end in tables: metrics, event logs, keyed upserts, subscribers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Condition

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from skysieve.functions.cplx import cabs2
from skysieve.session import cut
from skysieve.sinks.keyed import KeyedTable

REQUEST_SCHEMA = "action string, obs_id bigint, name string, pipeline string, start_s bigint"


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything that has landed, into a Parquet table."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(
        mode).trigger(availableNow=True).start().awaitTermination()


def antenna_metrics(blocks: DataFrame, every: int = 10, watermark: str = "1 minute", window: str = "15 seconds") -> DataFrame:
    """RMS per antenna of every ``every``-th block, per time window with a watermark."""
    b = blocks.where(F.pmod(F.col("iter"), F.lit(every)) == 0).withWatermark("ts", watermark)
    return b.groupBy(F.window("ts", window), "iter", "ant").agg(F.sqrt(F.avg(cabs2("re", "im"))).alias("rms")).select(
        F.col("window.start").alias("ts"), "iter", "ant", "rms")


def parsed_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Create and delete messages from JSON text; unreadable ones drop out."""
    return lines.select(F.from_json(column, REQUEST_SCHEMA).alias("_r"), *[c for c in lines.columns if c != column]).select(
        "_r.*", *[c for c in lines.columns if c != column]).where("action IS NOT NULL")


def upsert_table(stream: DataFrame, path: str, checkpoint: str, key: str, version: str, schema: str,
                 deleted: str | None = "deleted", buckets: int = 16) -> StreamingQuery:
    """Apply a change stream to the keyed table ``path``, read by ``sinks.keyed.KeyedTable``.

    A batch is written into the buckets of its keys; a repeated one changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        KeyedTable(batch.sparkSession, path, key, version, schema, deleted, buckets).apply(batch, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(stream: DataFrame, handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
              kind: str = "event") -> StreamingQuery:
    """Call one handler per event kind on every micro-batch."""

    def fan_out(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for name, handler in handlers.items():
                handler(batch.where(F.col(kind) == name), batch_id)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(fan_out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def detection_stream(powers: DataFrame, path: str, checkpoint: str, detect: Callable[[DataFrame, DataFrame], DataFrame],
                     obs: str = "obs_id") -> StreamingQuery:
    """Whole images of a stream through a batch detector into the table ``path``, a folder per batch.

    ``powers`` is a ``channel_power_stream``; ``detect(pixels, noise)`` gets the blocks that left it together.
    A repeated batch writes its folder again.  Rows that came too late are counted in ``path-late``.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch)
        channel = [obs, "iter", "beam_id", "channel_sample"]
        whole = rows.where("channel_sample IS NOT NULL")
        if not whole.isEmpty():
            pixels = whole.select(*channel, F.posexplode("power").alias("time_idx", "power"))
            detect(pixels, whole.select(*channel, "channel_noise")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        late = rows.where("late > 0").groupBy(obs).agg(F.sum("late").alias("samples"))
        if not late.isEmpty():
            late.write.mode("overwrite").parquet(f"{path}-late/batch={batch_id}")

    return powers.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_log(events: DataFrame) -> DataFrame:
    """Events in the shape of the log table: channels, JSON body, header."""
    body = F.to_json(F.struct(*[c for c in events.columns if c != "event"]))
    return events.select(F.col("event").alias("name"), F.array(F.lit("notifications")).alias("channels"), body.alias("body"),
                         F.when(F.col("event") == "deleted", F.lit("WARNING")).otherwise(F.lit("INFO")).alias("level"))


HEARTBEAT_SCHEMA = "event string, run string, name string, batch_id bigint, ts string, rows double, rows_per_second double"


class Heartbeat(StreamingQueryListener):
    """Appends a row for each start, trigger, idle spell and end of a stream while it runs, a small file each."""

    def __init__(self, path: str):
        self.path, self.open, self.changed = path, set(), Condition()
        self.fs, self.root = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
        self.fs.create_dir(self.root, recursive=True)

    def _append(self, **row) -> None:
        staged = f"{self.root}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as f:
            f.write((json.dumps(row) + "\n").encode())
        self.fs.move(staged, f"{self.root}/{uuid.uuid4().hex}.json")

    def onQueryStarted(self, event) -> None:
        self.open.add(str(event.runId))
        self._append(event="started", run=str(event.runId), name=event.name, ts=event.timestamp)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._append(event="progress", run=str(p.runId), name=p.name, batch_id=p.batchId, ts=p.timestamp, rows=float(p.numInputRows),
                     rows_per_second=float(p.processedRowsPerSecond or 0))

    def onQueryIdle(self, event) -> None:
        self._append(event="idle", run=str(event.runId), ts=event.timestamp)

    def onQueryTerminated(self, event) -> None:
        self._append(event="failed" if event.exception else "ended", run=str(event.runId))
        with self.changed:
            self.open.discard(str(event.runId))
            self.changed.notify_all()

    def settled(self, seconds: float = 30) -> bool:
        """Wait until the ends of all streams that were started have been written."""
        with self.changed:
            return self.changed.wait_for(lambda: not self.open, seconds)


@contextmanager
def heartbeat(spark: SparkSession, path: str) -> Iterator[Heartbeat]:
    """Write the heartbeat of all streams of the session into the table ``path``."""
    listener = Heartbeat(path)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.settled()
    finally:
        spark.streams.removeListener(listener)


def heartbeat_rows(spark: SparkSession, path: str) -> DataFrame:
    """What has been written so far, also while streams run."""
    return spark.read.schema(HEARTBEAT_SCHEMA).json(path)

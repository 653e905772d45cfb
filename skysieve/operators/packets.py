"""Decoding of landed network packets and their ordering."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.operators.sequences import previous, running

# Identifiers of the header items and the accepted mode code.
HEADER_ITEMS = 9
ITEM_IDS = {"magic": 0x5304, "counter": 0x8001, "payload_length": 0x8004, "sync_time": 0x9027, "timestamp": 0x9600,
            "mode": 0xA004, "antenna": 0xA002}
LOW_48 = (1 << 48) - 1


def header_fields(items) -> dict[str, Column]:
    """Header fields of an array of 64-bit items: identifier in the upper 16 bits, value below."""
    items = F.col(items) if isinstance(items, str) else items

    def value(name):
        hit = F.filter(items, lambda x: F.shiftrightunsigned(x, 48) == ITEM_IDS[name])
        return F.get(hit, F.lit(0)).bitwiseAND(F.lit(LOW_48))

    return {
        "counter": value("counter").bitwiseAND(F.lit(0xFFFFFF)),
        "payload_length": value("payload_length"),
        "sync_time": value("sync_time"),
        "packet_ts": value("timestamp"),
        "start_antenna": F.shiftrightunsigned(value("antenna").bitwiseAND(F.lit(0xFF00)), 8),
        "valid": (F.shiftrightunsigned(F.get(items, F.lit(0)), 48) == ITEM_IDS["magic"])
        & (value("mode").bitwiseAND(F.lit(0xEF)) == 7),
    }


def decode_headers(packets: DataFrame, items: str = "items") -> DataFrame:
    """Header fields as columns; packets with a wrong magic or mode are marked invalid."""
    return packets.withColumns(header_fields(items))


def unpack(packets: DataFrame, column: str = "packet") -> DataFrame:
    """Binary packets -> header items (big-endian) and sample values (little-endian 16 bit)."""
    keep = [f for f in packets.schema.fields if f.name != column]
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = HEADER_ITEMS * 8
        for b in batches:
            out = b[names].copy()
            out["items"] = [np.frombuffer(p[:n], ">u8").astype(np.int64) if len(p) >= n else None for p in b[column]]
            out["iq"] = [np.frombuffer(p[n: len(p) - (len(p) - n) % 2], "<i2").astype(np.int32) if len(p) >= n else None
                         for p in b[column]]
            yield out

    from pyspark.sql import types as T

    schema = T.StructType([*keep, T.StructField("items", T.ArrayType(T.LongType())),
                           T.StructField("iq", T.ArrayType(T.IntegerType()))])
    return packets.mapInPandas(run, schema)


def payload_samples(packets: DataFrame, n_signals: int, iq: str = "iq") -> DataFrame:
    """I/Q pairs of a payload (time, antenna, re/im) as one row per sample and antenna."""
    keys = [c for c in packets.columns if c not in (iq, "start_antenna")]
    pairs = packets.select(*keys, "start_antenna", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor(F.size(iq) / 2).cast("int") - 1), lambda k: F.struct(
        F.get(F.col(iq), 2 * k).cast("double").alias("re"), F.get(F.col(iq), 2 * k + 1).cast("double").alias("im")))).alias("_p", "_v"))
    return pairs.select(*keys, F.floor(F.col("_p") / n_signals).alias("sample"),
                        (F.col("_p") % n_signals + F.col("start_antenna")).cast("int").alias("ant"), "_v.re", "_v.im")


def sequence_packets(packets: DataFrame, keys: Sequence[str], arrival: str, bucket: str, counter: str = "counter") -> DataFrame:
    """Absolute packet number across counter roll-overs, and the packets lost before each.

    The counter has 24 bits; it restarts at zero, which adds one to the roll-over count unless
    the stream begins with it.
    """
    keys = list(keys)
    start = packets.groupBy(*keys).agg(F.min_by(counter, arrival).alias("_start"))
    r = running(packets, keys, [arrival], bucket, F.when(F.col(counter) == 0, 1).otherwise(0), "rollovers").join(start, keys)
    r = r.withColumn("rollovers", F.col("rollovers") - F.when(F.col("_start") == 0, 1).otherwise(0)).drop("_start")
    r = r.withColumn("packet_no", F.col(counter) + F.shiftleft(F.col("rollovers").cast("bigint"), 24))
    p = previous(r, keys, [arrival], bucket, {"_before": "packet_no"})
    return p.withColumn("lost", F.coalesce(F.greatest(F.lit(0), F.col("packet_no") - F.col("_before") - 1), F.lit(0))).drop("_before")


def fill_missing(samples: DataFrame, keys: Sequence[str], index: str, values: Sequence[str]) -> DataFrame:
    """Zero rows for the numbers between the first and last one that did not arrive."""
    keys = list(keys)
    ends = samples.groupBy(*keys).agg(F.min(index).alias("_a"), F.max(index).alias("_z"))
    step = 1 << 20
    # long ranges are opened in two steps, so that no single array grows with the data
    blocks = ends.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_a") / step), F.floor(F.col("_z") / step))))
    grid = blocks.withColumn(index, F.explode(F.sequence(
        F.greatest(F.col("_a"), F.col("_b") * step), F.least(F.col("_z"), F.col("_b") * step + step - 1)))).select(*keys, index)
    joined = grid.join(samples, keys + [index], "left")
    return joined.withColumn("present", F.col(values[0]).isNotNull()).withColumns(
        {v: F.coalesce(F.col(v), F.lit(0)) for v in values})

"""A keyed table that is merged on read: buckets of a base, and the batches written since.

A batch is written once, into the buckets its keys fall in.  A reader takes the newest row of each
key from the base and the batches; a bucket's base is written anew only when its batches have
grown to a share of it, so the bytes written follow the changes, not the table.  What belongs to
the table is said by a log with one file per batch, which is written last.
"""

from __future__ import annotations

import json
import re
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

MAX_BATCHES = 32  # of a bucket, read together


class KeyedTable:
    """Rows by ``key`` below ``path``; a batch has the columns of ``schema`` and, if named, a flag for deleted keys.

    Of all changes of a key the one with the highest ``version`` counts, of equal ones that of the later batch,
    so batches may come in any order; deleted keys stay as marks for that reason.  Rows without a key
    are left out.  The number of buckets is kept from the first batch on.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, version: str, schema: str, deleted: str | None = "deleted",
                 buckets: int = 16, share: float = 0.5):
        self.spark, self.path, self.key, self.version = spark, path.rstrip("/"), key, version
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.deleted, self.share = deleted, share
        self.fs, self.root = (pafs.FileSystem.from_uri(self.path) if "://" in path or path.startswith("file:")
                              else (pafs.LocalFileSystem(), self.path))
        state = self.state()
        self.buckets = state["buckets"] if state else buckets

    # --- log
    def _logged(self) -> list[int]:
        infos = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/_log", allow_not_found=True))
        return sorted(int(m.group(1)) for i in infos if (m := re.fullmatch(r"(\d+)\.json", i.base_name)))

    def state(self) -> dict | None:
        """The newest log entry: per bucket the base (number of its batch and rows) and the batches since."""
        known = self._logged()
        if not known:
            return None
        with self.fs.open_input_stream(f"{self.root}/_log/{known[-1]}.json") as f:
            return json.loads(f.read())

    def _log(self, batch: int, state: dict) -> None:
        self.fs.create_dir(f"{self.root}/_log", recursive=True)
        staged = f"{self.root}/_log/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(state).encode())
        self.fs.move(staged, f"{self.root}/_log/{batch}.json")

    # --- reading
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_batch", T.LongType()),
                             T.StructField("_bucket", T.IntegerType())])

    def _files(self, state: dict, buckets: list[int]) -> DataFrame:
        """All rows of some buckets that the log names, as written."""
        paths = []
        for b in buckets:
            held = state["held"].get(str(b))
            if held:
                paths += [f"base/{held['base'][0]}/_bucket={b}"] if held["base"] else []
                paths += [f"batch/{n}/_bucket={b}" for n, _ in held["batches"]]
        stored = self._stored()
        if not paths:
            return self.spark.createDataFrame([], stored)
        read = self.spark.read.schema(T.StructType(stored.fields[:-1])).parquet(*[f"{self.path}/{p}" for p in paths])
        return read.withColumn("_bucket", self._bucket())

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (self.key, "_bucket")]
        return rows.groupBy("_bucket", self.key).agg(F.max_by(F.struct(*rest), F.struct(self.version, "_batch")).alias("_r")).select(
            self.key, *[F.col("_r").getField(c).alias(c) for c in rest], "_bucket")

    def read(self, keys: list | None = None) -> DataFrame:
        """The table as of the newest batch; for given ``keys`` only their buckets are read."""
        state = self.state()
        columns = [f.name for f in self.schema.fields]
        if state is None:
            return self.spark.createDataFrame([], self.schema)
        wanted = list(range(self.buckets))
        if keys is not None:
            of = self.spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField(self.key, self.schema[self.key].dataType)]))
            wanted = sorted({r["b"] for r in of.select(self._bucket().alias("b")).collect()})
        rows = self._newest(self._files(state, wanted)).where("NOT _deleted").select(*columns)
        return rows if keys is None else rows.where(F.col(self.key).isin(keys))

    # --- writing
    def apply(self, changes: DataFrame, batch: int) -> None:
        """Take in a batch; one that the log knows is skipped, an unfinished one is written again."""
        if batch in self._logged():
            return
        state = self.state() or {"buckets": self.buckets, "held": {}}
        columns = [f.name for f in self.schema.fields]
        gone = F.coalesce(F.col(self.deleted), F.lit(False)) if self.deleted else F.lit(False)
        rest = [c for c in columns if c != self.key]
        rows = changes.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.max_by(F.struct(*rest, gone.alias("_deleted")), F.col(self.version)).alias("_r")).select(
            F.col(self.key), *[F.col("_r").getField(c).alias(c) for c in (*rest, "_deleted")])
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields], "_deleted",
                           F.lit(batch).cast("long").alias("_batch"), self._bucket().alias("_bucket"))
        at = f"{self.path}/batch/{batch}"
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
        sizes = self._sizes(at)
        for b, n in sizes.items():
            held = state["held"].setdefault(str(b), {"base": None, "batches": []})
            held["batches"].append([batch, n])
        full = [b for b in sizes if self._full(state["held"][str(b)])]
        if full:
            at = f"{self.path}/base/{batch}"
            merged = self._newest(self._files(state, full)).select(*[f.name for f in self._stored().fields])
            merged.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(at)
            sizes = self._sizes(at)
            for b in full:
                state["held"][str(b)] = {"base": [batch, sizes[b]] if b in sizes else None, "batches": []}
        self._log(batch, state)

    def _sizes(self, at: str) -> dict[int, int]:
        rows = self.spark.read.schema(self._stored()).parquet(at).groupBy("_bucket").count().collect()
        return {r["_bucket"]: r["count"] for r in rows}

    def _full(self, held: dict) -> bool:
        """Whether what has come beside the largest part, base or batch, has grown to a share of it."""
        sizes = [n for _, n in held["batches"]] + ([held["base"][1]] if held["base"] else [])
        largest = max(sizes)
        return len(sizes) > 1 and (sum(sizes) - largest >= self.share * largest or len(held["batches"]) > MAX_BATCHES)

    def vacuum(self) -> None:
        """Delete what the newest log entry does not name; not while an older state is still being read."""
        state, known = self.state(), self._logged()
        if state is None:
            return
        live = {("base", str(h["base"][0]), b) for b, h in state["held"].items() if h["base"]} | {
            ("batch", str(n), b) for b, h in state["held"].items() for n, _ in h["batches"]}
        for kind in ("base", "batch"):
            for folder in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/{kind}", allow_not_found=True)):
                for part in self.fs.get_file_info(pafs.FileSelector(folder.path)):
                    b = part.base_name.removeprefix("_bucket=")
                    if part.type == pafs.FileType.Directory and int(folder.base_name) <= known[-1] and (
                            kind, folder.base_name, b) not in live:
                        self.fs.delete_dir(part.path)

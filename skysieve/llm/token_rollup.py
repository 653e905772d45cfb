"""Token counts as rollups that batches of signed changes keep up to date.

A store is a folder.  Each batch has its changes (``inputs``), the signed rows they make of each
document (``changes``) and the sums of those by source, language and tokenizer version (``deltas``);
totals are the sum of all deltas.  Every few batches the rows of all documents are kept as
``state``, so that a commit reads one state and the batches after it, not the whole history.  All
of these are folders with names of their own, and the ``log`` names those that count: a commit
shows with its log entry, which is written last, and one that breaks off leaves the store as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from skysieve.llm import tokens
from skysieve.llm.text import filtered_scans, n_words, whole
from skysieve.session import cut, scratch_path

WORDS, BYTE_BPE = "words-1", "byte_bpe_50k-1"
_KEY = ["doc_id", "tokenizer"]
_GROUP = ["source", "lang", "tokenizer"]
_INPUTS = "doc_id long, tokenizer string, sets boolean, n long, source string, lang string"
_CHANGES = "doc_id long, tokenizer string, source string, lang string, docs long, tokens long"


def counted(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """``(doc_id, source, lang, tokenizer, n_tokens)``: two rows a document, words and BPE ids of the whole text."""
    file = path or tokens.default_path()

    def bpe(texts: pd.Series) -> pd.Series:
        ids = tokens.encoder(file).ids
        return pd.Series([len(ids(t)) for t in texts], dtype="int64")

    both = docs.select("doc_id", "source", "lang", n_words(whole(text)).alias(WORDS),
                       F.pandas_udf(bpe, "long")(whole(text)).alias(BYTE_BPE))
    return both.unpivot(["doc_id", "source", "lang"], [WORDS, BYTE_BPE], "tokenizer", "n_tokens")


class Rollup:
    """A store of token totals in a folder that all executors reach; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, state_every: int = 16):
        self.spark, self.folder, self.state_every = spark, folder.rstrip("/"), state_every

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _log(self) -> tuple[int, dict[int, dict[str, str]]]:
        """Number of the last entry and what it says: the folders of each batch by kind."""
        path, fs = self._path("log")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        last = max((int(n[:-5]) for n in names if n.endswith(".json")), default=0)
        if not last:
            return 0, {}
        text = self.spark.read.text(f"{self.folder}/log/{last:012d}.json", wholetext=True).first()[0]
        return last, {int(b): parts for b, parts in json.loads(text).items()}

    def _publish(self, entry: int, log: dict[int, dict[str, str]]) -> None:
        path, fs = self._path(f"log/{entry:012d}.json")
        draft, _ = self._path(f"log/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(log).encode()))
        out.close()
        if fs.exists(path) or not fs.rename(draft, path):
            raise RuntimeError(f"another commit has written entry {entry}")

    def _write(self, kind: str, df: DataFrame) -> str:
        name = f"{kind}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        return name

    def _read(self, names: Iterable[str], schema: str) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in names]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _documents(self, log: dict[int, dict[str, str]], before: int) -> DataFrame:
        """Signed rows that make up the documents as they were before a batch."""
        base = max((b for b in log if b < before and "state" in log[b]), default=None)
        after = [log[b]["changes"] for b in sorted(log) if b < before and (base is None or b > base)]
        return self._read(([] if base is None else [log[base]["state"]]) + after, _CHANGES)

    @staticmethod
    def _summed(signed: DataFrame) -> DataFrame:
        return signed.groupBy("doc_id", *_GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where(
            "docs <> 0").select("doc_id", "tokenizer", "source", "lang", "docs", "tokens")

    def _derive(self, batch: int, log: dict[int, dict[str, str]]) -> None:
        """Signed rows and deltas of a batch from its input and the batches before it."""
        new = self._read([log[batch]["inputs"]], _INPUTS)
        same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in _KEY]
        touched = self._documents(log, batch).alias("o").join(new.select(*_KEY).alias("n"), same[0] & same[1], "left_semi")
        gone = self._summed(touched).withColumns({"docs": -F.col("docs"), "tokens": -F.col("tokens")})
        come = new.where("sets").select(*_KEY, "source", "lang", F.lit(1).cast("long").alias("docs"), F.col("n").alias("tokens"))
        log[batch]["changes"] = self._write("changes", gone.unionByName(come))
        log[batch]["deltas"] = self._write("deltas", self._read([log[batch]["changes"]], _CHANGES).groupBy(*_GROUP).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")))
        base = max((b for b in log if "state" in log[b]), default=None)
        if sum(base is None or b > base for b in log) >= self.state_every:
            log[batch]["state"] = self._write("state", self._summed(self._documents(log, batch + 1)))

    def commit(self, batch: int, changes: DataFrame) -> None:
        """Apply ``changes(op, doc_id, source, lang, tokenizer, n_tokens)`` as batch number ``batch``.

        ``op`` is ``insert``, ``revise`` (both set a document's count, whatever it was) or
        ``delete``, which needs ``doc_id`` and ``tokenizer`` only; other values are an error.
        Deleting what is not there changes nothing.  Of several changes to one document in a
        batch an insert or revision with the largest count wins, deletes come first.  A null id or
        tokenizer is one like any other; null sources, languages and counts (0) are kept apart as null.

        Batches count in the order of their numbers, whatever the order of commits: a batch that
        comes late, or again with other content, has the later ones derived anew from their inputs.
        """
        known = F.when(F.col("op").isin("insert", "revise", "delete"), F.col("op")).otherwise(
            F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))))
        order = F.struct((F.col("op") != "delete").alias("sets"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"),
                         "source", "lang")
        new = changes.withColumn("op", known).groupBy(*_KEY).agg(F.max(order).alias("new")).select(*_KEY, "new.*")
        entry, log = self._log()
        log[batch] = {"inputs": self._write("inputs", new)}
        later = sorted(b for b in log if b >= batch)
        for b in later:
            log[b] = {"inputs": log[b]["inputs"]}
        for b in later:
            self._derive(b, {x: parts for x, parts in log.items() if x <= b})
        self._publish(entry + 1, log)

    def totals(self) -> DataFrame:
        """``(source, lang, tokenizer, n_docs, n_tokens)`` of all batches; groups without documents are gone."""
        deltas = [parts["deltas"] for parts in self._log()[1].values()]
        return self._read(deltas, "source string, lang string, tokenizer string, docs long, tokens long").groupBy(*_GROUP).agg(
            F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after three batches: all documents; toxic ones deleted; poor ones counted anew without repeated lines."""
    store = Rollup(docs.sparkSession, scratch_path(docs.sparkSession, "token-rollup"))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    store.commit(1, counted(docs).withColumn("op", F.lit("insert")))
    both = F.explode(F.array(F.lit(WORDS), F.lit(BYTE_BPE))).alias("tokenizer")
    gone = docs.select("doc_id").join(known.where("toxic = 1"), "doc_id").select(
        F.lit("delete").alias("op"), "doc_id", F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"),
        both, F.lit(None).cast("long").alias("n_tokens"))
    store.commit(2, gone)
    # any id passes the last condition; with it Spark takes the side for selective and filters the scan by it
    ids = cut(known.where("quality = 0 AND coalesce(toxic, 0) <> 1").select("doc_id"), "poor").where(F.col("doc_id") >= -(1 << 63))
    poor = docs.select("doc_id", "source", "lang", "text").join(ids, "doc_id")
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    with filtered_scans(docs.sparkSession):  # texts of other documents are not shuffled
        store.commit(3, counted(poor.withColumn("text", lines)).withColumn("op", F.lit("revise")))
    return store.totals()

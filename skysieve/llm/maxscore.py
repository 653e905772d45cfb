"""Exact ranked search by MaxScore with bounds of term pairs.

An index holds, shard by shard, the documents and counts of each term.  For a set of queries the
lists of their terms are packed into one row a shard, together with lists of term pairs: how many
documents have both terms, the largest sum of their impacts, and the documents nearest to it.  A
search sorts a query's terms by weight; the bound of its lightest terms is the best combination of
single maxima and pair maxima, which is lower than the sum of single maxima wherever two terms
do not reach their maxima in the same document.  Only the other terms' lists propose documents.
"""

from __future__ import annotations

import math
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, Window, functions as F

from skysieve.llm.text import filtered_scans, whole
from skysieve.session import cut

TOP = 50
_POSTINGS = 2_000_000  # of a shard
_TERMS = 200_000  # of the queries searched together: what the driver holds and sends
_SEEDS = 8  # shards that are searched first for a threshold
_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n", pa.int64()), ("words", pa.int64()),
                    ("places", pa.binary()), ("counts", pa.binary()), ("nulls", pa.int64())])
_PACKED = pa.schema([("shard", pa.int64()), ("size", pa.int32()), ("nulls", pa.int32()), *((n, pa.binary()) for n in (
    "ids", "terms", "ends", "places", "impacts", "tops", "pairs", "joint", "shared", "near", "near_ends"))])


def terms(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of bytes above ASCII, A-Z in lower case."""
    return (text or b"").translate(_KEEP).split()


def build(docs: DataFrame) -> DataFrame:
    """Index rows ``(shard, term, n, words, places, counts, nulls)``; the row without a term describes the shard.

    A shard is a run of documents of one task.  ``places`` are 32-bit numbers of its documents in order
    of their ids, the ``nulls`` ones without an id last; the shard's row has ids and lengths instead.
    Documents without a term are in no shard.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 24
        numbers: dict[bytes, int] = {}
        term_of, place, count, sizes, ids = array("i"), array("i"), array("i"), array("i"), []

        def rows(part: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*part), _INDEX)], schema=_INDEX)

        def close() -> Iterator[pa.RecordBatch]:
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            t, c = np.frombuffer(term_of, np.int32), np.frombuffer(count, np.int32)
            p = rank[np.frombuffer(place, np.int32)]
            by_term = np.argsort(t.astype(np.int64) << 32 | p, kind="stable")
            t, p, c = t[by_term], p[by_term].astype("<i4"), c[by_term].astype("<i4")
            length = np.frombuffer(sizes, np.int32)[order].astype("<i4")
            yield rows([(shard, None, len(ids), int(length.sum(dtype=np.int64)),
                         np.array([ids[i] or 0 for i in order], "<i8").tobytes(), length.tobytes(), sum(i is None for i in ids))])
            ends = np.searchsorted(t, np.arange(len(numbers) + 1)).tolist()
            words = list(numbers)
            for a in range(0, len(words), 10_000):
                yield rows([(shard, w, y - x, 0, p[x:y].tobytes(), c[x:y].tobytes(), 0) for w, x, y in zip(
                    words[a:a + 10_000], ends[a:], ends[a + 1:])])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Counter(terms(text))
                if not found:
                    continue
                term_of.extend([numbers.setdefault(w, len(numbers)) for w in found])
                count.extend(found.values())
                place.extend([len(ids)] * len(found))
                sizes.append(found.total())
                ids.append(doc)
                if len(term_of) >= _POSTINGS:
                    yield from close()
                    shard += 1
                    numbers, ids = {}, []
                    term_of, place, count, sizes = array("i"), array("i"), array("i"), array("i")
        if ids:
            yield from close()

    return docs.select(F.col("doc_id").cast("long"), whole().cast("binary").alias("text")).mapInArrow(
        run, "shard long, term binary, n long, words long, places binary, counts binary, nulls long")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def impacts(tf: np.ndarray, length: np.ndarray, n: int, words: int) -> np.ndarray:
    """A term's share of the score, before its weight, for counts in documents of the given lengths."""
    if 50 * n * int(length.max(initial=0)) < 1 << 63:
        m = 50 + 50 * length.astype(np.int64) * n // words
    else:
        m = np.array([50 + 50 * int(x) * n // words for x in length], np.int64)
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


@dataclass(frozen=True)
class Queries:
    """A block of queries: ids, numbers of their terms in rising weight, the terms' weights, adjacent pairs."""

    ids: list[int | None]
    chains: list[np.ndarray]
    weights: np.ndarray
    pairs: np.ndarray = attribute(init=False)  # sorted codes a * terms + b
    links: list[np.ndarray] = attribute(init=False)  # of each query, places of its pairs

    def __post_init__(self) -> None:
        codes = [c[:-1].astype(np.int64) * len(self.weights) + c[1:] for c in self.chains]
        pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        object.__setattr__(self, "pairs", pairs)
        object.__setattr__(self, "links", [np.searchsorted(pairs, c) for c in codes])


@dataclass
class Shard:
    """The queries' terms and pairs in one shard; ``ends`` has a place for each term of the block, also absent ones."""

    size: int
    ids: np.ndarray
    nulls: int
    ends: np.ndarray
    places: np.ndarray
    impacts: np.ndarray
    tops: np.ndarray
    joint: np.ndarray
    near: np.ndarray
    near_ends: np.ndarray
    work: int = 0  # postings looked at

    def list_of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.ends[term], self.ends[term + 1]
        return self.places[a:b], self.impacts[a:b]


def pair_lists(shard: Shard, queries: Queries, k: int) -> tuple[np.ndarray, ...]:
    """For each pair: the largest joint impact, the number of documents with both terms, the ``k`` best of them."""
    at, scale = np.zeros(shard.size, np.int64), queries.weights
    joint, shared = np.zeros(len(queries.pairs), np.int64), np.zeros(len(queries.pairs), np.int32)
    near, before = [], -1
    for i, code in enumerate(queries.pairs.tolist()):
        a, b = divmod(code, len(scale))
        places, values = shard.list_of(a)
        if a != before:
            at[:] = 0
            at[places] = values * scale[a] + 1  # one more than the impact, for terms of weight zero
            before = a
        other, values = shard.list_of(b)
        both = np.flatnonzero(at[other]) if len(places) else np.zeros(0, np.int64)
        sums = at[other[both]] - 1 + values[both] * scale[b]
        shared[i] = len(both)
        if len(both):
            joint[i] = sums.max()
            if len(both) > k:
                both = both[np.argpartition(-sums, k - 1)[:k]]
        near.append(other[both].astype(np.int32))
    return joint, shared, np.concatenate([np.zeros(0, np.int32), *near]), np.cumsum([0, *map(len, near)])


def bounds(tops: Sequence[int], joint: Sequence[int]) -> np.ndarray:
    """Upper bounds of the first 0, 1, 2, ... terms together, from single maxima and maxima of adjacent pairs.

    Two terms of a pair reach at most the joint maximum, or one of them its own.  The best choice
    of disjoint pairs in a chain is found term by term.
    """
    out = [0]
    for i, top in enumerate(tops):
        least = out[-1] + top
        if i:
            least = min(least, out[-2] + max(tops[i - 1], top, joint[i - 1]))
        out.append(least)
    return np.array(out, np.int64)


def search(shard: Shard, queries: Queries, q: int, threshold: int, first: np.ndarray | None = None,
           pairwise: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of all documents that reach ``threshold`` (at least 1), among ``first`` only if given."""
    chain = queries.chains[q]
    tops = (shard.tops[chain] * queries.weights[chain]).tolist()
    joint = shard.joint[queries.links[q]].tolist() if pairwise else [1 << 62] * len(tops)
    bound = bounds(tops, joint)
    acc = np.zeros(shard.size, np.int64)
    if first is None:
        low = int(np.searchsorted(bound, threshold)) - 1  # bounds rise; these terms alone stay below
        for t in chain[low:]:
            places, values = shard.list_of(t)
            acc[places] += values * queries.weights[t]
            shard.work += len(places)
        found = np.flatnonzero(acc)
    else:
        low, found = len(chain), first
    for i in range(low - 1, -1, -1):
        found = found[acc[found] + bound[i + 1] >= threshold]
        if not len(found):
            break
        places, values = shard.list_of(chain[i])
        if len(places):
            at = np.minimum(np.searchsorted(places, found), len(places) - 1)
            hit = places[at] == found
            acc[found[hit]] += values[at[hit]] * queries.weights[chain[i]]
            shard.work += len(found)
    found = found[acc[found] >= threshold]
    return found, acc[found]


def best_of(score: np.ndarray, null: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best: highest score, then lowest id, null last."""
    return np.lexsort((doc, null, -score))[:k]


def _packing(queries: Queries, n: int, words: int, k: int):
    """One row a shard from index rows sorted by shard and number, the shard's own row first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, numbers, lists = None, [], []

        def close() -> Iterator[pa.RecordBatch]:
            if head is None or not numbers:
                return
            number, size, ids, lengths, nulls = head
            length = np.frombuffer(lengths, "<i4")
            p = np.concatenate([np.frombuffer(x, "<i4") for x, _ in lists])
            value = impacts(np.concatenate([np.frombuffer(x, "<i4") for _, x in lists]), length[p], n, words)
            counts = np.zeros(len(queries.weights) + 1, np.int64)
            counts[np.array(numbers) + 1] = [len(x) // 4 for x, _ in lists]
            ends = np.cumsum(counts)
            tops = np.zeros(len(queries.weights), np.int64)
            tops[numbers] = np.maximum.reduceat(value, ends[numbers])
            none = np.zeros(0, np.int64)
            shard = Shard(size, none, nulls, ends, p, value, tops, none, none, none)
            joint, shared, near, near_ends = pair_lists(shard, queries, k)
            row = (number, size, nulls, ids, np.array(numbers, "<i4").tobytes(), ends[np.array(numbers) + 1].astype("<i8").tobytes(),
                   p.astype("<i4").tobytes(), value.astype("<i4").tobytes(), tops[numbers].astype("<i4").tobytes(),
                   np.flatnonzero(shared).astype("<i4").tobytes(), joint[shared > 0].astype("<i8").tobytes(),
                   shared[shared > 0].astype("<i4").tobytes(), near.astype("<i4").tobytes(), near_ends.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _PACKED)], schema=_PACKED)

        for batch in batches:
            for s, number, size, places, counts, nulls in zip(*(c.to_pylist() for c in batch.columns)):
                if number is None:
                    yield from close()
                    head, numbers, lists = (s, size, places, counts, nulls), [], []
                else:
                    numbers.append(number)
                    lists.append((places, counts))
        yield from close()

    return run


def _unpack(row: dict, queries: Queries) -> Shard:
    def of(name: str, kind: str = "<i4") -> np.ndarray:
        return np.frombuffer(row[name], kind)

    held = of("terms")
    counts, tops = np.zeros(len(queries.weights) + 1, np.int64), np.zeros(len(queries.weights), np.int64)
    counts[held + 1] = np.diff(of("ends", "<i8"), prepend=0)
    tops[held] = of("tops")
    joint = np.zeros(len(queries.pairs), np.int64)
    joint[of("pairs")] = of("joint", "<i8")
    return Shard(row["size"], of("ids", "<i8"), row["nulls"], np.cumsum(counts), of("places"), of("impacts").astype(np.int64), tops,
                 joint, of("near").astype(np.int64), of("near_ends", "<i8"))


def _searching(sent, k: int, least: np.ndarray):
    """The ``k`` best documents of each query in a task's shards, thresholds carried from shard to shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Queries = sent.value
        none = (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))
        best = [none] * len(queries.ids)
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _unpack({n: batch.column(n)[i].as_py() for n in _PACKED.names}, queries)
                null = np.arange(shard.size) >= shard.size - shard.nulls
                for q in range(len(best)):
                    full = len(best[q][0]) == k
                    threshold = max(int(least[q]), int(best[q][0][-1]) if full else 1, 1)
                    if threshold == 1 and len(queries.links[q]):  # documents of pairs give a first threshold
                        near = np.unique(np.concatenate([shard.near[shard.near_ends[p]:shard.near_ends[p + 1]] for p in queries.links[q]]))
                        _, scores = search(shard, queries, q, 1, near)
                        if len(scores) >= k:
                            threshold = max(int(np.partition(scores, -k)[-k]), 1)
                    found, scores = search(shard, queries, q, threshold)
                    if len(found):
                        all_of = [np.concatenate(x) for x in zip(best[q], (scores, null[found], shard.ids[found]))]
                        kept = best_of(*all_of, k)
                        best[q] = tuple(x[kept] for x in all_of)
        for q, (score, null, doc) in enumerate(best):
            if len(score):
                yield pa.RecordBatch.from_arrays([
                    pa.array([q] * len(score), pa.int32()), pa.array([queries.ids[q]] * len(score), pa.int64()),
                    pa.array(doc, pa.int64(), mask=null), pa.array(score, pa.int64())], ["query", "item_id", "doc_id", "score"])

    return run


def _block(rows: list[Row], n: int) -> tuple[Queries, list[bytes]]:
    """A block of queries from rows ``(item_id, term, df)``, and its terms in order of their numbers."""
    df = {bytes(r["term"]): r["df"] for r in rows}
    words = sorted(df)
    number = {w: i for i, w in enumerate(words)}
    weights = np.array([weight(n, df[w]) for w in words], np.int64)
    held: dict[int | None, list[int]] = {}
    for r in rows:
        held.setdefault(r["item_id"], []).append(number[bytes(r["term"])])
    ids = sorted(held, key=lambda x: (x is None, x or 0))
    return Queries(ids, [np.array(sorted(held[i], key=lambda t: (weights[t], t)), np.int32) for i in ids], weights), words


def top_k(index: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents with a score above 0 of each item.

    ``index`` is a written index, items are ``(item_id, text)``.  Rows of one item id are one query,
    null is an id like any other.  Equal scores go by ``doc_id``, null last; repeated documents are
    documents of their own.  Items and documents without a term, or with null texts, have no rows.
    Queries are searched in blocks of about ``_TERMS`` terms, each block against all shards.
    """
    spark = index.sparkSession
    n, words = (x or 0 for x in index.where("term IS NULL").agg(F.sum("n"), F.sum("words")).first())

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, w) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in set(terms(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                             ["item_id", "term"])

    asked = cut(items.select(F.col("item_id").cast("long"), whole().cast("binary").alias("text")).mapInArrow(
        spelled, "item_id long, term binary").distinct(), "query-terms")
    held = index.where("term IS NOT NULL")
    df = held.select("term", "n").join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(
        F.sum("n").alias("df"))
    asked = cut(asked.join(df, "term"), "weighed-terms")
    blocks = -(-asked.count() // _TERMS)
    found = None
    for b in range(blocks):
        queries, names = _block(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect(), n)
        if not queries.ids:
            continue
        numbers = spark.createDataFrame([(i, w) for i, w in enumerate(names)], "number int, term binary")
        with filtered_scans(spark):  # lists of other terms are not shuffled
            lists = held.join(numbers, "term").select("shard", "number", "n", "places", "counts", "nulls")
            heads = index.where("term IS NULL").select("shard", F.lit(None).cast("int").alias("number"), "n", "places", "counts", "nulls")
            packed = cut(lists.unionByName(heads).repartition("shard").sortWithinPartitions("shard", F.asc_nulls_first("number")).mapInArrow(
                _packing(queries, n, words, k), "shard long, size int, nulls int, " + ", ".join(
                    f"{x} binary" for x in _PACKED.names[3:])), "packed-shards")
        sent = spark.sparkContext.broadcast(queries)  # about _TERMS numbers
        least = np.zeros(len(queries.ids), np.int64)
        schema = "query int, item_id long, doc_id long, score long"
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        # the k-th best score in any few shards is a lower bound of that in all
        seeds = [r["shard"] for r in packed.select("shard").orderBy(F.xxhash64("shard")).limit(_SEEDS).collect()]
        some = packed.where(F.col("shard").isin(seeds)).mapInArrow(_searching(sent, k, least), schema)
        for r in some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query", "score").collect():
            least[r["query"]] = r["score"]
        part = cut(packed.mapInArrow(_searching(sent, k, least), schema), "shard-results").withColumn(
            "rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The 50 best documents of each item."""
    return top_k(cut(build(docs), "index"), items)

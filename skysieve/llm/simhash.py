"""Near-duplicates by SimHash fingerprints in a Gray-order hierarchical index.

Two fingerprints that differ in few bits agree on at least one of a few bit segments, so an
index is split into shards by segment; shards that are too large are split again by segments
of the bits that are left.  A task sorts a shard by Gray rank and builds a tree over runs of
neighbours: a node holds the bits its members share and its parent does not, and a search adds
up differences on the way down and leaves a node, with all below it, once they are too many.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm.text import boxed, field, filtered_scans, unboxed, whole
from skysieve.operators.graph import connected_components, local_components
from skysieve.session import cut

_SHARD = 8192  # fingerprints searched as one tree
_ROWS = 1 << 18  # rows of small shards searched together
_PAIRS = 1 << 21  # pairs compared at once
_FAN = 8
_BITS = 1024  # of a parity bitmap
_WINDOWS = ((0, 16), (16, 256), (256, 1 << 62))  # places of partners tried in one round


# fingerprints ---------------------------------------------------------------------------------

def shingle_hashes(text: str, n: int) -> np.ndarray:
    """XXH64 of each run of ``n`` words in ASCII lower case; of all words if there are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= n:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    m, digest = len(words) - n + 1, xxhash.xxh64_intdigest
    spans = zip((ends - sizes)[:m].tolist(), ends[n - 1:].tolist())
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def simhash(hashes: np.ndarray) -> np.uint64:
    """A bit is 1 if it is set in over half of the hashes; 0 without any."""
    votes = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[a:a + (1 << 16)]).astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", name: str = "fp") -> DataFrame:
    """``docs`` with the fingerprint of the whole text as a long; null and empty texts have 0."""
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(shingle_hashes(t, shingle)) for t in texts], np.uint64).view(np.int64))

    return unboxed(boxed(docs), docs.columns, {name: F.pandas_udf(run, "long")(whole(field(text)))})


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in Gray order, in which neighbours differ in one bit."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


# index ----------------------------------------------------------------------------------------

class Tree:
    """Hierarchical index of sorted fingerprints, one tree for each group of equal ``gid``."""

    def __init__(self, fp: np.ndarray, gid: np.ndarray):
        self.fp, self.levels = fp, []
        ones = np.full(len(fp), ~np.uint64(0))
        shared, pattern, group = ones, fp, gid  # members share all their bits
        while True:
            first = np.concatenate([[True], group[1:] != group[:-1]])
            starts = np.flatnonzero(first)
            within = np.arange(len(group)) - starts[np.cumsum(first) - 1]
            heads = np.flatnonzero(first | (within % _FAN == 0))
            low, high = np.bitwise_and.reduceat(pattern, heads), np.bitwise_or.reduceat(pattern, heads)
            common = np.bitwise_and.reduceat(shared, heads) & ~(low ^ high)
            parent = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(group))))
            self.levels.append((shared & ~common[parent], pattern, heads, np.diff(np.append(heads, len(group)))))
            shared, pattern, group = common, low, group[heads]
            if len(np.unique(group)) == len(group):
                break
        self.roots = {"shared": shared, "pattern": pattern, "gid": group}

    def search(self, query: np.ndarray, root: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, later member) at most ``most`` bits apart; ``root`` is each query's tree."""
        q, node = query, root
        difference = np.bitwise_count((self.fp[q] ^ self.roots["pattern"][node]) & self.roots["shared"][node]).astype(np.int64)
        for mask, pattern, heads, count in reversed(self.levels):
            n = count[node]
            q, difference = np.repeat(q, n), np.repeat(difference, n)
            node = np.repeat(heads[node] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            difference += np.bitwise_count((self.fp[q] ^ pattern[node]) & mask[node])
            near = difference <= most
            q, node, difference = q[near], node[near], difference[near]
        later = node > q
        return q[later], node[later]


def _links(fp: np.ndarray, gid: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join every fingerprint to the first one it is linked with, directly or not."""
    size = np.bincount(gid)
    keep = size[gid] > 1
    fp, gid = fp[keep], gid[keep]
    if not len(fp):
        return fp, fp
    tree = Tree(fp, gid)
    root_of = np.zeros(int(gid.max()) + 1, np.int64)
    root_of[tree.roots["gid"]] = np.arange(len(tree.roots["gid"]))
    work, label = np.cumsum(size[gid]), np.arange(len(fp))
    start = 0
    while start < len(fp):
        stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + _PAIRS, "right")))
        q = np.arange(start, stop)
        a, b = tree.search(q, root_of[gid[q]], most)
        a, b = label[a], label[b]
        new = a != b
        if new.any():
            label = local_components(len(fp), a[new], b[new])[label]
        start = stop
    far = label != np.arange(len(fp))
    return fp[far], fp[label[far]]


def _segments(bits: Sequence[int], n: int) -> list[int]:
    """``n`` masks that share out the given bit places evenly."""
    return [sum(1 << b for b in part.tolist()) for part in np.array_split(np.array(bits), n)]


def _by_group(search: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]], n_keys: int):
    """Run ``search`` on columns of whole groups; rows come sorted by their first ``n_keys`` columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            if len(held[0]) < _ROWS:
                continue
            same = np.ones(len(held[0]), bool)
            for c in held[:n_keys]:
                same &= c == c[-1]
            done = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if done:
                yield from search([c[:done] for c in held])
                held = [c[done:] for c in held]
        if held is not None and len(held[0]):
            yield from search(held)

    return run


def _group_ids(keys: Sequence[np.ndarray]) -> np.ndarray:
    change = np.zeros(len(keys[0]), bool)
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.cumsum(change)


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """``(src, dst)``: enough links of at most ``most`` bits to connect all that are connected.

    ``fps`` has distinct longs ``fp``.  Groups in a shard stay below a fixed size: bits that are
    not yet fixed are shared out again among larger ones, so at worst a shard is all numbers of
    a few bits.
    """
    def search(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b = _links(cols[2].view(np.uint64), _group_ids(cols[:2]), most)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    def signed(mask: int) -> int:
        return mask - (1 << 64) if mask >> 63 else mask

    masks = {i: m for i, m in enumerate(_segments(range(64), most + 1))}  # path of segments -> bits fixed
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("path"), F.lit(signed(m)).alias("mask"))
                                                for p, m in masks.items()])).alias("s"))
    found = None
    while True:
        rows = rows.select("s.path", F.col("fp").bitwiseAND(F.col("s.mask")).alias("pattern"), "fp")
        splits = {p: _segments([b for b in range(64) if not m >> b & 1], most + 1) for p, m in masks.items()}
        splits = {p: s for p, s in splits.items() if min(x.bit_count() for x in s) > 1}
        large = cut(rows.groupBy("path", "pattern").count().where(F.col("count") > _SHARD), "large-shards")
        more = bool(splits) and not large.isEmpty()
        small = rows.join(large, ["path", "pattern"], "left_anti") if more else rows
        placed = small.repartition("path", "pattern").withColumn("_rank", gray_rank(F.col("fp"))).sortWithinPartitions(
            "path", "pattern", "_rank").drop("_rank")
        edges = placed.mapInArrow(_by_group(search, 2), "src long, dst long")
        found = edges if found is None else found.unionByName(edges)
        if not more:
            return found
        masks = {p * (most + 1) + i + 64: masks[p] | m for p, s in splits.items() for i, m in enumerate(s)}
        parts = F.create_map(*[x for p, s in splits.items() for x in (F.lit(p).cast("long"), F.array(*[
            F.struct(F.lit(p * (most + 1) + i + 64).cast("long").alias("path"), F.lit(signed(masks[p * (most + 1) + i + 64])).alias("mask"))
            for i in range(len(s))]))])
        rows = rows.join(large.select("path", "pattern"), ["path", "pattern"]).select("fp", F.explode(parts[F.col("path")]).alias("s"))


def components(docs: DataFrame, most: int = 2, fp: str = "fp") -> DataFrame:
    """``(fp, component_id)``: the smallest ``doc_id`` that links lead to, for every fingerprint.

    Null ids do not count; a component without any other has a null id.
    """
    first = cut(docs.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("first")), "fingerprints")
    joined = connected_components(cut(links(first.select("fp"), most), "links")).select(
        F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = cut(first.join(cut(joined, "roots"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    ids = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "component-ids")
    return cut(rooted.join(ids, "root").select("fp", "component_id"), "components")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprint of its 3-word shingles and component of links of 2 bits."""
    thin = cut(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    return thin.join(components(thin), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# near-duplicates by similarity ----------------------------------------------------------------

def _features(shingle: int, bands: int, rows: int):
    multiply = np.random.default_rng(7).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def keys(h: np.ndarray) -> np.ndarray:
        low = np.full(bands * rows, ~np.uint64(0))
        for a in range(0, len(h), 4096):
            x = h[a:a + 4096, None] * multiply
            low = np.minimum(low, (x ^ (x >> np.uint64(31))).min(0))
        return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(bands, rows))], np.uint64)

    def run(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = shingle_hashes(t, shingle)
            distinct = np.unique(h)
            parity = np.packbits(np.bincount((distinct & np.uint64(_BITS - 1)).astype(np.int64), minlength=_BITS) & 1, bitorder="little")
            same = xxhash.xxh3_128_hexdigest(b" ".join(t.encode("utf-8", "surrogatepass").lower().split()))
            out.append((same, int(simhash(distinct).view(np.int64)), keys(h).view(np.int64) if len(h) else np.zeros(0, np.int64), len(distinct), parity.tobytes()))
        return pd.DataFrame(out, columns=["same", "fp", "bands", "size", "parity"])

    return F.pandas_udf(run, "same string, fp long, bands array<long>, size long, parity binary")


def _shard_pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs of each shard: every member with its two nearest and with the shard's most central member."""
    shard, block, alone, fp, row = cols
    gid, fp = _group_ids([shard, block]), fp.view(np.uint64)
    bounds = np.append(np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]])), len(gid))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        f, r, n = fp[a:b], row[a:b], b - a
        votes = np.unpackbits(f.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(0)
        center = np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0]
        off = np.bitwise_count(f ^ center)
        middle = int(np.lexsort((r, off))[0])
        if n > 1:
            for s in range(0, n, 256):
                d = np.bitwise_count(f[s:s + 256, None] ^ f[None, :]).astype(np.int16)
                d[np.arange(len(d)), np.arange(s, s + len(d))] = 999
                for _ in range(2):
                    at = d.argmin(1)
                    ok = np.flatnonzero(d[np.arange(len(d)), at] < 999)
                    out.append((shard[a] + np.zeros(len(ok), np.int64), r[s + ok], r[at[ok]], np.zeros(len(ok), np.int64)))
                    d[np.arange(len(d)), at] = 999
        if alone[a]:
            ok = np.flatnonzero(np.arange(n) != middle)
            out.append((np.full(len(ok), shard[a]), r[ok], np.full(len(ok), r[middle]), np.zeros(len(ok), np.int64)))
        else:
            out.append((shard[a:a + 1], r[middle:middle + 1], r[middle:middle + 1], np.array([1 + int(off[middle])], np.int64)))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["shard", "a", "b", "off"])


def _candidates(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of rows that share a shard, linear in the rows; fingerprints only say which come first.

    Shards of more than a few thousand rows are dealt into blocks twice; each block names its most
    central row and all rows of the shard meet the most central of these.  What this leaves apart
    is left to ``_open_tiles``.
    """
    keyed = nodes.select("row", "fp", F.explode("bands").alias("shard"))
    counts = cut(keyed.groupBy("shard").count().where("count > 1"), "shard-sizes")
    blocks = F.ceil(F.col("count") / _SHARD)
    salts = F.when(F.col("count") <= _SHARD, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    rows = cut(keyed.join(counts, "shard").select("*", F.explode(salts).alias("salt")).select(
        "shard", (F.pmod(F.xxhash64("shard", "row", "salt"), blocks) * 2 + F.col("salt")).alias("block"),
        (F.col("count") <= _SHARD).cast("long").alias("alone"), "fp", "row"), "shard-rows")
    found = cut(rows.repartition("shard", "block").sortWithinPartitions("shard", "block", "row").mapInArrow(
        _by_group(_shard_pairs, 2), "shard long, a long, b long, off long"), "shard-pairs")
    middle = cut(found.where("off > 0").groupBy("shard").agg(F.min_by("a", F.struct("off", "a")).alias("b")), "shard-middles")
    far = rows.where("alone = 0").join(middle, "shard").select(F.col("row").alias("a"), "b")
    pairs = found.where("off = 0").select("a", "b").unionByName(far).where("a <> b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open_pairs(cols: list[np.ndarray], similarity: float, window: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots in each tile that can have the similarity; a pair of -1 if a later window has more.

    Every element of the difference of two sets flips one bit of their parity bitmaps, so bitmaps
    differ in no more bits than the sets in elements; no pair of the similarity is left out.  The
    window is of places among all such partners of a row, which do not depend on roots.
    """
    shard, tile, side, row, root, size, parity = cols
    gid = _group_ids([shard, tile])
    starts = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
    bits = np.frombuffer(b"".join(parity), "<u8").reshape(len(row), -1)
    share, out, more = (1 - similarity) / (1 + similarity), [], False
    for a, b in zip(starts.tolist(), np.append(starts[1:], len(gid)).tolist()):
        if (root[a:b] == root[a]).all():
            continue
        one_block = tile[a] < 0
        middle = b if one_block else a + int(np.searchsorted(side[a:b], 1))
        other = np.arange(a, b) if one_block else np.arange(middle, b)
        if not len(other):
            continue
        step = max(1, (_PAIRS >> 1) // len(other))
        for s in range(a, middle, step):
            mine = np.arange(s, min(s + step, middle))
            apart = np.zeros((len(mine), len(other)), np.int16)
            for w in range(bits.shape[1]):
                apart += np.bitwise_count(bits[mine, w][:, None] ^ bits[other, w])
            x, y = size[mine][:, None], size[other]
            near = (apart <= share * (x + y) + 1e-6) & (np.minimum(x, y) >= similarity * np.maximum(x, y) - 1e-6)
            if one_block:
                near &= other > mine[:, None]
            place = np.cumsum(near, 1)
            near &= (place > window[0]) & (root[mine][:, None] != root[other])
            more |= bool((near & (place > window[1])).any())
            i, j = np.nonzero(near & (place <= window[1]))
            if len(i):
                out.append((row[mine[i]], row[other[j]]))
    if more:
        out.append((np.array([-1]), np.array([-1])))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["a", "b"])


def _open_tiles(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the shards that hold more than one root, for each pair of blocks they are in."""
    keyed = nodes.select("row", F.explode("bands").alias("shard")).join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    counts = cut(keyed.groupBy("shard").agg(F.count("*").alias("count"), F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low <> high").select("shard", F.ceil(F.col("count") / max(1, _SHARD // 2)).alias("blocks")), "open-shards")
    block, other = F.pmod(F.xxhash64("shard", "row"), F.col("blocks")), F.explode(F.expr("sequence(0L, blocks - 1)"))
    dealt = keyed.join(counts, "shard").select("shard", "row", "root", "blocks", block.alias("block"), other.alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    tile = F.when(F.col("block") == F.col("other"), -1 - F.col("block")).otherwise(low * F.col("blocks") + high)
    return dealt.select("shard", tile.alias("tile"), (F.col("block") > F.col("other")).cast("long").alias("side"), "row", "root").join(
        nodes.select("row", "size", "parity"), "row").select("shard", "tile", "side", "row", "root", "size", "parity")


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5,
                    text: str = "text") -> DataFrame:
    """``docs`` with ``row``, a number of the row, and ``group``, the row that stands for its group.

    Texts with the same words are copies.  Others are linked if their sets of word shingles have
    the given Jaccard similarity, counted exactly for candidates: fingerprints within 2 bits
    from the hierarchical index and the rows of shards keyed by bands of minimum shingle hashes (a
    pair of similarity 0.8 shares a shard with probability 0.9996), nearest fingerprints first, then
    all between groups that their parity bitmaps do not rule out.  Fingerprints here are of distinct
    shingles, like the similarity.  A group is what links connect; its
    row with the smallest ``doc_id`` (null last) stands for it.  Texts without words are copies of
    each other.
    """
    base, groups = _near(docs, shingle, similarity, bands, rows, text)
    found = base.join(groups, base["_f.same"] == groups["same"])
    return unboxed(found, docs.columns, {"row": F.col("_row"), "group": F.col("_group")})


def _near(docs: DataFrame, shingle: int, similarity: float, bands: int, rows: int, text: str) -> tuple[DataFrame, DataFrame]:
    """The boxed rows with ``_row`` and features, and ``(same, _group)`` of each distinct text."""
    order = F.struct(field("doc_id").isNull().alias("none"), field("doc_id").alias("id"), F.col("_row").alias("row"))
    base = boxed(docs).withColumn("_f", _features(shingle, bands, rows)(whole(field(text))))
    base = cut(base.withColumn("_row", F.monotonically_increasing_id()), "features")
    copies = cut(base.groupBy(F.col("_f.same").alias("same")).agg(F.min(order).alias("first")), "copies")
    nodes = cut(base.join(copies.select(F.col("first.row").alias("_row")), "_row", "left_semi").select(
        F.col("_row").alias("row"), "_f.fp", "_f.bands", "_f.size", "_f.parity"), "nodes")
    by_fp = cut(nodes.groupBy("fp").agg(F.min("row").alias("row")), "node-fingerprints")
    two = links(by_fp.select("fp"), 2).join(by_fp.toDF("src", "a"), "src").join(by_fp.toDF("dst", "b"), "dst").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = cut(_candidates(nodes).unionByName(two).distinct(), "pairs")

    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b):
            s, t = np.unique(shingle_hashes(x, shingle)), np.unique(shingle_hashes(y, shingle))
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    def verified(pairs: DataFrame) -> DataFrame:
        wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("_row")).distinct(), "pair-rows").where("_row >= 0")
        with filtered_scans(docs.sparkSession):  # texts outside pairs are not shuffled
            texts = cut(base.join(wanted, "_row", "left_semi").select("_row", whole(field(text)).alias("t")), "pair-texts")
        return cut(pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").where(
            F.pandas_udf(alike, "boolean")("ta", "tb")).select(F.col("a").alias("src"), F.col("b").alias("dst")), "near-links")

    def rooted_rows(linked: DataFrame) -> DataFrame:
        return cut(connected_components(linked).select(F.col("node").alias("row"), F.col("component").alias("root")), "near-roots")

    linked = verified(pairs)
    joined = rooted_rows(linked)
    for window in _WINDOWS:  # until no pair of different roots in a shard is untried
        tiles = _open_tiles(nodes, joined).repartition("shard", "tile").sortWithinPartitions("shard", "tile", "side", "row")
        found = cut(tiles.mapInArrow(_by_group(lambda c, w=window: _open_pairs(c, similarity, w), 2), "a long, b long"), "open-pairs")
        fresh = cut(found.where("a >= 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(
            pairs, ["a", "b"], "left_anti"), "fresh-pairs")
        if not fresh.isEmpty():
            linked, pairs = linked.unionByName(verified(fresh)), pairs.unionByName(fresh)
            joined = rooted_rows(linked)
        if found.where("a < 0").isEmpty():
            break
    rooted = cut(copies.select("same", "first", F.col("first.row").alias("row")).join(joined, "row", "left").select(
        "same", "first", F.coalesce("root", "row").alias("root")), "near-rooted")
    stands = cut(rooted.groupBy("root").agg(F.min("first").alias("best")), "near-groups")
    return base, cut(rooted.join(stands, "root").select("same", F.col("best.row").alias("_group")), "near-groups")


def deduplicated(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, bands: int = 20, rows: int = 5,
                 text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stand for their groups.

    The rows that go are usually few: those are joined, by broadcast while Spark sees that they are small.
    """
    base, groups = _near(docs, shingle, similarity, bands, rows, text)
    thin = base.select("_row", F.col("_f.same").alias("same"))
    gone = cut(thin.join(groups, "same").where("_row <> _group").select("_row"), "near-gone")
    return unboxed(base.join(gone, "_row", "left_anti"), docs.columns, {})

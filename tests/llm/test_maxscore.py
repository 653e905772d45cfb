"""Ranked search against the score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np

from skysieve.llm import maxscore as ms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(text):
    return Counter(TERM.findall((text or "").translate(LOW)))


def brute(rows, items, k=50):
    docs = [(i, d) for i, t in rows if (d := words(t))]
    n, total = len(docs), sum(d.total() for _, d in docs)
    df = Counter(w for _, d in docs for w in d)
    asked = {}
    for q, t in items:
        asked.setdefault(q, set()).update(words(t))
    out = []
    for q, ts in asked.items():
        found = []
        for i, d in docs:
            m = 50 + 50 * d.total() * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * d[w] // (1000 * d[w] + 20 * m))
                    for w in ts if d[w])
            if s > 0:
                found.append((-s, i is None, i))
        out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def got(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def corpus(seed=1, n=500):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgß") for _ in range(4)) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 10 + i % 290]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40)))) for i in range(25)]
    return rows, items, vocabulary


def test_search(frame, spark, monkeypatch):
    monkeypatch.setattr(ms, "_POSTINGS", 1500)
    rows, items, vocabulary = corpus()
    rows += [(None, rows[5][1]), (None, rows[9][1]), (501, None), (502, ""), (503, "..., !"), (7, rows[7][1]), (7, rows[7][1]),
             (504, "AAAA,É(aaaa) aaaa"), (505, " ".join(vocabulary) + " x" * 50_000), (506, "\x00a\x7fb~c"), (-3, rows[11][1])]
    items += [(100, None), (101, ""), (102, "!?"), (103, "absent"), (0, rows[9][1]), (None, rows[20][1]), (104, "ÉaAAA a b c"),
              (105, rows[30][1] * 400), (106, "x")]
    df = spark.createDataFrame(items, "item_id long, text string")
    index = ms.build(frame(rows, True).repartition(3)).cache()
    assert index.where("term IS NULL").count() > 6
    for k in (50, 7, 1):
        assert got(ms.top_k(index, df, k)) == brute(rows, items, k)
    monkeypatch.setattr(ms, "_TERMS", 60)  # several blocks
    assert got(ms.top_k(index, df, 7)) == brute(rows, items, 7)


def test_nothing_to_find(frame, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ms.digest(frame([]), items).count() == 0
    assert ms.digest(frame([(1, None), (2, "...")]), items).count() == 0
    assert ms.digest(frame([(1, "a")]), items.limit(0)).count() == 0
    assert got(ms.digest(frame([(1, "a")]), items)) == brute([(1, "a")], [(1, "a b")])


def test_ties_by_id(frame, spark):
    rows = [(i, "same words here") for i in range(200)] + [(i, "filler text %d" % i) for i in range(200, 400)] + [(None, "same words here")]
    items = spark.createDataFrame([(1, "same here")], "item_id long, text string")
    found = got(ms.digest(frame(rows).repartition(5), items))
    assert [x[2] for x in found] == list(range(50)) and [x[1] for x in found] == list(range(1, 51))


def shard_of(rng, vocabulary, size):
    """A shard with lists for random terms, its queries and the dense table of impacts."""
    dense = np.where(rng.random((vocabulary, size)) < rng.random((vocabulary, 1)) ** 3, rng.integers(1, 900, (vocabulary, size)), 0)
    weights = rng.integers(0, 9, vocabulary)
    chains = []
    for _ in range(12):
        chain = rng.choice(vocabulary, rng.integers(1, 10), replace=False)
        chains.append(chain[np.lexsort((chain, weights[chain]))].astype(np.int32))
    queries = ms.Queries(list(range(12)), chains, weights)
    places = [np.flatnonzero(d) for d in dense]
    none = np.zeros(0, np.int64)
    shard = ms.Shard(size, np.arange(size), 0, np.cumsum([0, *map(len, places)]), np.concatenate(places),
                     np.concatenate([d[p] for d, p in zip(dense, places)]), dense.max(1), none, none, none)
    shard.joint, shared, shard.near, shard.near_ends = ms.pair_lists(shard, queries, 5)
    return shard, queries, dense * weights[:, None], shared


def test_pair_bounds_hold_and_skip():
    rng = np.random.default_rng(2)
    with_pairs = without = 0
    for _ in range(40):
        shard, queries, dense, shared = shard_of(rng, 30, 200)
        for code, joint, n in zip(queries.pairs.tolist(), shard.joint, shared):
            a, b = divmod(code, 30)
            both = (dense[a] + dense[b])[(shard_lists(shard, a) & shard_lists(shard, b))]
            assert n == len(both) and joint == (both.max() if len(both) else 0)
        for q, chain in enumerate(queries.chains):
            total = dense[chain].sum(0)
            bound = ms.bounds((shard.tops[chain] * queries.weights[chain]).tolist(), shard.joint[queries.links[q]].tolist())
            assert all(dense[chain[:i]].sum(0).max(initial=0) <= bound[i] for i in range(len(chain) + 1))
            assert (np.diff(bound) >= 0).all()
            threshold = max(int(np.sort(total)[-5]), 1)
            for pairwise in (True, False):
                shard.work = 0
                found, scores = ms.search(shard, queries, q, threshold, pairwise=pairwise)
                assert found.tolist() == np.flatnonzero(total >= threshold).tolist() and (scores == total[found]).all()
                with_pairs, without = with_pairs + shard.work * pairwise, without + shard.work * (not pairwise)
    assert with_pairs < without


def shard_lists(shard, term):
    out = np.zeros(shard.size, bool)
    out[shard.list_of(term)[0]] = True
    return out


def test_long_documents_do_not_overflow():
    n, words, lengths = 10 ** 12, 10 ** 13, np.array([10, 10 ** 7], np.int32)
    want = [10 ** 9 * 3 // (3000 + 20 * (50 + 50 * int(x) * n // words)) for x in lengths]
    assert ms.impacts(np.array([3, 3]), lengths, n, words).tolist() == want

"""Fingerprints, links, components and near-duplicate groups against all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash

from skysieve.llm import simhash
from skysieve.operators.graph import local_components


def fingerprint(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps, most):
    fps = np.array(fps, np.uint64)
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most)
    return local_components(len(fps), a, b)


def prose(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n)]


def edited(words, changes, seed):
    rng, out = random.Random(seed), list(words)
    for _ in range(changes):
        out[rng.randrange(len(out))] = "edit" + str(rng.random())[2:6]
    return out


def test_digest(frame):
    rows = [(i, " ".join(edited(prose(i % 12, 150), i // 12 % 4, i))) for i in range(100)]
    rows += [(500, None), (501, ""), (499, " \n"), (502, "One"), (503, "one"), (504, "a b"), (None, "a b"), (None, "only null"), (505, "É b c d"), (505, "É b c d"),
             (600, "w " * 20_000)]
    got = simhash.digest(frame(rows, True).repartition(5)).collect()
    assert len(got) == len(rows)
    want = {(i, f"{fingerprint(t):016x}") for i, t in rows}
    assert {(r.doc_id, r.fingerprint) for r in got} == want
    fps = [int(r.fingerprint, 16) for r in got]
    labels = components(fps, 2)
    least = {}
    for r, c in zip(got, labels.tolist()):
        if r.doc_id is not None:
            least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(c) for r, c in zip(got, labels.tolist()))
    assert simhash.digest(frame([])).count() == 0


@pytest.mark.parametrize("bits,n,most", [(64, 3000, 2), (14, 3000, 2), (20, 2000, 1), (64, 500, 5)])
def test_links(spark, bits, n, most, monkeypatch):
    """Dense and sparse sets, and shards that have to be split several times."""
    monkeypatch.setattr(simhash, "_SHARD", 64)
    rng = random.Random(bits)
    base = [rng.getrandbits(bits) for _ in range(n // 3)]
    fps = sorted({f ^ (sum(1 << rng.randrange(bits) for _ in range(rng.randrange(4))) % (1 << bits)) for f in base * 3})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    at = {f: i for i, f in enumerate(signed)}
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), most).collect()
    assert all(0 < (a.src ^ a.dst & (1 << 64) - 1 if False else (a.src & (1 << 64) - 1) ^ (a.dst & (1 << 64) - 1)).bit_count() for a in edges)
    got = local_components(len(fps), np.array([at[e.src] for e in edges], int), np.array([at[e.dst] for e in edges], int))
    assert got.tolist() == components(fps, most).tolist()


def test_tree_prunes_to_the_same_pairs():
    rng = np.random.default_rng(11)
    fp = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFFF00000FFF))
    gid = np.sort(rng.integers(0, 5, len(fp)))
    order = np.lexsort((fp ^ (fp >> np.uint64(1)), gid))
    tree = simhash.Tree(fp[order], gid[order])
    root = {g: i for i, g in enumerate(tree.roots["gid"].tolist())}
    q = np.arange(len(fp))
    a, b = tree.search(q, np.array([root[g] for g in gid[order].tolist()]), 3)
    d = np.bitwise_count(fp[order][:, None] ^ fp[order][None, :])
    x, y = np.nonzero((d <= 3) & (gid[order][:, None] == gid[order][None, :]) & (q[:, None] < q[None, :]))
    assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(x.tolist(), y.tolist()))


def similarity(a, b):
    s, t = (set(zip(*(w[i:] for i in range(5)))) for w in (a, b))
    return len(s & t) / len(s | t)


def test_near_duplicates(frame, monkeypatch):
    """Groups are what similarity 0.8 of five-word shingles connects; also where a shard has to be worked on in blocks."""
    docs = [edited(prose(100 + i % 15, 200), i // 15 * 2, i) for i in range(120)]
    docs += [edited(prose(999, 300), i % 9, i) for i in range(150)]  # one large group
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if similarity(docs[i], docs[j]) >= 0.8]
    labels = local_components(len(docs), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    extra = [(1000, None), (1001, ""), (1002, "short text"), (1003, "Short  TEXT"), (None, rows[3][1]), (3, rows[3][1])]
    got = simhash.near_duplicates(frame(rows + extra, True)).collect()
    group = {}
    for r in got:
        group.setdefault(r.doc_id, set()).add(r.group)
    assert len(got) == len(rows) + len(extra) and all(len(g) == 1 for g in group.values())
    by_label = {}
    for i, c in enumerate(labels.tolist()):
        by_label.setdefault(c, set()).update(group[i])
    assert all(len(g) == 1 for g in by_label.values()) and len(by_label) == len(set().union(*by_label.values()))
    assert group[1000] == group[1001] and group[1002] == group[1003] and group[None] == group[3]
    kept = [r.doc_id for r in simhash.deduplicated(frame(rows + extra, True)).collect()]
    least = {}
    for i, c in enumerate(labels.tolist()):
        least[c] = min(least.get(c, i), i)
    assert sorted(kept) == sorted([*least.values(), 1000, 1002])
    monkeypatch.setattr(simhash, "_SHARD", 16)
    blocks = {r.doc_id: r.group for r in simhash.near_duplicates(frame(rows)).collect()}
    assert 0 <= len(set(blocks.values())) - len(set(labels.tolist())) <= 2
    assert simhash.deduplicated(frame([])).count() == 0


def groups(df, **kw):
    found = {}
    for r in simhash.near_duplicates(df, **kw).collect():
        found.setdefault(r.group, set()).add(r.doc_id)
    return sorted(map(sorted, found.values()))


def brute_groups(docs):
    pairs = [(i, j) for i in range(len(docs)) for j in range(i) if similarity(docs[i], docs[j]) >= 0.8]
    labels = local_components(len(docs), np.array([i for i, _ in pairs]), np.array([j for _, j in pairs])).tolist()
    return sorted([i for i, c in enumerate(labels) if c == label] for label in set(labels))


def test_hot_shards_lose_no_link(frame, monkeypatch):
    """Near copies among texts of one template, whose shards are many times the size of a block."""
    monkeypatch.setattr(simhash, "_SHARD", 16)
    template, docs = prose(1, 160), []
    for i in range(150):
        own = prose(2000 + i, 60)
        docs += [template + own, template + edited(own, 2, i)]
    want = brute_groups(docs)
    assert len(want) == 150
    assert groups(frame([(i, " ".join(w)) for i, w in enumerate(docs)]), bands=6, rows=1) == want


def test_small_shards_lose_no_link(frame):
    """Two clusters of close variants that only one pair joins, which is neither nearest nor central."""
    docs = []
    for i in range(40):
        a = prose(3000 + i, 200)
        b = [f"b{j}" if j in range(10, 50, 10) else w for j, w in enumerate(a)]  # joined by the two originals
        for base, at in ((a, 100), (b, 150)):
            docs.append(base)
            docs += [[f"v{at + k}" if j == at + 10 * k else w for j, w in enumerate(base)] for k in range(4)]
    assert similarity(docs[0], docs[5]) >= 0.8 > max(similarity(docs[x], docs[y]) for x in range(5) for y in range(5, 10) if (x, y) != (0, 5))
    want = brute_groups(docs)
    assert len(want) == 40
    assert groups(frame([(i, " ".join(w)) for i, w in enumerate(docs)])) == want


def test_repeated_lines_lose_no_link(frame):
    """A line added many times changes fingerprints of counted shingles, but hardly the set of shingles."""
    docs = []
    for i in range(20):
        words, line = prose(5000 + i, 400), prose(6000 + i, 5)
        at = random.Random(i).sample(range(400), 19)
        docs += [words + line, words + line * 19, [w for j, x in enumerate(words) for w in (*(line if j in at[:3] else []), x)]]
    want = brute_groups(docs)
    assert len(want) == 20
    assert groups(frame([(i, " ".join(w)) for i, w in enumerate(docs)])) == want
    assert groups(frame([(0, " ".join(docs[0])), (1, " ".join(docs[1]))])) == [[0, 1]]

"""Targets, rates and copies of the mix."""

import math
import random

from skysieve.llm import mixing


def water(sizes, share=1.5, cap=2.0):
    """Targets by sharing again and again."""
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, out, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        level = (total - sum(out.values())) / sum(weights[s] for s in free)
        full = {s for s in free if weights[s] * level > cap * sizes[s]}
        if not full:
            return out | {s: weights[s] * level for s in free}
        out |= {s: cap * sizes[s] for s in full}
        free -= full
    return out


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = int(rng.lognormvariate(3, 1)) if i % 40 else 0
        source = "hot" if rng.random() < 0.4 else rng.choice([None, "a", "b", "c", "é", "Z"])
        out.append((i, "w " * words if words else (None if i % 80 else ""), "en", source))
    return out + out[:30] + [(None, "x y z", "en", "a")] * 3


def test_mix(frame):
    rows = corpus()
    got = mixing.mix(frame(rows, True)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = water(sizes)
    taken, rates = dict.fromkeys(sizes, 0), {}
    for r in got:
        assert r.size == len((r.text or "").split()) and r.source_size == sizes[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-9) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
        rates.setdefault((r.source, r.size), []).append(r.copies)
    assert all(abs(taken[s] - want[s]) <= 3 for s in sizes)
    assert all(max(c) - min(c) <= 1 for c in rates.values())
    assert sorted((r.doc_id or -1, r.copies) for r in got) == sorted((r.doc_id or -1, r.copies) for r in mixing.mix(frame(rows, True)).collect())


def test_rates_tilt_one_way(frame):
    """Sources over their size favour long documents, sources under it short ones."""
    rows = [(i, "w " * (1 + i % 60), "en", s) for s in "abc" for i in range(600)]
    mean = {}
    for r in mixing.mix(frame(rows)).collect():
        mean.setdefault((r.source, r.target > r.source_size, r.size > 30), []).append(r.copies)
    mean = {k: sum(v) / len(v) for k, v in mean.items()}
    for s, more in {(s, m) for s, m, _ in mean}:
        assert mean[s, more, True] >= mean[s, more, False] if more else mean[s, more, True] <= mean[s, more, False]


def test_repeated_and_empty(frame, spark):
    df = frame(corpus(2, 200), True)
    out = mixing.repeated(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixing.mix(df).collect())
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.repeated(df.limit(0)).count() == 0
    empty = mixing.mix(frame([(1, None, "en", None), (2, "", "en", "a")])).collect()
    assert [(r.size, r.source_size, r.target, r.copies) for r in empty] == [(0, 0, 0.0, 1)] * 2


def test_ranks(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(300)], "k string").repartition(7)
    assert all(int(r.k[1:]) == r.at for r in mixing.ranks(df, "k", "at").collect())

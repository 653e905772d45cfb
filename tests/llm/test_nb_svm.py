"""Quality classifier: held-out accuracy, the dual against the primal problem, counts by plain sets."""

import random
import zlib

import numpy as np

from skysieve.llm import nb_svm
from skysieve.llm.text import table


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def corpus(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(200)]
    rows, told = [], []
    for i in range(n):
        ws = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            ws = [w + "###" for w in ws] if i % 10 else [w for w in ws[:6] for _ in range(8)]
        rows.append((i, " ".join(ws)))
        told.append((i, 0 if bad else 1, 0))
    return rows, told


def test_held_out_accuracy(frame, spark):
    rows, told = corpus(1500, 1)
    got = nb_svm.digest(frame(rows, True), labels(spark, told)).collect()
    assert len(got) == 1500
    right = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
        right += r.held_out and r.predicted == told[r.doc_id][1]
    assert right >= 0.98 * sum(r.held_out for r in got)


def test_given_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = nb_svm.digest(table(spark, sf, "documents"), table(spark, sf, "labels")).where("held_out")
    told = table(spark, sf, "labels").join(got, "doc_id").collect()
    assert np.mean([r.predicted == r.quality for r in told]) >= 0.95


def test_held_out_labels_and_other_columns_teach_nothing(frame, spark):
    rows, told = corpus(300, 2)
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, 1) for i, y, _ in told]
    a, b = ({r.doc_id: r.score for r in nb_svm.digest(frame(docs), labels(spark, t)).collect()}
            for docs, t in ((rows, told), ([(i, t, "x", str(i)) for i, t in rows], turned)))
    assert a == b


def test_odd_rows(frame, spark):
    rows, told = corpus(200, 3)
    long_text = "word " * 300_000
    rows += [(None, "x y"), (1000, None), (1001, ""), (1002, long_text), (7, rows[7][1]), (1003, "###")]
    told += [(None, 1, 0), (1000, None, 0), (1001, 2, 0), (2, 1, 0), (2, 0, 0), (3, 1, 0), (9999, 1, 1)]
    docs = frame(rows, True)
    known = {r.doc_id: r.label for r in nb_svm.known(labels(spark, told), nb_svm.F.lit(True)).collect()}
    assert 2 not in known and 1000 not in known and 1001 not in known and known[3] == 1 and None not in known
    got = nb_svm.digest(docs, labels(spark, told)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.held_out for r in got if r.doc_id is None} == {False}
    same = [r.score for r in got if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    empty = {r.score for r in got if r.doc_id in (1000, 1001)}
    assert len(empty) == 1
    model = nb_svm.fit(docs, labels(spark, told))
    scored = nb_svm.score(docs.withColumnRenamed("n_chars", "Score"), model)
    assert scored.columns.count("score") == 1 and scored.count() == len(rows) and "_key" in scored.columns


def test_without_both_classes(frame, spark):
    rows = [(i, "some text") for i in range(8)]
    for told, score in (([], 0.5), ([(0, 1, 0), (1, 1, 0)], 0.75)):
        model = nb_svm.fit(frame(rows), labels(spark, told))
        assert {r.score for r in nb_svm.score(frame(rows), model).collect()} == ({0.5} if not told else {score})
    assert nb_svm.digest(frame([]), labels(spark, [(0, 1, 0)])).count() == 0


def test_sample_bounds_the_fit_not_the_counts(frame, spark):
    rows, told = corpus(400, 4)
    model = nb_svm.fit(frame(rows), labels(spark, told), sample=120)
    sets = {i: x for (i, _), x in zip(rows, nb_svm.indicators([t.encode() for _, t in rows]))}
    good, bad = np.ones(1 << nb_svm.BITS), np.ones(1 << nb_svm.BITS)
    for i, y, _ in told:
        (good if y else bad)[sets[i]] += 1
    scale = np.log(good / good.sum()) - np.log(bad / bad.sum())
    assert np.allclose(model.squares, scale * scale)


def test_indicators_are_sets_over_the_whole_text(monkeypatch):
    rng = random.Random(5)
    texts = [b"", b"a", None, b"ab ab ab", bytes(rng.randrange(256) for _ in range(5000)), b"one two " * 900]
    whole = list(nb_svm.indicators(texts))
    monkeypatch.setattr(nb_svm, "_CHUNK", 64)
    for a, b in zip(whole, nb_svm.indicators(texts)):
        assert a.tolist() == b.tolist() == sorted(set(a.tolist()))
    # the same grams in another number of copies are the same set
    a, b = nb_svm.indicators([b"abc abc abc abc ", b"abc " * 7])
    assert set(a.tolist()) - set(range(96)) == set(b.tolist()) - set(range(96))


def test_dual_descent_solves_the_primal_problem():
    rng = np.random.default_rng(6)
    scale = rng.standard_normal(40)
    rows = [np.flatnonzero(rng.random(40) < 0.3).astype(np.int32) for _ in range(60)]
    rows = [r if len(r) else np.array([0], np.int32) for r in rows]
    signs = np.where(rng.random(60) < 0.6, 1.0, -1.0)
    dense = np.zeros((60, 41))
    for i, r in enumerate(rows):
        dense[i, r] = scale[r] / np.linalg.norm(scale[r])
        dense[i, 40] = 1
    w, bias, alpha = nb_svm.descend(rows, signs, scale, 1.0, 3000, tolerance=1e-9)
    full = np.append(w, bias)
    assert np.allclose(full, (alpha * signs) @ dense) and (alpha >= 0).all() and (alpha <= 1).all()
    primal = 0.5 * full @ full + np.maximum(0, 1 - signs * (dense @ full)).sum()
    dual = alpha.sum() - 0.5 * full @ full
    assert primal - dual < 1e-4 * primal  # no gap: both are optimal


def test_curve_has_no_slope_left():
    rng = np.random.default_rng(7)
    m = rng.standard_normal(500)
    y = (m + rng.standard_normal(500) > 0.3).astype(int)
    slope, shift = nb_svm.curve(m, y)
    n1 = y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (500 - n1 + 2))
    p = 1 / (1 + np.exp(-(slope * m + shift)))
    assert abs((p - target).sum()) < 1e-2 and abs(((p - target) * m).sum()) < 1e-2 and slope > 0

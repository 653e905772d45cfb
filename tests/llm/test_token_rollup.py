"""Rollups against counting everything anew."""

import random
from collections import Counter

import pytest

from skysieve.llm import token_rollup as tr, tokens

CHANGES = "op string, doc_id long, source string, lang string, tokenizer string, n_tokens long"


def totals(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_batches(spark, tmp_path):
    store, rng, state = tr.Rollup(spark, str(tmp_path / "r")), random.Random(14), {}
    assert totals(store) == {}
    batches = []
    for b in range(1, 5):
        rows = {}
        for _ in range(60):
            op = rng.choice(["insert", "revise", "delete"])
            doc, kind = rng.choice([None, *range(25)]), rng.choice(["a-1", "a-2"])
            rows[doc, kind] = (op, doc, rng.choice(["s", "t", None]), rng.choice(["en", None]), kind, rng.choice([None, 0, 5, 9]))
        batches.append(list(rows.values()))
        store.commit(b, spark.createDataFrame(batches[-1] * 2, CHANGES))  # repeated rows count once
        for op, doc, source, lang, kind, n in batches[-1]:
            state.pop((doc, kind), None)
            if op != "delete":
                state[doc, kind] = (source, lang, n or 0)
        want = {}
        for (doc, kind), (source, lang, n) in state.items():
            d, t = want.get((source, lang, kind), (0, 0))
            want[source, lang, kind] = (d + 1, t + n)
        assert totals(store) == want
    for b in (4, 2):  # again: nothing changes
        store.commit(b, spark.createDataFrame(batches[b - 1], CHANGES))
        assert totals(store) == want
    store.commit(5, spark.createDataFrame([], CHANGES))
    assert totals(store) == want


def replay(batches):
    """Totals of batches in the order of their numbers, by plain dictionaries."""
    state, want = {}, {}
    for b in sorted(batches):
        for op, doc, source, lang, kind, n in batches[b]:
            state.pop((doc, kind), None)
            if op != "delete":
                state[doc, kind] = (source, lang, n or 0)
    for (doc, kind), (source, lang, n) in state.items():
        d, t = want.get((source, lang, kind), (0, 0))
        want[source, lang, kind] = (d + 1, t + n)
    return want


def insert(doc, n, kind="a-1", op="insert"):
    return (op, doc, "s", "en", kind, n)


def test_batches_out_of_order(spark, tmp_path):
    """A batch again with other content, a late batch, null versions: as if all had come in order."""
    cases = {
        "other content": [(1, [insert(1, 10)]), (2, [insert(1, 20, op="revise")]), (1, [insert(1, 12)])],
        "late": [(2, [insert(1, 20, op="revise")]), (1, [insert(1, 10)])],
        "null version": [(1, [insert(1, 5, None), insert(None, 6, None)]), (2, [insert(1, 7, None, "revise"), insert(None, None, None, "delete")])],
        "late delete": [(1, [insert(1, 10)]), (3, [insert(1, 30)]), (2, [insert(1, None, op="delete")])],
        "emptied": [(1, [insert(1, 10)]), (2, [insert(2, 3)]), (1, [])],
    }
    for i, (name, commits) in enumerate(cases.items()):
        store, known = tr.Rollup(spark, str(tmp_path / str(i)), state_every=2), {}
        for b, rows in commits:
            store.commit(b, spark.createDataFrame(rows, CHANGES))
            known[b] = rows
            assert totals(store) == replay(known), name


def test_states(spark, tmp_path):
    """Random commits in any order; later commits start from a state, and those behind a late batch are dropped."""
    rng, store, known = random.Random(15), tr.Rollup(spark, str(tmp_path / "s"), state_every=2), {}
    for b in (1, 2, 4, 5, 3):
        known[b] = list({(d, k): (rng.choice(["insert", "revise", "delete"]), d, rng.choice(["s", None]), "en", k, rng.randint(0, 9))
                         for d, k in ((rng.choice([None, *range(8)]), rng.choice(["a", None])) for _ in range(20))}.values())
        store.commit(b, spark.createDataFrame(known[b], CHANGES))
    assert totals(store) == replay(known)
    assert [b for b, parts in sorted(store._log()[1].items()) if "state" in parts] == [2, 4]


def test_broken_commit_leaves_the_store(spark, tmp_path, monkeypatch):
    store = tr.Rollup(spark, str(tmp_path / "b"))
    store.commit(1, spark.createDataFrame([insert(1, 10)], CHANGES))
    want = totals(store)
    with monkeypatch.context() as m:
        m.setattr(store, "_publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.commit(2, spark.createDataFrame([insert(2, 5)], CHANGES))
    assert totals(store) == want
    store.commit(2, spark.createDataFrame([insert(2, 5)], CHANGES))
    assert totals(store) == replay({1: [insert(1, 10)], 2: [insert(2, 5)]})


def test_unknown_change(spark, tmp_path):
    with pytest.raises(Exception, match="unknown change"):
        tr.Rollup(spark, str(tmp_path)).commit(1, spark.createDataFrame([("drop", 1, "s", "en", "a", 1)], CHANGES))


def test_digest(frame, spark):
    rows = [(1, "a b\na b\nc", "en", "s"), (2, "one two", "de", "s"), (3, None, None, None), (4, "gone", "en", "s"), (4, "gone", "en", "s"), (None, "x", "en", "t")]
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 1), (9, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in tr.digest(frame(rows, True), labels).collect()}
    ids = tokens.encoder(tokens.default_path()).ids
    want = {}
    for text, lang, source in (("a b\nc", "en", "s"), ("one two", "de", "s"), ("", None, None), ("x", "en", "t")):
        for kind, n in ((tr.WORDS, len(text.split())), (tr.BYTE_BPE, len(ids(text)))):
            d, t = want.get((source, lang, kind), (0, 0))
            want[source, lang, kind] = (d + 1, t + n)
    assert got == want
    assert tr.digest(frame([]), labels).count() == 0

"""The pipeline stage by stage on a small corpus, and all queries' entries."""

import random
import zlib

import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from skysieve.llm import quality, secret_scan, tokens
from test_simhash import edited, prose
from test_mixing import water

NAMES = ["quality rules", "SimHash near-dedup", "secret scans", "mixing sources", "packing"]


@pytest.fixture(scope="module")
def corpus(frame):
    rng, rows = random.Random(15), []
    for i in range(120):
        words = edited(prose(200 + i % 40, 120), 3 * (i // 40), i)
        if i % 9 == 0:
            words.insert(5, "token=abcdefghijkl0123")
        rows.append((i, " ".join(words), "en", rng.choice(["a", "a", "b", None]), len(" ".join(words))))
    rows += [(300, "too short", "en", "a", 9), (301, "again and again and " * 50, "en", "b", 1000), (302, None, "en", "a", None)]
    return frame(rows)


def test_stages(spark, corpus):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, seen = corpus, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/nowhere").cache()
        if name != NAMES[-1]:
            assert out.columns == corpus.columns
        seen.append(out.collect())
        docs = out
    good, single, clean, mixed, pieces = seen
    keep = {r.doc_id for r in corpus.collect() if quality.measure([r.text or ""]).kept[0]}
    assert {r.doc_id for r in good} == keep and 300 not in keep and 301 not in keep and 302 not in keep
    assert len({r.doc_id % 40 for r in single}) == 40 and len(single) < len(good)
    assert {r.doc_id for r in clean} == {r.doc_id for r in single}
    assert not any("abcdefghijkl0123" in r.text for r in clean) and any("[assign]" in r.text for r in clean)
    assert all(r.n_chars == len(r.text) for r in clean)
    sizes = {}
    for r in clean:
        sizes[r.source] = sizes.get(r.source, 0) + len(r.text.split())
    taken = dict.fromkeys(sizes, 0)
    for r in mixed:
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - t) <= 130 for s, t in water(sizes).items())
    encode = tokens.encoder(tokens.default_path()).document
    assert sum(r.length for r in pieces) == sum(len(encode(r.text)) for r in mixed)
    text = {r.doc_id: r.text for r in mixed}
    for r in pieces:
        ids = encode(text[r.doc_id])
        assert len(ids) == r.doc_tokens and zlib.crc32(np.ascontiguousarray(ids[r.start:r.start + r.length]).tobytes()) == r.ids_crc32


def test_run_and_registration(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)] and "pipeline" in entry.queries()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert secret_scan.BASE == ("assign", "access", "hex")

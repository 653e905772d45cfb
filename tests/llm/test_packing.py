"""Token ids and packed sequences: round trips and little padding."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from skysieve.llm import bfd_pack, packing, tokens

ODD = ["", " ", "  a  b", "a\n b\t c \n", "x  y \x1c z", "<|endoftext|> a<|endoftext|>", "don't  can't 's", "é\U0001F600 中文 a", " lead", "trail ",
       "a  b  c", "  x", "A" * 5000, "word " * 4000, "The end."]


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_ids(text, direct):
    assert tokens.encoder(tokens.default_path()).ids(text).tolist() == direct(text)


@settings(deadline=None, max_examples=200)
@given(st.text(alphabet=st.sampled_from(list(" \n\tab'sé1.,  中\x1c\x85")), max_size=40))
def test_ids_of_any_text(text):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")) if not hasattr(test_ids_of_any_text, "t") else test_ids_of_any_text.t
    test_ids_of_any_text.t = t
    assert tokens.encoder(tokens.default_path()).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def corpus():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "of", "the"]) for _ in range(int(rng.lognormvariate(4, 1.3))))) for i in range(400)]
    return rows + [(None, None), (7, ""), (8, "again"), (8, "again"), (900, "long word " * 9000)]


def pieces_by_document(rows):
    docs = {}
    for doc, start, ids in rows:
        docs.setdefault(doc, []).append((start, ids))
    return docs


def test_sum_of_squares_packing(frame, direct):
    rows = corpus()
    got = packing.pack(frame(rows, True)).collect()
    want = {}
    for i, t in rows:
        want.setdefault(i, []).append(direct(t or "") + [1])
    flat = pieces_by_document([(r.doc_id, r.start, r) for r in got])
    assert flat.keys() == want.keys()
    for doc, pieces in flat.items():
        ids = [np.frombuffer(r.ids, "<u4").tolist() for _, r in pieces]
        if len(want[doc]) == 1:
            assert sum((x for _, x in sorted(zip([s for s, _ in pieces], ids))), []) == want[doc][0]
        else:
            assert sorted(sum(ids, [])) == sorted(sum(want[doc], []))
        for (_, r), x in zip(pieces, ids):
            assert r.length == len(x) and r.ids_crc32 == zlib.crc32(np.array(x, "<u4").tobytes()) and r.doc_tokens in map(len, want[doc])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at == 2048 or at & (at - 1) == 0 and at < 2048
    assert packing.pack(frame([])).count() == 0
    assert sorted(map(str, packing.digest(frame(rows)).collect())) == sorted(map(str, packing.digest(frame(rows)).collect()))


def test_level_rule():
    """Every item goes where the sum of squares is smallest."""
    rng, levels = random.Random(5), packing.Levels(50)
    for _ in range(2000):
        size = rng.randint(1, 49)
        n = levels.count.tolist()

        def after(h):
            m = n.copy()
            if h:
                m[h] -= 1
            if h + size < 50:
                m[h + size] += 1
            return sum(x * x for x in m)

        options = [0] + [h for h in range(1, 51 - size) if n[h]]
        assert after(levels.choose(size)) == min(map(after, options))
        levels.put(size, size)
        assert all(len(o) == c and all(sum(p) == h for p in o) for h, (o, c) in enumerate(zip(levels.open, levels.count)))


def test_cuts_stay_few():
    """Every id in one place, sequences full, few ids moved by cuts whatever the share of a task."""
    rng = random.Random(6)
    sizes = [max(1, int(rng.lognormvariate(5.5, 0.9))) % 2048 or 1 for _ in range(6000)] + [300] * 500 + [2047] * 100
    rng.shuffle(sizes)
    for share in (6600, 1650, 206):
        moved = 0
        for first in range(0, len(sizes), share):
            windows, out = packing.Windows(2048), []
            for i, n in enumerate(sizes[first: first + share]):
                out += windows.add((i, 0, np.arange(n), n))
                assert windows.n_open == windows.levels.count.sum() <= packing.OPEN
            assert all(sum(len(p[2]) for p in pieces) == 2048 for pieces in out)
            rest = list(windows.finish())
            lengths = [sum(len(p[2]) for p in pieces) for pieces in rest]
            assert all(n == 2048 or n & (n - 1) == 0 for n in lengths) and len(set(n for n in lengths if n < 2048)) == sum(n < 2048 for n in lengths)
            seen = {}
            for i, start, ids, n in (p for pieces in out + rest for p in pieces):
                assert len(ids) and ids[0] == start and n == sizes[first + i]
                seen.setdefault(i, []).extend(ids.tolist())
            assert all(sorted(seen[i]) == list(range(n)) for i, n in enumerate(sizes[first: first + share]))
            moved += windows.moved
        assert moved < 0.05 * sum(sizes), share


def test_one_sequence_open():
    windows = packing.Windows(8, 1)
    out = [p for i, n in enumerate((5, 2, 2, 7, 7, 1, 4)) for p in windows.add((i, 0, np.arange(n), n))] + list(windows.finish())
    assert [sum(len(p[2]) for p in pieces) for pieces in out] == [8, 8, 8, 4]


def test_best_fit():
    rng = np.random.default_rng(6)
    for capacity in (7, 64, 100):
        sizes = rng.integers(1, capacity + 1, 500)
        got = bfd_pack.best_fit(sizes, capacity)
        spaces, want = [], []
        for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
            fit = [j for j, s in enumerate(spaces) if s >= sizes[i]]
            j = min(fit, key=lambda j: spaces[j]) if fit else len(spaces)
            if not fit:
                spaces.append(capacity)
                want.append([])
            spaces[j] -= sizes[i]
            want[j].append(i)
        assert sorted(sum(got, [])) == list(range(500)) and max(sizes[g].sum() for g in got) <= capacity
        assert sorted(sizes[g].sum() for g in got) == sorted(sizes[g].sum() for g in want)


def test_matrices(frame, direct, tmp_path, spark):
    rows = corpus()
    bfd_pack.write(frame(rows, True).coalesce(1), str(tmp_path / "m"))
    packed = spark.read.parquet(str(tmp_path / "m"))
    used = 0
    for r in packed.collect():
        assert len(r.ids) == 2 * 2048 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.length
        assert len(r.cu_seqlens) == len(r.doc_ids) + 1 == len(r.position_starts) + 1
        assert not any(np.frombuffer(r.ids, "<u2")[r.length:])
        used += r.length
    assert used / (2048 * packed.count()) > 0.9
    back = pieces_by_document([(r.doc_id, r.start, r.ids) for r in bfd_pack.unpack(packed).collect()])
    for i, t in rows:
        if i not in (7, 8):
            assert sum((x for _, x in sorted(back[i])), []) == direct(t or "") + [1]
    assert sorted(sum((x for _, x in back[8]), [])) == sorted(2 * (direct("again") + [1]) + direct(rows[8][1]) + [1])
    assert bfd_pack.pack(frame([])).count() == 0

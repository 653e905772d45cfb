"""Counts and verdicts against plain loops."""

import random
import re

from skysieve.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    n = len(inside)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), n,
            len(words) < 10 or 100 * n > 20 * len(words))


def texts():
    rng = random.Random(8)
    out = [None, "", " \n\t", "one", "é\U0001F600 a b c d e f g h i", "a b c d e f\n" * 3, "x y \x1c z\x0bw\x0cv\rq", "#*$%&|<> " * 12,
           "a b c d e " * 2, "w " * 3000, "tail a b c d e f g h i j k"]
    out += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    out += ["\n".join(rng.choice(["", " ", "l one", "l two", "a b c d e f g"]) for _ in range(12)) for _ in range(30)]
    return out


def test_counts(frame):
    ts = texts()
    rows = quality.digest(frame(list(enumerate(ts)), True)).collect()
    assert len(rows) == len(ts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(ts[r.doc_id]), ts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_repeated_ngrams_of_all_lengths():
    import numpy as np
    rng = random.Random(9)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    flat, doc = [ord(w) for d in docs for w in d], [i for i, d in enumerate(docs) for _ in d]
    for n, inside in quality.repeated_words(np.array(flat), np.array(doc), (5, 7, 10)):
        want = []
        for d in docs:
            grams = [tuple(d[i:i + n]) for i in range(len(d) - n + 1)]
            hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
            want += [j in hit for j in range(len(d))]
        if n in (5, 7, 10):
            assert inside.tolist() == want


def test_shares_and_rules():
    """Shares against plain loops; each rule can be the only one broken."""
    ts = [t or "" for t in texts() if t != "w " * 3000]
    got = quality.measure(ts)
    for t, top, repeat in zip(ts, got.top_shares, got.repeat_shares):
        words = WORD.findall(t)
        size = max(1, sum(map(len, words)))
        for n, x in zip((*quality.TOP_LIMITS, *quality.NGRAM_LIMITS), (*top, *repeat)):
            grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
            if n in quality.TOP_LIMITS:
                want = max((grams.count(g) * sum(map(len, g)) for g in set(grams) if grams.count(g) > 1), default=0) / size
                assert x == min(1.0, want)
            else:
                inside = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + n)}
                assert x == sum(len(words[j]) for j in inside) / size
    assert sorted(quality.NGRAM_LIMITS.values(), reverse=True) == list(quality.NGRAM_LIMITS.values())
    rng = random.Random(11)

    def fresh(k):
        return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(k)]

    long10, pair, line = fresh(10), fresh(2), " ".join(fresh(4))
    # a ten-word phrase twice in 135 words; a pair of words 15 times; a four-word line eight times
    ten = [*long10, *fresh(58), *long10, *fresh(57)]
    twos = [w for _ in range(15) for w in (*pair, *fresh(5))]
    rows = ["\n".join([line, *(x for _ in range(7) for x in (line, " ".join(fresh(11))))])]
    found = quality.measure([" ".join(ten), " ".join(twos), *rows, " ".join(fresh(200))])
    assert found.rejected_by[0] == ["repeat_10"] and found.rejected_by[1] == ["top_2"]
    assert {"top_4", "lines"} == set(found.rejected_by[2]) - {"top_2", "top_3"} and found.rejected_by[3] == []
    assert found.kept.tolist() == [False, False, False, True] and not found.base_failed.any()


def test_very_long_text():
    text = " ".join(str(i) for i in range(400_000))
    one = quality.measure([text, text + " " + text]).iloc
    assert one[0].kept and one[0].n_words == 400_000 and one[1].base_failed and one[1].n_repeat_words == 800_000


def test_verdicts(frame):
    rng = random.Random(10)
    clean = " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(200))
    cases = {1: (clean, True), 2: (clean + "\n" + clean[:90], True), 3: ("one two three", False), 4: ("same words again and again " * 40, False),
             5: (" ".join(w + "***" for w in clean.split()), False), 6: (clean[:240] + ("\n" + clean[300:318]) * 2, True),
             7: (" | ".join(clean.split()), True)}
    got = {r.doc_id: r.kept for r in quality.digest(frame([(i, t) for i, (t, _) in cases.items()])).collect()}
    assert got == {i: k for i, (_, k) in cases.items()}
    df = frame([(i, t) for i, (t, _) in cases.items()] + [(1, clean), (None, clean), (8, None)], True)
    kept = quality.kept(df)
    assert kept.columns == df.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 2, 6, 7]
    assert quality.kept(df.limit(0)).count() == 0

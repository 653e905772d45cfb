"""Quality rules by repetition: how much of a text lies in lines and word n-grams it has said before."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from skysieve.llm.text import boxed, field, unboxed, whole

# Fixed values, published for web text: highest share of a text's word characters inside the n-gram that covers most of them, by n.
TOP_LIMITS: dict[int, float] = {2: 0.20, 3: 0.18, 4: 0.16}
# Highest share of a text's word characters inside any repeated n-gram, by n.  They fall with n, so that each can bind, and
# are set to lose two or three in 1,000 documents labelled good.
NGRAM_LIMITS: dict[int, float] = {5: 0.20, 6: 0.18, 7: 0.17, 8: 0.16, 9: 0.15, 10: 0.14}
LINE_LIMIT = 0.20  # of characters in lines that repeat an earlier line
SYMBOL_LIMIT = 1.0  # symbols for each word
_SPACE, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 21  # bytes of text measured together

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_share double, "
          "top_shares array<double>, repeat_shares array<double>, base_failed boolean, kept boolean, rejected_by array<string>")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread integers over 64 bits, one to one."""
    x = x * _BASE
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _lines(text: bytes) -> tuple[int, int, int]:
    """Repeated lines, their bytes and the bytes of all lines, lines without a word left out."""
    lines = [x for x in text.split(b"\n") if x.strip(_SPACE)]
    if len(lines) < 2:
        return 0, 0, len(text)
    seen: set[bytes] = set()
    n = size = total = 0
    for x in lines:
        total += len(x)
        if x in seen:
            n, size = n + 1, size + len(x)
        seen.add(x)
    return n, size, total


def _repeats(ids: np.ndarray, doc: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each n: first words of the n-grams that their document has twice or more, equal ones together, and their hashes.

    A hash rolls from each length to the next; n-grams never cross documents.  Only where a
    shorter n-gram repeats can a longer one repeat, so each length looks at what the last one left.
    """
    word, rolled = _mixed(ids.astype(np.uint64) + np.uint64(1)), None
    salt = _mixed(doc.astype(np.uint64) + np.uint64(0x5851F42D))
    start, n = np.arange(len(ids)), 0
    for want in sorted(lengths):
        while n < want:
            n += 1
            if n == 1:
                rolled = word.copy()
            elif len(ids) >= n:
                rolled = rolled[:-1] * _BASE + word[n - 1:]
        start = start[start + n <= len(ids)]
        start = start[doc[start] == doc[start + n - 1]]
        key = _mixed(rolled[start] ^ salt[start]) if len(start) else np.zeros(0, np.uint64)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] = same
        twice[:-1] |= same
        at = start[order[twice]]
        yield n, at, key[twice]
        start = np.sort(at)


def _inside(n: int, at: np.ndarray, size: int) -> np.ndarray:
    """Which of ``size`` words lie in n-grams that start at the given ones."""
    edge = np.bincount(at, minlength=size + 1) - np.bincount(at + n, minlength=size + 1)
    return np.cumsum(edge[:size]) > 0


def repeated_words(ids: np.ndarray, doc: np.ndarray, lengths: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each n: which words lie in an n-gram that its document has at least twice."""
    for n, at, _ in _repeats(ids, doc, lengths):
        yield n, _inside(n, at, len(ids))


def _top(n: int, at: np.ndarray, key: np.ndarray, doc: np.ndarray, until: np.ndarray, size: int) -> np.ndarray:
    """Per document the most characters that one repeated n-gram has in all its places together.

    ``until`` has the characters before each word and, last, of all words.
    """
    out = np.zeros(size, np.int64)
    if len(key):
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        times, at = np.diff(np.append(first, len(key))), at[first]
        np.maximum.at(out, doc[at], times * (until[at + n] - until[at]))
    return out


def measure(texts: Sequence[str]) -> pd.DataFrame:
    """Counts and verdicts of whole texts, taken together in one pass."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    split = [b.split() for b in raw]
    count = np.array([len(w) for w in split], np.int64)
    words = [w for ws in split for w in ws]
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    doc = np.repeat(np.arange(len(raw)), count)
    if words:
        head = (np.frombuffer(b"".join(words), np.uint8) & 0xC0) != 0x80  # first byte of each code point
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        chars = np.add.reduceat(head.astype(np.int64), np.cumsum(sizes) - sizes)
    else:
        chars = np.zeros(0, np.int64)

    def per_doc(weights: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights, len(raw)).astype(np.int64)

    word_chars = per_doc(chars)
    lines = np.array([_lines(b) for b in raw], np.int64).reshape(-1, 3)
    until = np.concatenate(([0], np.cumsum(chars)))
    top, shares, five = [], [], None
    broken: dict[str, np.ndarray] = {}
    for n, at, key in _repeats(ids, doc, (*TOP_LIMITS, *NGRAM_LIMITS)):
        if n in TOP_LIMITS:
            top.append(np.minimum(1.0, _top(n, at, key, doc, until, len(raw)) / np.maximum(word_chars, 1)))
            broken[f"top_{n}"] = top[-1] > TOP_LIMITS[n]
        else:
            inside = _inside(n, at, len(ids))
            shares.append(per_doc(chars * inside) / np.maximum(word_chars, 1))
            broken[f"repeat_{n}"] = shares[-1] > NGRAM_LIMITS[n]
            if n == 5:
                five = per_doc(inside)
    symbols = np.array([len(b) - len(b.translate(None, _SYMBOLS)) for b in raw], np.int64)
    line_share = lines[:, 1] / np.maximum(lines[:, 2], 1)
    broken["lines"] = line_share > LINE_LIMIT
    broken["symbols"] = symbols > SYMBOL_LIMIT * count
    failed = (count < 10) | (100 * five > 20 * count)
    broken["base"] = failed
    verdicts = np.array(list(broken.values()))
    names = np.array(list(broken))
    return pd.DataFrame({
        "n_words": count, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": lines[:, 0], "n_repeat_words": five,
        "dup_line_share": line_share, "top_shares": list(np.array(top).T), "repeat_shares": list(np.array(shares).T),
        "base_failed": failed, "kept": ~verdicts.any(axis=0), "rejected_by": [names[v].tolist() for v in verdicts.T]})


def _chunks(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK:
            yield texts[start:i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield texts[start:]


def _assessed(texts: pd.Series) -> pd.DataFrame:
    return pd.concat([measure(part) for part in _chunks(texts.tolist())], ignore_index=True) if len(texts) else measure([])


def assess(docs: DataFrame, text: str = "text", name: str = "quality") -> DataFrame:
    """``docs`` with the struct ``quality``: counts, shares inside repetition, the verdict ``kept`` and the rules broken.

    Each row by itself, its whole text; a null text counts as empty and fails.  Rows, ids and
    other columns are left alone; a column of the result's name is replaced.
    """
    return unboxed(boxed(docs), docs.columns, {name: F.pandas_udf(_assessed, SCHEMA)(whole(field(text)))})


def kept(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    found = boxed(docs).withColumn("_quality", F.pandas_udf(_assessed, SCHEMA)(whole(field(text))))
    return unboxed(found.where("_quality.kept"), docs.columns, {})


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: the counts and both verdicts."""
    return assess(docs.select("doc_id", "text")).select(
        "doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                             "base_failed", "kept", "rejected_by")])

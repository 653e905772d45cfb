"""Secret scans through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams: at least one of
its clauses, each clause a set of trigrams that any match must contain.  A scan of the corpus
writes the postings of just those trigrams; intersecting them gives the documents worth
verifying.  A rule whose expression has no mandatory trigram is run over every text.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product
from re import _constants as op, _parser

from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm import spans as sp
from skysieve.llm.text import boxed, field, let, unboxed, whole
from skysieve.session import cut

# The base kinds and public key formats.
_KEYWORDS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = ("assign", "access", "hex")
RULES: tuple[sp.Rule, ...] = (
    sp.Rule("assign", ASSIGN, lambda m, v: F.length(v) >= 12, group=2),
    sp.Rule("access", r"AKIA[A-Z0-9]{14,}"),
    sp.Rule("hex", r"[0-9a-f]{16,}"),
    sp.Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    sp.Rule("github", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    sp.Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    sp.Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    sp.Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)

_MOST = 64  # strings kept while an expression is spelled out


def _clauses(strings: set[str]) -> list[frozenset[str]] | None:
    """Trigrams of each string, without sets that hold another one; None if a string is too short to have any."""
    sets = {frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings}
    return None if frozenset() in sets or not sets else sorted((a for a in sets if not any(b < a for b in sets)), key=sorted)


def _spelled(nodes) -> tuple[list[set[str]], bool]:
    """Sets of strings one of which a match has at each place, and whether they are all of it."""
    runs, current, whole_ = [], {""}, True

    def close() -> None:
        nonlocal current, whole_
        runs.append(current)
        current, whole_ = {""}, False

    def extend(options: set[str]) -> None:
        nonlocal current
        longer = {a + b for a, b in product(current, options)}
        if len(longer) > _MOST:
            close()
            longer = options if len(options) <= _MOST else {""}
            if longer == {""}:
                return
        current = longer

    for kind, arg in nodes:
        if kind is op.LITERAL:
            extend({chr(arg).lower()})
        elif kind is op.IN:
            chars = set()
            for what, x in arg:
                if what is op.LITERAL:
                    chars.add(chr(x).lower())
                elif what is op.RANGE and x[1] - x[0] < _MOST:
                    chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            if chars is None or len(chars) > 8:
                close()
            else:
                extend(chars)
        elif kind is op.SUBPATTERN or kind is op.BRANCH:
            branches = arg[1] if kind is op.BRANCH else [arg[3]]
            parts = [_spelled(b) for b in branches]
            if all(full for _, full in parts):
                extend(set().union(*(runs_[0] for runs_, _ in parts)))
            else:
                close()
                if len(parts) == 1:
                    runs.extend(parts[0][0])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, body = arg
            inner, full = _spelled(body)
            if full and high == 1:
                extend(inner[0] | ({""} if low == 0 else set()))
            elif full and low == high and low <= 8:
                for _ in range(low):
                    extend(inner[0])
            else:
                if low and full:
                    extend(inner[0])
                close()
        elif kind is not op.AT:
            close()
    runs.append(current)
    return runs, whole_


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """Boolean query of an expression: all of the list's entries, each any of its clauses, each all of its trigrams.

    Trigrams are in lower case, so one index serves expressions of either case.  An empty list
    means that no trigram is mandatory.
    """
    runs, _ = _spelled(_parser.parse(pattern))
    return [c for c in map(_clauses, runs) if c]


def index(docs: DataFrame, trigrams: Sequence[str], key: str = "_key", text: str = "_text") -> DataFrame:
    """Postings ``(trigram, key)`` of the given trigrams, written as a table."""
    vocabulary = F.array(*[F.lit(t) for t in trigrams])
    held = let(F.lower(F.col(text)), lambda low: F.filter(vocabulary, low.contains))
    return cut(docs.select(key, F.explode(held).alias("trigram")), "postings")


def candidates(postings: DataFrame, queries: dict[str, list[list[frozenset[str]]]], key: str = "_key") -> DataFrame:
    """``(key, kinds)``: the documents whose postings satisfy the query of at least one kind.

    A document's postings meet in one row of at most as many trigrams as the index knows.
    """
    have = postings.groupBy(key).agg(F.collect_set("trigram").alias("have"))

    def holds(query) -> Column:
        ok = F.lit(True)
        for clauses in query:
            some = F.lit(False)
            for clause in clauses:
                some = some | (F.size(F.array_except(F.array(*[F.lit(t) for t in sorted(clause)]), F.col("have"))) == 0)
            ok = ok & some
        return ok

    kinds = F.filter(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return have.select(key, kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def scan(docs: DataFrame, rules: Sequence[sp.Rule] = RULES, text: str = "text", name: str = "secrets") -> DataFrame:
    """``docs`` with ``secrets``: sorted spans ``(start, rank, end, kind, score)`` of all rules in the whole text.

    Null and empty texts have no spans.  Every row is answered by itself: equal rows, repeated or
    null ids keep their rows; a column of the result's name is replaced, others pass through.
    """
    ids = [field(c) for c in docs.columns if c.lower() == "doc_id"]
    return unboxed(_found(boxed(docs), ids, whole(field(text)), rules), docs.columns, {name: F.col("_spans")})


def _found(base: DataFrame, ids: list[Column], text: Column, rules: Sequence[sp.Rule]) -> DataFrame:
    """A boxed frame with its spans."""
    base = base.withColumn("_key", F.xxhash64(*ids, text))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q}
    vocabulary = sorted({t for q in indexed.values() for clauses in q for c in clauses for t in c})
    if indexed:
        found = candidates(index(base.select("_key", text.alias("_text")), vocabulary), indexed)
        base = base.join(cut(found, "candidates"), "_key", "left")
    else:
        base = base.withColumn("_kinds", F.lit(None).cast("array<string>"))

    def spans_of(rule: sp.Rule, rank: int) -> Column:
        spans = sp.find(text, rule, rank)
        if rule.kind not in indexed:
            return spans
        return F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(F.array().cast(f"array<{sp.SPAN}>"))

    every = F.array_sort(F.concat(*[spans_of(r, i) for i, r in enumerate(rules)]))
    return base.withColumn("_spans", every)


def redact(docs: DataFrame, rules: Sequence[sp.Rule] = RULES, text: str = "text") -> DataFrame:
    """The same rows and columns, every secret in ``text`` replaced by its kind in brackets; ``n_chars`` follows.

    Texts without a secret, null ones included, stay as they are.
    """
    ids = [field(c) for c in docs.columns if c.lower() == "doc_id"]
    found = _found(boxed(docs), ids, whole(field(text)), rules).withColumn("_clean", sp.masked(field(text), F.col("_spans")))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_clean").alias(c)
        if c == "n_chars":
            return F.when(F.size("_spans") > 0, F.length("_clean").cast(dict(docs.dtypes)[c])).otherwise(field(c)).alias(c)
        return field(c).alias(c)

    return found.select(*[column(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of their places and all places."""
    found = scan(docs.select("doc_id", "text"))
    s = F.col("secrets")
    return found.select(
        "doc_id", *[sp.count_of(s, k).alias(f"n_{k}") for k in BASE],
        F.sha2(sp.joined(s, BASE), 256).alias("base_sha256"), sp.joined(s).alias("spans"))

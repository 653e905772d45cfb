"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust a score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm import spans as sp
from skysieve.llm.text import boxed, field, let, unboxed, whole

BASE = ("email", "ip", "card", "phone")


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _figures(digits: Column) -> Column:
    return F.transform(F.split(digits, ""), lambda c: c.cast("int"))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.reverse(_figures(digits)), lambda d, i: F.when(i % 2 == 0, d).otherwise(
            F.when(d > 4, d * 2 - 9).otherwise(d * 2))), F.lit(0), lambda a, d: a + d)
    return total % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number of letters and digits has remainder 1 by 97, its first four characters last."""
    moved = F.concat(F.substring(code, 5, 64), F.substring(code, 1, 4))
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(
        c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))
    return rest == 1


_PART = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def _card(match: Column, _: Column) -> Column:
    return let(_digits(match), luhn)


def _phone(match: Column, _: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def a_word(words: str) -> str:
    """An expression for one of the words, not as a part of a longer one."""
    return rf"(?:^|[^a-z0-9_])(?:{words})(?:$|[^a-z0-9_])"


def _near(start: int, words: str, gain: int, against: str = "", loss: int = 0):
    """A score that starts at ``start`` and moves with the words around a match."""

    def score(around: Column, match: Column) -> Column:
        value = F.lit(start) + F.when(around.rlike(a_word(words)), gain).otherwise(0)
        if against:
            value = value - F.when(around.rlike(a_word(against)), loss).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), value))

    return score


NOT = "example|sample|order|invoice|version|isbn|tracking"
# The base kinds match what the plain expressions match; look-behinds and possessive parts only
# keep long runs of text linear.
RULES: tuple[sp.Rule, ...] = (
    sp.Rule("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
            score=_near(90, "mail|e-mail|email|contact|write", 10), gate=lambda t: t.contains("@")),
    sp.Rule("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
            lambda m, _: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), score=_near(60, "ip|address|host|server|login", 30, NOT, 30)),
    sp.Rule("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
            _card, score=_near(80, "card|visa|credit|debit|pay|payment", 20, NOT, 30)),
    sp.Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, score=_near(70, "phone|tel|call|mobile|fax", 30),
            gate=lambda t: t.contains("+")),
    sp.Rule("iban", r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}+(?![A-Z0-9])", lambda m, _: mod97(m),
            score=_near(80, "iban|account|bank|transfer", 20)),
    sp.Rule("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
            score=_near(40, "ssn|social security|national id|tax id", 40, NOT, 20), floor=60),
)


def detect(docs: DataFrame, rules: Sequence[sp.Rule] = RULES, text: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with ``pii``: sorted spans ``(start, rank, end, kind, score)`` over the whole text.

    One projection without a shuffle.  Null and empty texts have no spans; repeated rows and ids
    are answered row by row; a column of the result's name is replaced, others pass through.
    Spans of the base kinds stay whatever their score; ``ssn`` needs a word nearby.
    """
    return unboxed(boxed(docs), docs.columns, {name: _spans(whole(field(text)), rules)})


def _spans(text: Column, rules: Sequence[sp.Rule]) -> Column:
    return F.array_sort(F.concat(*[sp.find(text, r, i) for i, r in enumerate(rules)]))


def redact(docs: DataFrame, rules: Sequence[sp.Rule] = RULES, text: str = "text") -> DataFrame:
    """The same rows and columns with every span replaced by its kind in brackets."""
    found = boxed(docs).withColumn("_spans", _spans(whole(field(text)), rules))
    return found.select(*[(sp.masked(field(c), F.col("_spans")) if c == text else field(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, a hash of their places, all places and scores."""
    found = detect(docs.select("doc_id", "text"))
    s = F.col("pii")
    return found.select(
        "doc_id", *[sp.count_of(s, k).alias(f"n_{k}") for k in BASE],
        F.sha2(sp.joined(s, BASE), 256).alias("base_sha256"), sp.joined(s).alias("spans"),
        F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"))

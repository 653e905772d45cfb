"""Places of regular-expression matches as column expressions.

Splitting a text at a pattern gives the gaps between the same leftmost, non-overlapping matches
that extraction gives, so the lengths of both add up to the places, in code points.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from skysieve.llm.text import let

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:int>"
_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """A kind of span: a pattern, the group that holds the value, and a test of (match, value).

    ``score`` of (surroundings, match) is a column of 0 to 100; only spans of rules with a
    ``floor`` are dropped for a low one.
    """

    kind: str
    pattern: str
    keep: Callable[[Column, Column], Column] | None = None
    group: int = 0
    score: Callable[[Column, Column], Column] | None = None
    floor: int = 0
    gate: Callable[[Column], Column] | None = None


def _places(steps: Column) -> Column:
    """Sum of all earlier steps for each step, in blocks so that long lists stay cheap."""
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")),
        lambda b: F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK)))

    def inside(before: Column, block: Column) -> Column:
        return F.aggregate(
            block, F.struct(before.alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, s: F.struct((acc["at"] + s).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")),
            lambda acc: acc["out"])

    def all_blocks(bs: Column) -> Column:
        sums = F.transform(bs, lambda x: F.aggregate(x, F.lit(0), lambda a, s: a + s))
        return let(sums, lambda totals: F.flatten(F.transform(bs, lambda x, i: inside(
            F.aggregate(F.slice(totals, F.lit(1), i), F.lit(0), lambda a, s: a + s), x))))

    return let(blocks, all_blocks)


def find(text: Column, rule: Rule, rank: int, around: int = 40) -> Column:
    """Spans of one rule in ``text``, by start."""
    pattern, none = F.lit(rule.pattern), F.array().cast(f"array<{SPAN}>")
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    pieces = F.zip_with(found, F.split(text, pattern, -1), lambda m, gap: F.struct(
        m.alias("m"), F.length(gap).alias("gap"), F.length(m).alias("n")))
    pieces = F.filter(pieces, lambda p: p["m"].isNotNull())  # one gap more than matches
    if rule.group:
        pieces = F.zip_with(pieces, F.regexp_extract_all(text, pattern, F.lit(rule.group)),
                            lambda p, v: F.struct(p["m"].alias("m"), p["gap"].alias("gap"), p["n"].alias("n"), v.alias("v")))
    places = let(pieces, lambda ps: F.zip_with(
        ps, let(F.transform(ps, lambda p: p["gap"] + p["n"]), _places),
        lambda p, at: F.struct(p["m"].alias("m"), p["v" if rule.group else "m"].alias("v"),
                               (at + p["gap"]).alias("start"), (at + p["gap"] + p["n"]).alias("end"))))
    if rule.keep is not None:
        places = F.filter(places, lambda p: rule.keep(p["m"], p["v"]))

    def span(p: Column) -> Column:
        near = F.substring(text, F.greatest(p["start"] - around, F.lit(0)) + 1,
                           p["end"] - p["start"] + around + F.least(p["start"], F.lit(around)))
        score = rule.score(F.lower(near), p["m"]) if rule.score else F.lit(100)
        return F.struct(p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"),
                        F.lit(rule.kind).alias("kind"), score.cast("int").alias("score"))

    spans = F.transform(places, span)
    if rule.floor:
        spans = F.filter(spans, lambda s: s["score"] >= rule.floor)
    may = text.rlike(rule.pattern) if rule.gate is None else rule.gate(text) & text.rlike(rule.pattern)
    return F.when(may, spans.cast(f"array<{SPAN}>")).otherwise(none)


def joined(spans: Column, kinds: Sequence[str] | None = None) -> Column:
    """``kind:start:end`` of sorted spans, comma-joined; of some kinds only if they are given."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(list(kinds)))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def masked(text: Column, spans: Column, label: str = "[{}]") -> Column:
    """The text with each span replaced by its kind; spans that overlap become one, named by its first."""
    before, after = label.split("{}")
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        parts = F.when(new, F.array(
            F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit(before), s["kind"], F.lit(after))
        )).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], parts).alias("out"))

    done = F.aggregate(spans, state, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)

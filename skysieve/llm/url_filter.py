"""URL filters: a fixed policy of host and path rules, then rules mined from labelled URLs.

FP-growth finds combinations of URL tokens that come with a bad label; the ones with enough
support and confidence, and without a shorter rule that is as sure, block a URL.  Rules are
found through an inverted index from one of their tokens.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from skysieve.llm.text import boxed, field, let, unboxed
from skysieve.session import cut

# The policy, longest fitting rule first to win.
POLICY: tuple[tuple[str, str], ...] = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"),
    ("block", "org/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD, GOOD = "=bad", "=good"
KINDS = ("host", "label", "path", "query", "domain", "ending", "fragment", "scheme")  # rare ones first


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 1), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """From the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _PARTS, 2)


def policy_rule(host_: Column, path_: Column, policy: Sequence[tuple[str, str]] = POLICY) -> Column:
    """Longest fitting rule as ``struct(length, rule, verdict)``, null if none fits.

    The policy is looked up by every suffix of the host that begins at a label.
    """
    by_host: dict[str, list[Column]] = {}
    for verdict, rule in policy:
        at = rule.index("/")
        by_host.setdefault(rule[:at], []).append(F.struct(
            F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
            F.lit(rule[at:]).alias("path")))
    if not by_host:
        return F.lit(None).cast("struct<length:int,rule:string,verdict:string,path:string>")
    table = F.create_map(*[x for h, rules in by_host.items() for x in (F.lit(h), F.array(*rules))])
    labels = F.split(host_, r"\.")
    suffixes = let(labels, lambda ls: F.transform(
        F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), ".")))
    fitting = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda r: r.isNotNull()))
    return F.array_max(F.filter(fitting, lambda r: F.startswith(path_, r["path"])))


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, host, its labels but the last, its last two labels, path segments, file ending, query keys, fragment.

    Path segments that are a number, with or without an ending, name single pages and are left out.
    """
    u = F.coalesce(url, F.lit(""))
    h, p = host(url), path(url)
    labels = F.transform(F.filter(F.split(F.regexp_extract(h, r"^(.*)\.", 1), r"\."), lambda s: s != ""), lambda s: F.concat(F.lit("label="), s))
    segments = F.transform(F.filter(F.split(p, "/"), lambda s: (s != "") & ~s.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$")), lambda s: F.concat(F.lit("path="), s))
    keys = F.transform(F.regexp_extract_all(u, F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("query="), k))
    single = F.array(
        F.concat(F.lit("scheme="), F.regexp_extract(u, "^([^:/?#]+)://", 1)),
        F.concat(F.lit("host="), h),
        F.concat(F.lit("domain="), F.substring_index(h, ".", -2)),
        F.concat(F.lit("ending="), F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)),
        F.when(F.contains(u, F.lit("#")), F.lit("fragment=yes")).otherwise(F.lit("fragment=")))
    return F.array_distinct(F.concat(F.filter(single, lambda t: ~F.endswith(t, F.lit("="))), labels, segments, keys))


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.6, min_count: int = 20,
         partitions: int | None = None) -> DataFrame:
    """Rules ``(tokens, confidence, support)`` of ``labelled(url, bad)``, every labelled row a transaction.

    A rule of one token needs ``min_count`` bad transactions, however many there are; its counts
    are one distributed aggregate.  A combination needs ``min_support`` of the transactions as
    well: frequent tokens, which FP-growth keeps on the driver, are then at most (tokens per URL) /
    ``min_support``, whatever the number of rows.  Rows without a label are left out.  A rule goes
    if a part of its tokens alone is as sure.
    """
    label = F.when(F.col("bad"), F.lit(BAD)).otherwise(F.lit(GOOD))
    items = cut(labelled.where("bad IS NOT NULL").select(F.array_union(tokens(F.col("url")), F.array(label)).alias("items")), "items")
    n = max(1, items.count())
    is_bad = F.array_contains("items", BAD)
    alone = items.select(F.explode(F.array_except("items", F.array(F.lit(BAD), F.lit(GOOD)))).alias("token"), is_bad.alias("bad")).groupBy(
        "token").agg(F.count_if("bad").alias("b"), F.count("*").alias("n")).where(
        (F.col("b") >= min_count) & (F.col("b") / F.col("n") >= min_confidence)).select(
        F.array("token").alias("tokens"), (F.col("b") / F.col("n")).alias("confidence"), (F.col("b") / n).alias("support"))
    support = min(1.0, max(min_support, min_count / n))
    fitted = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence)
    model = (fitted.setNumPartitions(partitions) if partitions else fitted).fit(items)
    combined = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.size("antecedent") > 1)).select(
        F.array_sort("antecedent").alias("tokens"), "confidence", "support")
    sure = cut(alone.unionByName(combined), "rules")
    parts = sure.select(F.explode("tokens").alias("anchor"), F.col("tokens").alias("whole"), F.col("confidence").alias("c"))
    shorter = sure.select(F.col("tokens")[0].alias("anchor"), F.col("tokens").alias("part"), F.col("confidence").alias("d"))
    implied = parts.join(shorter, "anchor").where(
        (F.size("part") < F.size("whole")) & (F.size(F.array_except("part", "whole")) == 0) & (F.col("d") >= F.col("c")))
    return sure.join(implied.select(F.col("whole").alias("tokens")).distinct(), "tokens", "left_anti")


def _anchor(rule: Column) -> Column:
    """The token of a rule that most likely is the rarest: by kind, then the first in order."""
    ranks = F.create_map(*[F.lit(x) for at, kind in enumerate(KINDS) for x in (kind, at)])
    keyed = F.transform(rule, lambda t: F.struct(F.try_element_at(ranks, F.substring_index(t, "=", 1)).alias("rank"), t.alias("token")))
    return F.array_min(keyed)["token"]


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Surest rule of each distinct ``url`` that has one: ``(url, mined)``; of equally sure ones the largest text.

    A rule is indexed under one token only, so that a URL meets it once; the URL must have the others as well.
    """
    index = cut(rules.select(_anchor(F.col("tokens")).alias("token"), F.col("tokens").alias("need"), "confidence"), "rule-index")
    seen = urls.where("url IS NOT NULL").select("url", tokens(F.col("url")).alias("have"))
    hit = seen.select("url", "have", F.explode("have").alias("token")).join(index, "token").where(
        F.size(F.array_except("need", "have")) == 0)
    best = F.max(F.struct("confidence", F.array_join("need", " ").alias("need")))
    return hit.groupBy("url").agg(best["need"].alias("mined"))


def judge(pages: DataFrame, rules: DataFrame, policy: Sequence[tuple[str, str]] = POLICY) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``mined``; columns of these names are replaced.

    Policy first, then mined rules, else allow.  Null URLs and URLs without ``://`` have empty
    parts and fit no policy.  Every row is answered, repeated ones alike.  URLs of any length are taken whole.
    """
    base = boxed(pages).withColumn("url", field("url"))
    unknown = base.where("url IS NULL").withColumn("mined", F.lit(None).cast("string"))  # any share of the rows, none to look up
    base = base.where("url IS NOT NULL").join(matches(base.select("url"), rules), "url", "left").unionByName(unknown)
    base = base.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    base = base.withColumn("_policy", policy_rule(F.col("host"), F.col("path"), policy))
    verdict = F.coalesce(F.col("_policy.verdict"), F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return unboxed(base, pages.columns, {"host": F.col("host"), "path": F.col("path"), "rule": F.col("_policy.rule"),
                                         "verdict": verdict, "mined": F.col("mined")})


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``(url, bad)`` of the pages whose document is labelled; the first number of the path names the document.

    Bad is toxic or of low quality.  Repeated labels of a document count once, bad if one is.
    """
    number = F.regexp_extract(path(F.col("url")), r"/([0-9]{1,18})(?![0-9])", 1)
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    return pages.select("url", F.when(number != "", number).cast("long").alias("doc_id")).where("doc_id IS NOT NULL").join(
        known, "doc_id").select("url", "bad")


def digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per page."""
    rules = mine(labelled_urls(pages, labels))
    return judge(pages.select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict", "mined")

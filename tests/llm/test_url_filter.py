"""URL filters against direct computations."""

import itertools
import random

from skysieve.llm import url_filter as u

URLS = [None, "", "no scheme", "http://A.Example.COM/en/7?x=1", "https://example.com/en/71", "x://example.com", "http://net/de/1",
        "http://example.net/de/8x", "http://a.b.example.net/de/9#f", "http://myexample.net/de/8", "http://x.org/es/#q", "http://x.org/esp",
        "http://é.com/en/", "a://b://c/d", "http://notcom/en/", "http://h?en/"]


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0] or [len(rest)])
    host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    return host, tail[: min([i for i in (tail.find(c) for c in "?#") if i >= 0] or [len(tail)])]


def rule_of(host, path):
    fit = []
    for verdict, rule in u.POLICY:
        h, p = rule[: rule.index("/")], rule[rule.index("/"):]
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            fit.append((len(rule), rule, verdict))
    return max(fit, default=(0, None, None))[1:]


def test_policy(spark):
    pages = spark.createDataFrame([(i, x, "clash", "clash") for i, x in enumerate(URLS + URLS[3:5])], "page_id long, url string, host string, need string")
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double")
    rows = u.judge(pages, none).collect()
    assert len(rows) == len(URLS) + 2
    for r in rows:
        h, p = parts(r.url)
        rule, verdict = rule_of(h, p)
        assert (r.host, r.path, r.rule, r.verdict) == (h, p, rule, verdict or "allow"), r.url
        assert r.need == "clash"
    assert u.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rng = random.Random(3)
    data = []
    for i in range(600):
        host, seg, q = rng.choice("abc"), rng.choice(["x", "y"]), rng.choice(["k", "m"])
        bad = (host == "a" and seg == "x" and rng.random() < 0.9) or rng.random() < 0.05
        data.append((f"http://{host}.z/{seg}/?{q}=1", None if i % 50 == 0 else bad))
    got = {tuple(r.tokens): (round(r.confidence, 9), round(r.support, 9)) for r in u.mine(
        spark.createDataFrame(data, "url string, bad boolean"), 0.01, 0.6, 20).collect()}
    known = [x for x in data if x[1] is not None]
    sets = [(frozenset(r.t), b) for r, (_, b) in zip(
        spark.createDataFrame(known, "url string, bad boolean").select(u.tokens(u.F.col("url")).alias("t")).collect(), known)]
    rules = {}
    for n in range(1, 8):
        for combo in itertools.combinations(sorted(set().union(*(s for s, _ in sets))), n):
            hit = [b for s, b in sets if s.issuperset(combo)]
            both = sum(hit)
            if both >= max(20, 0.01 * len(sets)) and both / len(hit) >= 0.6:
                rules[combo] = (round(both / len(hit), 9), round(both / len(sets), 9))
    least = {c: v for c, v in rules.items() if not any(set(d) < set(c) and w[0] >= v[0] for d, w in rules.items())}
    assert got == least and got
    rows = u.judge(spark.createDataFrame([("http://a.z/x/?k=1",), ("http://b.z/x/",), (None,)], "url string"),
                   u.mine(spark.createDataFrame(data, "url string, bad boolean"), 0.01, 0.6, 20)).collect()
    assert sorted((r.url or "", r.verdict) for r in rows) == [("", "allow"), ("http://a.z/x/?k=1", "block"), ("http://b.z/x/", "allow")]


def test_tokens(spark):
    rows = spark.createDataFrame([("https://www.casino-win.Example.com/en/casino24/17/18.html?a=1&b#x",), (None,), ("x://h/",)], "url string").select(
        u.tokens(u.F.col("url")).alias("t")).collect()
    assert set(rows[0].t) == {"scheme=https", "host=www.casino-win.example.com", "domain=example.com", "label=www", "label=casino-win",
                              "label=example", "path=en", "path=casino24", "ending=html", "query=a", "query=b", "fragment=yes"}
    assert rows[1].t == [] and set(rows[2].t) == {"scheme=x", "host=h", "domain=h"}


def test_support_does_not_grow(spark):
    """Twenty bad URLs are enough for a token among any number of others."""
    data = [(f"http://pills{i % 3}.z/x", True) for i in range(60)] + [(f"http://h{i % 500}.z/x", i % 5 == 0) for i in range(15000)]
    got = {r.tokens[0] for r in u.mine(spark.createDataFrame(data, "url string, bad boolean")).where("size(tokens) = 1").collect()}
    assert {f"host=pills{i}.z" for i in range(3)} <= got


def test_rules_decide_pages(spark):
    """The whole ``pages`` table with labels that depend on the URL: mined rules block just the pages they fit."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    bad = u.F.col("url").rlike("://[^/?#]*(casino-win|free-bets|cheap-pills|spam-farm)") | (
        u.F.col("url").rlike("://blog[.]") & u.F.col("url").rlike("utm_source"))
    rules = u.cut(u.mine(pages.select("url", bad.alias("bad"))), "rules")
    needs = {frozenset(r.tokens) for r in rules.collect()}
    assert frozenset(["label=blog", "query=utm_source"]) in needs
    rows = u.judge(pages.withColumn("bad", bad), rules).collect()
    tokens = {r.url: set(r.t) for r in pages.select("url", u.tokens(u.F.col("url")).alias("t")).collect()}
    for r in rows:
        fits = any(need <= tokens[r.url] for need in needs)
        assert (r.mined is not None) == fits
        assert r.verdict == (dict((rule, v) for v, rule in u.POLICY)[r.rule] if r.rule else "block" if fits else "allow")
    for label in ("casino-win", "free-bets", "cheap-pills", "spam-farm"):  # a rule for each label that is frequent enough
        assert (frozenset([f"label={label}"]) in needs) == (sum(f"label={label}" in tokens[r.url] for r in rows) >= 20)
    found = sum(r.bad and r.mined is not None for r in rows)
    assert found >= 0.9 * sum(r.bad for r in rows) > 100
    assert sum(not r.bad and r.mined is not None for r in rows) <= found * 0.4 / 0.6


def test_odd_urls(spark):
    """Ties, null URLs, very long ones: the largest text of equally sure rules wins."""
    rules = spark.createDataFrame([(["label=a"], 0.9, 0.1), (["path=p"], 0.9, 0.1), (["path=long", "scheme=http"], 0.7, 0.1)],
                                  "tokens array<string>, confidence double, support double")
    long = "http://h.z/" + "s/" * 100_000 + "long"
    rows = u.judge(spark.createDataFrame([(x,) for x in ("http://a.z/p", None, None, long, "https://h.z/long")], "url string"), rules).collect()
    assert sorted((r.url or "", r.mined) for r in rows if r.url != long) == [("", None), ("", None), ("http://a.z/p", "path=p"), ("https://h.z/long", None)]
    assert [r.mined for r in rows if r.url == long] == ["path=long scheme=http"]


def test_labels(spark):
    pages = spark.createDataFrame([(1, "http://a/en/7"), (2, "http://a/en/8.html"), (3, None), (4, "http://a/en/99999999999999999999")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (8, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert {r.url: r.bad for r in u.labelled_urls(pages, labels).collect()} == {"http://a/en/7": True, "http://a/en/8.html": False}
    assert u.digest(pages.limit(0), labels.limit(0)).count() == 0

"""URL rules against every rule tried on every URL."""

import random
import re

import pytest

from skein.llm import url_rules as U

ODD = [None, "", "no scheme", "://", "http://", "HTTP://A.ORG/x", "http://a.org", "http://a.org?x=/es/", "http://A.example.org:80/es/", "http://u@example.org/en/1", "http://example.org/en/17", "http://xexample.org/es/", "x://y/?u=http://a.org/", "http://a.com/fr/\n/de/", "http://a.com/FR/", "http://org/", "http://a.ads-track.net/privacy", "http://ads-track.net/privacy/x", "http://ads-track.net/privacy-x", "http://a.net/Ad/x/y.GIF", "http://a.net/ad/x.gif?y", "http://clickbaits.net", "http://a.net/?xxx", "http://a.net/xxxx", "http://é.org/é", "http://a.net/" + "x/" * 20000 + "porn/"]


def _split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def _pattern(pattern):
    body, start, end = pattern.lower(), "", ""
    if body.startswith("||"):
        body, start = body[2:], r"\A[^:/?#]*://(?:[^/?#]*\.)?"
    elif body.startswith("|"):
        body, start = body[1:], r"\A"
    if body.endswith("|"):
        body, end = body[:-1], r"\Z"
    made = "".join({"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\Z)"}.get(c, re.escape(c)) for c in body)
    return re.compile(start + made + end, re.IGNORECASE | re.ASCII)


def _judged(url, sites, patterns):
    host, path = _split(url)
    fit = [(len(h + p), len(h), h + p, v) for v, h, p in sites if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        _, _, rule, verdict = max(fit)
        return host, path, rule, None, verdict
    hits = [(v == "allow", p, v) for v, p in patterns if url is not None and _pattern(p).search(url)]
    return (host, path, None, *(max(hits)[1:] if hits else (None, "allow")))


def _check(spark, urls, sites, patterns, most):
    rows = [(n, u, "clash") for n, u in enumerate(urls)] + [(0, urls[0], "again"), (None, "http://a.com/de/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string").repartition(3)
    given = [None, None] if sites is U.SITE_RULES else [spark.createDataFrame(sites, "verdict string, host string, path string"), spark.createDataFrame(patterns, "verdict string, pattern string")]
    found = [(r["page_id"], r["url"], r["host"], r["path"], r["rule"], r["pattern"], r["verdict"]) for r in U.judge(pages, *given, most_at_once=most).collect()]
    assert sorted(found, key=repr) == sorted(((i, u, *_judged(u, sites, patterns)) for i, u, _ in rows), key=repr)


@pytest.mark.parametrize("most", [U.MOST_AT_ONCE, 0])
def test_against_all_rules_on_all_urls(spark, most):
    _check(spark, ODD, U.SITE_RULES, U.PATTERN_RULES, most)


@pytest.mark.parametrize("most", [U.MOST_AT_ONCE, 0])
def test_many_drawn_rules(spark, most):
    draw = random.Random(4)
    words = ["a", "ab", "abc", "x1", "ads", "org", "com", "z-z"]
    host = lambda: ".".join(draw.choices(words, k=draw.randint(1, 3)))
    path = lambda: "/" + "/".join(draw.choices(words, k=draw.randint(0, 3)))
    urls = [f"{draw.choice(['http', 'https'])}://{host()}{path()}{draw.choice(['', '?a=ab', '#x1', '?q=ads&b=1'])}" for _ in range(300)]
    sites = list({(h, p): (draw.choice(["allow", "block"]), h, p) for h, p in ((host(), draw.choice(["", path()])) for _ in range(60))}.values())
    marks = ["^", "*", "/", ".", "=", "-"]
    patterns = list({p: (draw.choice(["allow", "block"]), p) for p in (draw.choice(["", "|", "||"]) + "".join(draw.choice(words) + draw.choice(marks) for _ in range(draw.randint(1, 3))) + draw.choice(["", "|", "ab"]) for _ in range(120))}.values())
    _check(spark, urls, sites, patterns, most)


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.judge(none).count() == 0
    sites, patterns = spark.createDataFrame([], "verdict string, host string, path string"), spark.createDataFrame([], "verdict string, pattern string")
    for most in (U.MOST_AT_ONCE, -1):
        found = U.judge(spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string"), sites, patterns, most_at_once=most).first()
        assert (found["rule"], found["verdict"]) == (None, "allow")


def test_index_takes_the_rarest_literal(spark):
    urls = spark.createDataFrame([(f"http://common.net/{'rare' if n == 0 else 'often'}/",) for n in range(9)], "url string")
    rules = U.pattern_rules(spark.createDataFrame([("block", "||common.*/rare/often/"), ("block", "/common/often/"), ("block", "open*end"), ("block", "/never/often/")], "verdict string, pattern string"))
    assert {r["rule"]: r["token"] for r in U.indexed(rules, urls).collect()} == {"||common.*/rare/often/": "rare", "/common/often/": "often", "open*end": "", "/never/often/": "never"}


def test_only_candidates_reach_expressions(spark):
    """The plan of the first way shuffles nothing and runs no Python."""
    plan = U.judge(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Join", plan)

"""URL filters: rules are indexed by their rarest literal token, a URL's tokens fetch candidates, and only those run regular expressions.

DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

ALLOW, BLOCK = "allow", "block"
#: Rules of hosts and paths, (verdict, host, path).
SITE_RULES = ((ALLOW, "org", "/"), (BLOCK, "example.org", "/es/"), (BLOCK, "example.org", "/en/1"), (ALLOW, "com", "/fr/"), (BLOCK, "com", "/de/"))
#: Rules of patterns, (verdict, pattern), for URLs that no rule of sites fits. `*` is any text,
#: `^` an end or a mark that no name holds, `||` the begin of a host or of a part of it, `|` an end.
PATTERN_RULES = (
    (BLOCK, "||casino-win."),
    (BLOCK, "||free-bets."),
    (BLOCK, "||cheap-pills."),
    (BLOCK, "||spam-farm."),
    (BLOCK, "||ads-track."),
    (BLOCK, "||adult-x."),
    (BLOCK, "^casino^"),
    (BLOCK, "/porn/"),
    (BLOCK, "^xxx^"),
    (BLOCK, "&affid="),
    (BLOCK, "clickbait"),
    (BLOCK, "/ad/*.gif|"),
    (ALLOW, "||ads-track.*/privacy^"),
)
#: Rules up to this number go to the tasks as one value; more are joined by token.
MOST_AT_ONCE = 5_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _listed(spark: SparkSession, rules: tuple, names: tuple[str, ...]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rules])))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a URL; both empty for null and without `://`."""
    at = F.position(F.lit("://"), F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)


def tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters and digits, in lower case; anything else divides them."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def _literal(text: Column) -> Column:
    """A regular expression for the text as it is written."""
    return F.regexp_replace(text, r"([^\p{L}\p{N}])", r"\\$1")


def site_rules(rules: DataFrame) -> DataFrame:
    """Rules (verdict, host, path) as (site, rank, regex, rule, verdict, literals).

    A rule fits its host and what lies below it, where the path begins with the rule's.
    The expression is for an address, host and path, of which the path is empty or
    begins with a slash. The longest rule ranks first, of two the one with the longer
    host, then by text. literals are the tokens that every URL holds which the rule fits:
    all of the host, and those of the path that a mark of the path follows.
    """
    host, path = ascii_lower(F.col("host")), F.coalesce("path", F.lit(""))
    regex = F.concat(F.lit(r"\A(?:[^/]*\.)?"), _literal(host), F.lit(r"(?=/|\z)"), _literal(path))
    closed = F.concat(host, F.when(path == "", "/").otherwise(path))
    literals = F.array_distinct(F.regexp_extract_all(ascii_lower(closed), F.lit("([a-z0-9]+)[^a-z0-9]"), F.lit(1)))
    rank = F.shiftleft((F.length(host) + F.length(path)).cast("long"), 24) + F.length(host)
    return rules.select(F.lit(True).alias("site"), rank.alias("rank"), regex.alias("regex"), F.concat(host, path).alias("rule"), "verdict", literals.alias("literals"))


def pattern_rules(rules: DataFrame) -> DataFrame:
    """Rules (verdict, pattern) as (site, rank, regex, rule, verdict, literals); letter case aside. Those that allow rank first.

    literals are the tokens between two marks or anchors: one beside `*` or at an open end
    of the pattern may be part of a longer token of a URL.
    """
    low = ascii_lower(F.col("pattern"))
    body = F.regexp_replace(F.regexp_replace(low, r"\A\|\|?", ""), r"\|\z", "")
    regex = F.replace(F.replace(_literal(body), F.lit(r"\*"), F.lit("(?s:.*)")), F.lit(r"\^"), F.lit(r"(?:[^a-z0-9_.%-]|\z)"))
    start = F.when(F.startswith(low, F.lit("||")), r"\A[^:/?#]*://(?:[^/?#]*\.)?").when(F.startswith(low, F.lit("|")), r"\A").otherwise("")
    end = F.when(F.endswith(F.substring(low, 2, 1 << 20), F.lit("|")), r"\z").otherwise("")
    # an anchor is a mark; a wildcard is taken as a letter, so that what touches it isn't a whole token
    shown = F.concat(F.when(start != "", "/").otherwise(""), F.replace(body, F.lit("*"), F.lit("A")), F.when(end != "", "/").otherwise(""))
    literals = F.array_distinct(F.regexp_extract_all(shown, F.lit("(?<=[^a-zA0-9])([a-z0-9]+)(?=[^a-zA0-9])"), F.lit(1)))
    return rules.select(F.lit(False).alias("site"), (F.col("verdict") == ALLOW).cast("long").alias("rank"), F.concat(F.lit("(?i)"), start, regex, end).alias("regex"), F.col("pattern").alias("rule"), "verdict", literals.alias("literals"))


def indexed(rules: DataFrame, urls: DataFrame) -> DataFrame:
    """rules with `token`, that of their literals which fewest URLs hold, ties by text; empty for rules without literals.

    urls (url): all of them are counted, each token once a URL; only tokens of rules are
    counted, so that partial sums have few keys.
    """
    of_rules = rules.select(F.explode("literals").alias("token")).distinct()
    counts = urls.select(F.explode(tokens(F.col("url"))).alias("token")).join(of_rules, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    # a rule with no literal keeps its row by the outer explode
    each = rules.withColumn("_token", F.explode_outer("literals")).join(counts.withColumnRenamed("token", "_token"), "_token", "left")
    rule = ("site", "rank", "regex", "rule", "verdict")
    least = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "_token"))["_token"]
    return each.groupBy(*rule).agg(F.coalesce(least, F.lit("")).alias("token"))


def _verdicts(rows: DataFrame, best: Column) -> DataFrame:
    """rows with what the best rule says, and `allow` where there is none."""
    rows = rows.withColumn("_best", best)
    of = lambda site: F.when(F.col("_best.site") == F.lit(site), F.col("_best.rule"))
    return rows.withColumns({"rule": of(True), "pattern": of(False), "verdict": F.coalesce("_best.verdict", F.lit(ALLOW))}).drop("_best")


def _fits(rule: Column, url: Column, address: Column) -> Column:
    return F.regexp_like(F.when(rule["site"], address).otherwise(url), rule["regex"])


def _candidates(url: Column) -> Column:
    """What a URL looks rules up by: its tokens, and the empty one of rules that have none."""
    return F.concat(tokens(url), F.array(F.lit("")))


#: The order of rules: those of sites before patterns, then by rank, then by text.
_ORDER = ("site", "rank", "rule", "verdict")


def _at_once(rows: DataFrame, index: DataFrame, n_rules: int) -> DataFrame:
    """Each row looks its URL's tokens up in a table of buckets that stands in the plan as a constant: nothing of rows is shuffled."""
    bucket = lambda token: F.pmod(F.xxhash64(token), F.lit(max(1, n_rules))).cast("int")
    rule = F.struct("token", "regex", *_ORDER)
    filled = index.groupBy(bucket(F.col("token")).alias("b")).agg(F.collect_list(rule).alias("rules"))
    held = {r["b"]: r["rules"] for r in filled.collect()}  # n_rules rows at most
    kind = filled.schema["rules"].dataType
    table = F.from_json(F.lit(json.dumps([[r.asDict() for r in held.get(b, [])] for b in range(max(1, n_rules))])), ArrayType(kind))
    fit = lambda token: F.filter(table[bucket(token)], lambda r: (r["token"] == token) & _fits(r, F.col("_url"), F.col("_address")))
    hits = F.flatten(F.transform(_candidates(F.col("_url")), fit))
    return _verdicts(rows, F.array_max(F.transform(hits, lambda r: F.struct(*[r[c].alias(c) for c in _ORDER]))))


def _by_token(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Different URLs are joined with rules by token; adaptive execution splits a token that many hold, and a URL that many rows have."""
    urls = rows.filter("_url <> ''").select("_url", "_address").distinct()
    rule = F.struct("token", "regex", *_ORDER)
    met = urls.withColumn("token", F.explode(_candidates(F.col("_url")))).join(index.select("token", rule.alias("r")), "token")
    met = met.filter(_fits(F.col("r"), F.col("_url"), F.col("_address")))
    best = met.groupBy("_url").agg(F.max(F.struct(*[F.col(f"r.{c}").alias(c) for c in _ORDER])).alias("_found"))
    return _verdicts(rows.join(best, "_url", "left"), F.col("_found")).drop("_found")


def judge(pages: DataFrame, sites: DataFrame | None = None, patterns: DataFrame | None = None, key: str = "page_id", url: str = "url", most_at_once: int = MOST_AT_ONCE) -> DataFrame:
    """(key, url, host, path, rule, pattern, verdict) of every row of pages.

    sites (verdict, host, path) and patterns (verdict, pattern) are the rules, SITE_RULES
    and PATTERN_RULES if not given. The longest site rule that fits decides; without one,
    a pattern that allows, then one that blocks; without any the URL is allowed. rule and
    pattern name what decided.

    A null URL is held by no rule and has an empty host and path, as has one without
    `://`, which patterns may still fit. Rows that repeat are judged alike. No rows give
    no rows; no rules allow all. Other columns of pages are ignored.
    """
    spark = pages.sparkSession
    sites = _listed(spark, SITE_RULES, ("verdict", "host", "path")) if sites is None else sites
    patterns = _listed(spark, PATTERN_RULES, ("verdict", "pattern")) if patterns is None else patterns
    rows = pages.select(F.col(key), F.col(url).cast("string").alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rules = site_rules(sites).unionByName(pattern_rules(patterns))
    n_rules = rules.count()
    index = indexed(rules, rows.select("url"))
    rows = rows.withColumns({"_url": F.coalesce("url", F.lit("")), "_address": F.concat("host", "path")})
    judged = _at_once(rows, index, n_rules) if n_rules <= most_at_once else _by_token(rows, index)
    return judged.select(key, "url", "host", "path", "rule", "pattern", "verdict")

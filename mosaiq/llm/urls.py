"""URL filters: pattern rules behind an index of literal tokens.

Each rule has a regular expression and the literal tokens that every match must hold. The
rule is filed under the one of its tokens that the fewest URLs have; a URL's own tokens fetch
the rules filed under them, and only those run. Of the rules that match, the longest wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import UPPER


@dataclass(frozen=True)
class UrlRule:
    name: str
    verdict: str  # allow or block
    pattern: str  # runs on host followed by path
    tokens: tuple[str, ...]  # lower-case letters and digits; every match has them all
    listed: bool = True  # named in the result


def host_rule(name: str, verdict: str) -> UrlRule:
    """A rule like ``example.net/en/``: that host and its subdomains, paths that begin so."""
    host, _, path = name.partition("/")
    found = tuple(re.findall("[a-z0-9]+", host))
    return UrlRule(name, verdict, rf"^([^/]*\.)?{re.escape(host)}{re.escape('/' + path)}", found)


def word_rule(word: str, verdict: str = "block") -> UrlRule:
    """Hosts with ``word`` as a whole label or between hyphens; may itself have hyphens."""
    return UrlRule(word, verdict, rf"^([^/]*[.-])?{re.escape(word)}[.-][^/]*", tuple(word.split("-")), False)


# The rules of the contract.
LISTED = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
# The method's own words for hosts that no listed rule decides.
WORDS = ["spam-farm", "cheap-pills", "casino", "free-money", "click-bait", "malware", "phishing", "porn", "torrent", "warez", "xxx"]
#: More rules than this go into a table instead of the plan.
MOST_RULES = 10_000
#: Parts that rules without any token are dealt to.
PARTS = 64


def default_rules() -> list[UrlRule]:
    return [host_rule(*x) for x in LISTED] + [word_rule(x) for x in WORDS]


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(after, UPPER, UPPER.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(place: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(place), "[^a-z0-9]+"), ""))


def rarest(pages: DataFrame, rules: list[UrlRule], place: str) -> dict[str, str]:
    """The token to file each rule under, by the URLs that have it. Counts cover all rows;
    there is one for each token of the rules."""
    known = sorted({t for r in rules for t in r.tokens})
    if not known:
        return {}
    counts = pages.select(F.explode(F.array_intersect(_tokens(F.col(place)), F.array(*map(F.lit, known)))).alias("t"))
    seen = {row["t"]: row["count"] for row in counts.groupBy("t").count().collect()}
    return {r.name: min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules if r.tokens}


def rule_table(spark: SparkSession, rules: list[UrlRule]) -> DataFrame:
    """(name, verdict, pattern, tokens, listed), as ``filtered`` takes them."""
    schema = "name string, verdict string, pattern string, tokens array<string>, listed boolean"
    return spark.createDataFrame([(r.name, r.verdict, r.pattern, list(r.tokens), r.listed) for r in rules], schema)


def _joined(pages: DataFrame, rules: DataFrame, url: str) -> DataFrame:
    """The same verdicts with the index as a table. Distinct places are judged once. Rules without
    a token meet every place by a key of ``PARTS`` parts, so no key has all places."""
    df = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    df = df.withColumn("__place", F.concat("host", "path"))
    part = F.concat(F.lit("~"), F.pmod(F.xxhash64("__place"), F.lit(PARTS)))
    places = df.select("__place").distinct()
    tokens = places.select("__place", F.explode(F.array_append(_tokens(F.col("__place")), part)).alias("t"))
    rule = F.struct("listed", F.length("name").alias("n"), "name", "verdict", "pattern").alias("rule")
    known = rules.select(rule, F.array_distinct(F.coalesce("tokens", F.array().cast("array<string>"))).alias("tokens"))
    named = known.select("rule", F.explode("tokens").alias("t"))
    counts = tokens.join(named.select("t").distinct(), "t", "leftsemi").groupBy("t").agg(F.count("*").alias("seen"))
    filed = named.join(counts, "t", "left").groupBy("rule").agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "t"))["t"].alias("t"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.concat(F.lit("~"), k))
    filed = filed.unionByName(known.where(F.size("tokens") == 0).select("rule", F.explode(parts).alias("t")))
    hits = tokens.join(filed, "t").where(F.call_function("rlike", F.col("__place"), F.col("rule.pattern")))
    best = hits.groupBy("__place").agg(F.max("rule").alias("__best"))
    return (
        df.join(best, "__place", "left")
        .withColumn("rule", F.when(F.col("__best.listed"), F.col("__best.name")))
        .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit("allow")))
        .select(*pages.columns, *(c for c in ("host", "path", "rule", "verdict") if c not in pages.columns))
    )


def filtered(pages: DataFrame, rules: list[UrlRule] | DataFrame | None = None, url: str = "url") -> DataFrame:
    """Add host, path, rule (the listed rule that decided, else null) and verdict.

    A null URL or one without ``://`` has an empty host and path and is allowed, as is every
    URL that no rule matches. Listed rules go before the others; of several, the longest name
    wins, then the last by name. Rows are judged one by one, however long a URL is: no shuffle,
    repeated rows and further columns pass through. Rules may come as a table (see
    ``rule_table``); that and more than ``MOST_RULES`` rules are joined instead.
    """
    rules = default_rules() if rules is None else rules
    if isinstance(rules, DataFrame):
        return _joined(pages, rules, url)
    if len(rules) > MOST_RULES:
        return _joined(pages, rule_table(pages.sparkSession, rules), url)
    df = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    df = df.withColumn("__place", F.concat("host", "path"))
    filed = rarest(df.select("__place"), rules, "__place")
    entry = lambda r: F.struct(
        F.lit(r.listed).alias("listed"), F.lit(len(r.name)).alias("n"), F.lit(r.name).alias("name"),
        F.lit(r.verdict).alias("verdict"), F.lit(r.pattern).alias("pattern"),
    )
    index: dict[str, list[Column]] = {}
    always = [entry(r) for r in rules if r.name not in filed]
    for r in rules:
        if r.name in filed:
            index.setdefault(filed[r.name], []).append(entry(r))
    lists = []
    if index:
        table = F.create_map(*(x for t, es in sorted(index.items()) for x in (F.lit(t), F.array(*es))))
        keys = F.array(*(F.lit(t) for t in sorted(index)))
        # Only tokens that are keys get as far as the look-up in the map.
        lists.append(F.flatten(F.transform(F.array_intersect(_tokens(F.col("__place")), keys), lambda t: F.element_at(table, t))))
    if always:
        lists.append(F.array(*always))
    if not lists:
        return df.drop("__place").withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    candidates = F.concat(*lists) if len(lists) > 1 else lists[0]
    df = df.withColumn("__best", F.array_max(F.filter(candidates, lambda r: F.call_function("rlike", F.col("__place"), r["pattern"]))))
    return (
        df.withColumn("rule", F.when(F.col("__best.listed"), F.col("__best.name")))
        .withColumn("verdict", F.coalesce(F.col("__best.verdict"), F.lit("allow")))
        .drop("__place", "__best")
    )


_WORD_SQL = "|".join(WORDS)
ORACLE = rf"""
WITH u AS (SELECT page_id, regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) AS h0,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
h AS (SELECT page_id, coalesce(translate(h0, '{UPPER}', '{UPPER.lower()}'), '') AS host, path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(?s)^([^/]*[.-])?({_WORD_SQL})[.-]') THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filtered(pages).select("page_id", "host", "path", "rule", "verdict")

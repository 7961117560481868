"""URL filters: pattern rules found by their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._names import Named

#: Fixed values: (verdict, host, path) of the base rules.
BASE_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Patterns of the default verdict: they block where no base rule fits.
AD_PATTERNS = ("||ads-track.", "||adserver.", "/adframe.", "/banner/ads/", "||doubleclick.")
#: Rules up to this number (under 1 MB as a table) are broadcast, more are shuffled.
BROADCAST_RULES = 5000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def prefix_rule(verdict: str, host: str, path: str) -> tuple[str, str, str, list[str]]:
    """A rule for a host, its subdomains and a path prefix (empty, or it starts with ``/``).

    Its tokens are those of the host, and those of the path that can't continue in the
    URL: all but the last, unless a separator ends the path.
    """
    pattern = rf"(?s)^(?:[^/]*\.)?{re.escape(host)}{re.escape(path) if path else '(?:/|$)'}"
    inner = _tokens(path) if re.search(r"[^A-Za-z0-9]$", path) else _tokens(path)[:-1]
    return host + path, verdict, pattern, _tokens(host) + inner


def wildcard_rule(verdict: str, text: str) -> tuple[str, str, str, list[str]]:
    """A rule in filter-list form: ``||`` at a label of the host, ``*``, ``^`` for a
    separator or the end; anything else is literal."""
    body, anchor = (text[2:], r"(?s)^(?:[^/]*\.)?") if text.startswith("||") else (text, "(?s)")
    parts = [{"*": ".*", "^": r"(?:[^A-Za-z0-9._%-]|$)"}.get(c) or re.escape(c) for c in body]
    pattern = anchor + "".join(parts)
    whole = re.findall(r"(?<![A-Za-z0-9*])[A-Za-z0-9]+(?![A-Za-z0-9*])", ("." if text.startswith("||") else "*") + body + "*")
    return text, verdict, pattern, [t.lower() for t in whole]


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str, list[str]]]) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string, pattern string, tokens array<string>")


def judge_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default_rules: DataFrame | None = None,
               broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to ``pages``.

    ``rules`` has (rule, verdict, pattern, tokens), see ``prefix_rule`` and
    ``wildcard_rule``; patterns are matched against host + path.  Every rule
    is filed under the one of its literal tokens that the fewest distinct URLs have.
    The tokens of a URL fetch the rules filed under them, and only those run their
    regular expression.  The longest rule that fits wins, of equals the first by code
    point.  Where none fits, ``rule`` is null and the verdict comes from
    ``default_rules`` in the same way, else it is ``allow``.  Rules without a token are
    candidates for every URL.

    Equal URLs are judged once.  A null URL, or one without ``://``, has empty host and
    path and is allowed unless a rule fits them.  Repeated rows get equal values, an
    empty table stays empty.  Columns may have any names; those with the names
    of added ones are replaced.
    """
    named = Named(pages, ["host", "path", "rule", "verdict"])
    pages, url = named.df, F.coalesce(F.col(named.plain(url_col)), F.lit(""))
    urls = pages.select(url.alias("_url")).distinct()
    urls = urls.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    line = F.concat("_host", "_path")
    # the empty token fetches the rules that have none
    tokens = F.array_distinct(F.concat(F.split(F.lower(line), "[^a-z0-9]+"), F.array(F.lit(""))))
    probes = urls.select("_url", line.alias("_line"), F.explode(tokens).alias("token"))
    filed = rules.withColumn("level", F.lit(0))
    if default_rules is not None:
        filed = filed.unionByName(default_rules.withColumn("level", F.lit(1)))
    filed = filed.dropDuplicates(["rule", "level"])
    small = filed.count() <= broadcast_rules
    share = (lambda df: F.broadcast(df)) if small else (lambda df: df)
    own = filed.select("rule", "level", F.explode(F.when(F.size("tokens") > 0, F.col("tokens"))
                                                  .otherwise(F.array(F.lit("")))).alias("token"))
    known = share(own.select("token").distinct())
    counts = probes.join(known, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "token", "left").groupBy("rule", "level").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)), F.col("token"))).alias("best"))
    index = filed.select("rule", "level", "verdict", "pattern").join(rarest, ["rule", "level"]).select(
        F.col("best.token").alias("token"), "rule", "level", "verdict", "pattern")
    fits = probes.join(share(index), "token").where(F.regexp_like("_line", F.col("pattern")))
    won = fits.groupBy("_url").agg(F.min(F.struct(
        "level", (-F.length("rule")).alias("len"), "rule", "verdict")).alias("w"))
    verdicts = urls.join(won, "_url", "left").select(
        F.col("_url").alias("_key"), "_host", "_path", F.when(F.col("w.level") == 0, F.col("w.rule")).alias("rule"),
        F.coalesce("w.verdict", F.lit("allow")).alias("verdict"))
    out = pages.join(verdicts, url == F.col("_key"))
    return named.back(out, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", "verdict")


def base_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = BASE_RULES) -> DataFrame:
    return rule_table(spark, [prefix_rule(*r) for r in rules])


def ad_rules(spark: SparkSession) -> DataFrame:
    return rule_table(spark, [wildcard_rule("block", p) for p in AD_PATTERNS])

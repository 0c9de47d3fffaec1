"""URL rules: host and path rules, and patterns indexed by their rarest literal token.

Each pattern names literal tokens that any URL it matches must hold. Of these
the one that the fewest URLs hold becomes its key, counted over all URLs; the
tokens of a URL fetch the patterns of that key, and only those run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.names import free_name


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the lower-case URL, tokens it needs ([a-z0-9]+), and its verdict."""

    name: str
    regex: str
    tokens: tuple[str, ...]
    verdict: str = "block"


def host(url: Column) -> Column:
    """What stands between the first :// and the next / ? # or the end, A-Z lowered; empty without ://."""
    found = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(of_host: Column, of_path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) struct of the longest (verdict, host/path) rule that fits a host or its parents and starts the path; null if none."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((of_host == rule[:at]) | of_host.endswith("." + rule[:at])) & of_path.startswith(rule[at:])
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    return F.array_distinct(F.split(F.lower(url), "[^a-z0-9]+"))


def rarest_tokens(urls: DataFrame, patterns: list[Pattern]) -> dict[str, str]:
    """Key of each pattern: the token of its own that the fewest of all ``urls`` hold. At most one row per rule token comes to the driver."""
    known = sorted({t for p in patterns for t in p.tokens})
    held = urls.select(F.explode(tokens(F.col("url"))).alias("token")).where(F.col("token").isin(known))
    seen = {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {p.name: min(p.tokens, key=lambda t: (seen.get(t, 0), t)) for p in patterns}


def matches(urls: DataFrame, patterns: list[Pattern]) -> DataFrame:
    """(url, pattern, verdict) of every pattern that matches a URL of ``urls`` (url, all different)."""
    spark = urls.sparkSession
    key = rarest_tokens(urls, patterns)
    index = spark.createDataFrame([(key[p.name], p.name, p.regex, p.verdict) for p in patterns], "token string, pattern string, regex string, verdict string")
    asked = urls.select("url", F.explode(tokens(F.col("url"))).alias("token"))
    candidates = asked.join(F.broadcast(index), "token")  # as many rows as the caller's list of patterns
    return candidates.where(F.expr("lower(url) rlike regex")).select("url", "pattern", "verdict")


def judge(pages: DataFrame, rules: list[tuple[str, str]], patterns: list[Pattern], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, verdict and patterns (names, sorted).

    A host and path rule decides; else a matching block pattern blocks, else the
    page is allowed. Null URLs and URLs without :// have an empty host and path,
    no rule, and are judged by the patterns alone (null: allowed). Rows that
    repeat are each judged. Existing columns of these names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "patterns")]
    asked, matched, block, best = (free_name(pages.columns, x) for x in ("_url", "_matched", "_block", "_rule"))
    parted = pages.select(*kept, F.col(url).alias(asked))
    hit = matches(parted.where(F.col(asked).isNotNull()).select(F.col(asked).alias("url")).distinct(), patterns)
    told = hit.groupBy("url").agg(F.array_sort(F.collect_set("pattern")).alias("patterns"), F.max((F.col("verdict") == "block").cast("int")).alias(block)).withColumnRenamed("url", matched)
    joined = parted.join(told, F.col(asked) == F.col(matched), "left").withColumn("host", host(F.col(asked))).withColumn("path", path(F.col(asked)))
    fit = joined.withColumn(best, best_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col(block) == 1, "block").otherwise("allow")
    return fit.select(*kept, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", own).alias("verdict"), F.coalesce("patterns", F.array().cast("array<string>")).alias("patterns"))

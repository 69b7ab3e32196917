"""URL filter by rules and by an empirical-Bayes reputation of hosts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.frames import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Share of a level's variation that lies between its members, at least and at most.
LEAST_SHARE, MOST_SHARE = 0.001, 0.999


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url; both empty for null and where ``://`` is missing."""
    rest = F.when(F.locate("://", url) > 0, F.substr(url, F.locate("://", url) + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls.

    ``rules`` are (``host/path``, verdict). A rule fits its host and all subdomains, where the path
    begins with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + tail))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain, taken as the last two labels, and suffix, the last one; ports are left out."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    return F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)


def reputations(outcomes: DataFrame, hosts: DataFrame, host: str, good: str, z: float = 1.645) -> DataFrame:
    """(host, mean, low, high): the posterior share of good pages of every host of ``hosts``.

    ``outcomes`` has a row per labelled page, ``good`` 1 or 0, null for none. Suffixes are shrunk
    towards the share over all pages, registered domains towards their suffix and hosts towards
    their domain: each level's posterior mean is the next level's prior mean. A level's prior counts
    as many pages as its members' spread around their parents shows (moment estimate of the
    beta-binomial), so that members that differ much trust their own pages. Bounds are ``z``
    posterior deviations from the mean, within 0 and 1. A host without labelled pages has its
    domain's prior; without any labelled page, every mean is one half.

    Outcomes are summed by host before anything meets, however many pages one host has.
    """
    counts = (
        outcomes.where(F.col(good).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count("*").cast("double").alias("n"), F.sum(F.col(good).cast("double")).alias("x"))
    )
    domain, suffix = domain_and_suffix(F.col("host"))
    known = hosts.select(F.col(host).alias("host")).dropna().distinct().join(counts, "host", "left").na.fill(0.0, ["n", "x"])
    members = checkpointed(known.withColumn("domain", domain).withColumn("suffix", suffix))
    domains = members.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"))
    top = whole.select(F.expr("case when n > 0 then x / n else 0.5D end").alias("prior"))
    level = _shrunk(suffixes.withColumn("prior", top.scalar()), z)
    level = _shrunk(domains.join(level.select("suffix", F.col("mean").alias("prior")), "suffix"), z)
    level = _shrunk(members.join(level.select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]), z)
    return level.select("host", "mean", "low", "high")


def _shrunk(level: DataFrame, z: float) -> DataFrame:
    """``level`` (n, x, prior) with its posterior ``mean``, ``low`` and ``high``."""
    spread = level.agg(
        F.sum(F.expr("case when n > 0 then n * power(x / n - prior, 2) else 0D end")).alias("between"),
        F.sum(F.expr("case when n > 0 then prior * (1 - prior) else 0D end")).alias("within"),
        F.sum(F.expr("case when n > 0 then (n - 1) * prior * (1 - prior) else 0D end")).alias("room"),
    )
    # E[n (p - prior)^2] = prior (1 - prior) (1 + (n - 1) share), summed over the members.
    share = F.expr("case when room > 0 then (between - within) / room else 0D end")
    share = F.greatest(F.lit(LEAST_SHARE), F.least(F.lit(MOST_SHARE), share))
    strength = spread.select(((1 - share) / share).alias("strength"))
    a, b = F.expr("prior * strength + x"), F.expr("(1 - prior) * strength + n - x")
    found = level.withColumn("strength", strength.scalar()).withColumn("_a", a).withColumn("_b", b)
    found = found.withColumn("mean", F.expr("_a / (_a + _b)"))
    width = z * F.sqrt(F.expr("mean * (1 - mean) / (_a + _b + 1)"))
    return (
        found.withColumn("low", F.greatest(F.lit(0.0), F.col("mean") - width))
        .withColumn("high", F.least(F.lit(1.0), F.col("mean") + width))
        .drop("_a", "_b", "strength", "prior")
    )


def judged(
    pages: DataFrame, columns: list[str], url: str, rules: Sequence[tuple[str, str]], least: float = 0.5, z: float = 1.645
) -> DataFrame:
    """``columns`` of every page with host, path, rule and verdict (allow or block).

    The rule's verdict holds where one fits. Those pages are the labelled outcomes from which hosts
    get their reputation; any other page is blocked if the upper bound of its host's share of
    allowed pages is below ``least``, that is, where the host is surely bad, and allowed otherwise.
    Null, empty and broken urls share the empty host. Equal rows are judged alike.
    """
    host, path = host_and_path(F.col(url))
    split = pages.select(*columns, host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = split.withColumn("rule", rule).withColumn("_says", verdict)
    outcomes = ruled.select("host", (F.col("_says") == "allow").cast("int").alias("good"))
    by_host = reputations(outcomes, outcomes, "host", "good", z).select("host", "high")
    found = ruled.join(by_host, "host", "left")
    method = F.when(F.col("high") < least, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(*columns, "host", "path", "rule", F.coalesce("_says", method).alias("verdict"))

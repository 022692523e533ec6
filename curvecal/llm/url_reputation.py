"""URL filter: explicit host rules first, then an empirical-Bayes reputation of hosts.

Labelled page outcomes are counted per host. The good rate of a host is shrunk towards its
registered domain, the domain's towards its suffix, and the suffix's towards all pages; how
strongly is estimated at each level from how much the units differ beyond chance (moment
estimate of a beta-binomial). A page is blocked if even the upper bound of its host's
posterior good rate stays under a limit.

Null urls and urls without ``://`` have an empty host and path; the empty host is a host
like any other. Outcomes that are null do not count. Repeated rows count as often as they
occur. Hosts without outcomes take the posterior of their domain or suffix.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strength of a prior when a level has too little to estimate it from, and its limits.
WEAK, LEAST, MOST = 10.0, 1.0, 10_000.0


def lower_ascii(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def url_host(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def registered_domain(host: Column) -> Column:
    return F.regexp_extract(host, r"([^.]*\.)?[^.]*$", 0)


def suffix(host: Column) -> Column:
    return F.regexp_extract(host, r"[^.]*$", 0)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule (``host/path``) as a string, else null."""
    found = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        its_host, its_path = re.fullmatch(r"([^/]*)(/.*)?", rule, re.S).groups()
        fits = ((host == its_host) | host.endswith("." + its_host)) & path.startswith(its_path or "")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def _strength(units: DataFrame) -> float:
    """Prior strength from units with columns n and s (pages, good pages)."""
    r = units.agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("k"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("s2")).first()
    if not r.n or r.k < 2:
        return WEAK
    n, p = float(r.n), r.s / r.n
    chance = p * (1 - p)
    spread = n - r.n2 / n - (r.k - 1)
    if chance <= 0 or spread <= 0:
        return WEAK
    between = (float(r.s2) - n * p * p - chance * (r.k - 1)) / (chance * spread)
    return min(MOST, max(LEAST, 1 / between - 1)) if between > 0 else MOST


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 2.0) -> DataFrame:
    """Posterior of each distinct host: host, n_labelled, rate, low, high.

    ``hosts`` has a column host; ``outcomes`` has host and good (0 or 1). Everything
    beyond three prior strengths and one rate stays in tables.
    """
    seen = (outcomes.where(F.col("good").isNotNull()).groupBy("host")
            .agg(F.count("*").alias("n"), F.sum(F.col("good").cast("double")).alias("s")))
    level = {
        "domain": seen.groupBy(registered_domain(F.col("host")).alias("domain")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
        "suffix": seen.groupBy(suffix(F.col("host")).alias("suffix")).agg(F.sum("n").alias("n"), F.sum("s").alias("s")),
    }
    whole = seen.agg(F.sum("n"), F.sum("s")).first()
    rate = (whole[1] + 1) / (whole[0] + 2) if whole[0] else 0.5
    k_suffix, k_domain, k_host = _strength(level["suffix"]), _strength(level["domain"]), _strength(seen)

    def shrunk(n, s, k, mean):
        return (F.coalesce(F.col(s), F.lit(0.0)) + F.lit(k) * mean) / (F.coalesce(F.col(n), F.lit(0)) + F.lit(k))

    domains = (level["domain"].select("domain", F.col("n").alias("dn"), F.col("s").alias("ds")))
    suffixes = level["suffix"].select("suffix", F.col("n").alias("xn"), F.col("s").alias("xs"))
    out = (hosts.select("host").distinct()
           .withColumns({"domain": registered_domain(F.col("host")), "suffix": suffix(F.col("host"))})
           .join(seen, "host", "left").join(domains, "domain", "left").join(suffixes, "suffix", "left"))
    out = out.withColumn("suffix_mean", shrunk("xn", "xs", k_suffix, F.lit(rate)))
    out = out.withColumn("domain_mean", shrunk("dn", "ds", k_domain, F.col("suffix_mean")))
    out = out.withColumn("rate", shrunk("n", "s", k_host, F.col("domain_mean")))
    half = F.lit(z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.coalesce(F.col("n"), F.lit(0)) + F.lit(k_host + 1)))
    return out.select("host", F.coalesce("n", F.lit(0)).alias("n_labelled"), "rate",
                      (F.col("rate") - half).alias("low"), (F.col("rate") + half).alias("high"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url: str = "url",
               limit: float = 0.5, z: float = 2.0) -> DataFrame:
    """Add host, path, rule, verdict, rate and bounds to every page.

    ``outcomes``: url and good (0, 1 or null) of pages whose quality is known.
    """
    for name in ("host", "path", "rule", "verdict", "n_labelled", "rate", "low", "high"):
        pages = pages.drop(name)
    actions = dict(rules)
    judged = pages.withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    known = outcomes.select(url_host(F.col("url")).alias("host"), "good")
    judged = judged.join(host_reputation(judged, known, z), "host", "left")
    judged = judged.withColumn("rule", rule_for(F.col("host"), F.col("path"), rules))
    given = F.lit(None).cast("string")
    for rule, action in actions.items():
        given = F.when(F.col("rule") == rule, F.lit(action)).otherwise(given)
    return judged.withColumn(
        "verdict", F.coalesce(given, F.when(F.col("high") < limit, F.lit("block")).otherwise(F.lit("allow"))))

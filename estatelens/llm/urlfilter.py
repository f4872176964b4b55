"""URL filter: listed rules first, then empirical-Bayes host reputation. Built-in functions only.

Pages that a rule decides are the labelled outcomes (block is a bad page, allow a good one). A host's rate of bad
pages is shrunk towards its registered domain, the domain's towards its suffix, and the suffix's towards the whole
table, each by a beta-binomial prior whose strength is estimated by moments from the spread of that level. A page
without a rule is blocked when the lower bound of its host's posterior lies above ``max_bad``.

Every level is one combining aggregate, so a host with a third of all pages is summed before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatelens.llm.common import ascii_lower, saved

#: Fixed rules of the contract: (host, path, action).
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Suffixes of two labels, below which a registered domain has three.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in"]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url; both empty for null and for a text without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(host, empty), F.coalesce(path, empty)


def domain_of(host: Column, two: list[str]) -> tuple[Column, Column]:
    """(registered domain, suffix): the last labels of a host without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    pair, triple = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    long = pair.isin(two)
    return F.when(long, triple).otherwise(pair), F.when(long, pair).otherwise(F.substring_index(name, ".", -1))


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, nulls where none does. Equal lengths: the earlier in the list."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, act in reversed(sorted(rules, key=lambda r: -len(r[0]) - len(r[1]))):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, action = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def _level(units: DataFrame, key: str, parent: str | None, up, least: float, most: float) -> DataFrame:
    """Posterior of every value of ``key``: alpha and beta of a Beta, shrunk towards the mean of its parent.

    ``up`` is the parents' table with their ``mean``, or one number as a column. The prior's strength comes from the
    spread of the units' rates around their parents' means (moments, weighted by n), kept within [least, most]; a
    level with no spread to see gets ``most``.
    """
    joined = units.join(up, parent) if parent else units.withColumn("mean", up)
    rate, var = F.col("bad") / F.col("n"), F.col("mean") * (1 - F.col("mean"))
    moments = joined.where("n > 0").agg(F.sum(F.col("n") * F.pow(rate - F.col("mean"), 2)).alias("ss"), F.sum(F.col("n") * var).alias("vn"), F.sum(var).alias("v1"))
    # a beta-binomial with strength m has E[ss] = (m * v1 + vn) / (m + 1)
    m = F.when(F.col("ss") > F.col("v1"), F.least(F.greatest((F.col("vn") - F.col("ss")) / (F.col("ss") - F.col("v1")), F.lit(least)), F.lit(most)))
    strength = moments.select(F.coalesce(m, F.lit(most)).alias("m")).scalar()
    return joined.withColumn("m", strength).select(
        key, *([parent] if parent else []),
        (F.col("bad") + F.col("m") * F.col("mean")).alias("alpha"), (F.col("n") - F.col("bad") + F.col("m") * (1 - F.col("mean"))).alias("beta"))


def reputation(pages: DataFrame, least: float = 1.0, most: float = 100.0) -> DataFrame:
    """(host, mean, sd) of every host's posterior rate of bad pages, from columns host, domain, suffix, action."""
    hosts = saved(pages.groupBy("host", "domain", "suffix").agg(F.count("action").alias("n"), F.count(F.when(F.col("action") == "block", 1)).alias("bad")))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    whole = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("mean")).scalar()
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    s = _level(suffixes, "suffix", None, whole, least, most).select("suffix", mean.alias("mean"))
    d = _level(domains, "domain", "suffix", s, least, most).select("domain", mean.alias("mean"))
    h = _level(hosts.drop("suffix"), "host", "domain", d, least, most)
    total = F.col("alpha") + F.col("beta")
    return h.select("host", mean.alias("mean"), F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1))).alias("sd"))


def judge_urls(pages: DataFrame, url: str = "url", id_col: str = "page_id", rules=RULES, max_bad: float = 0.5, z: float = 1.0, two_label_suffixes=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict and the posterior (bad_mean, bad_low) of every page.

    Null url, or one without ``://``: host and path empty, no rule, judged by the empty host, which has no labelled
    page and so takes its prior. Repeated rows are judged alike and count as often as they stand. An empty table
    gives an empty result. Extra columns are ignored.
    """
    host, path = split_url(F.col(url))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    domain, suffix = domain_of(F.col("host"), list(two_label_suffixes))
    parts = parts.select("*", rule.alias("rule"), action.alias("action"), domain.alias("domain"), suffix.alias("suffix"))
    low = F.col("mean") - z * F.col("sd")
    return parts.join(reputation(parts), "host", "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("action", F.when(low > max_bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("mean").alias("bad_mean"), low.alias("bad_low"))

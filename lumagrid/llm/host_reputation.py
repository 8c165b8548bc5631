"""URL filter by empirical-Bayes host reputation, in DataFrame operations only.

Labelled pages are trials, bad ones successes. Each level's rate is shrunk towards the level above through a
beta-binomial prior: suffix towards all pages, registered domain towards its suffix, host towards its domain. The
strength of each prior comes from the spread of the rates one level down (moment estimate of the intra-class
correlation). A host is blocked when the lower bound of its posterior bad rate passes a limit. Explicit rules win.

The suffix is the last label of a host and the registered domain its last two; longer suffixes go in suffixes.

Defined results: null urls and urls without '://' have empty host and path and are judged as host ''. Pages without a
label only take a verdict; without any label no host is blocked. Labels of one page count once (bad if any says so).
Repeated pages each get a row, and count as trials of their own. Empty tables give empty results; very long urls are like
others; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumagrid.llm.shared import saved

#: (verdict, host, path): the rules that come with the query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

#: Hosts up to which what is known of them is broadcast (at most about 300 bytes each).
HOSTS = 100_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path."""
    rest = F.when(F.contains(url, F.lit("://")), F.substring_index(url, "://", 1))
    rest = F.when(rest.isNotNull(), F.substr(url, F.length(rest) + 4))
    host = F.coalesce(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for say, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones win
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(say)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame, floor: float, ceiling: float) -> float:
    """Prior strength from the spread of rates among groups (k, n, y): 1 / intra-class correlation - 1, within bounds."""
    r = groups.where("n > 0").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("y") * F.col("y") / F.col("n")).alias("yy")).first()
    if not r.k or r.k < 2:
        return ceiling
    p = r.y / r.n
    spread, even = r.yy - r.n * p * p, p * (1 - p)
    room = even * (r.n - r.nn / r.n - (r.k - 1))
    rho = (spread - even * (r.k - 1)) / room if room > 0 else 0.0
    return min(max(1 / rho - 1, floor), ceiling) if rho > 0 else ceiling


def host_reputation(pages: DataFrame, outcomes: DataFrame, suffixes: tuple[str, ...] = (), z: float = 1.645, max_bad: float = 0.5, floor: float = 1.0, ceiling: float = 1000.0) -> DataFrame:
    """pages (page_id, host) and outcomes (page_id, bad 0/1): host, n, y, bad_rate, lower_bound, blocked."""
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    domain, suffix = F.substring_index("host", ".", -2), F.substring_index("host", ".", -1)
    for s in suffixes:
        dots = s.count(".") + 1
        long = F.endswith(F.col("host"), F.lit("." + s)) | (F.col("host") == s)
        domain, suffix = F.when(long, F.substring_index("host", ".", -dots - 1)).otherwise(domain), F.when(long, F.lit(s)).otherwise(suffix)
    hosts = saved(hosts.withColumns({"domain": domain, "suffix": suffix}))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    whole = tops.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    rate = whole.y / whole.n if whole.n else 0.0
    k1, k2, k3 = (_strength(g, floor, ceiling) for g in (tops, domains, hosts))
    tops = tops.select("suffix", ((F.col("y") + k1 * rate) / (F.col("n") + k1)).alias("m1"))
    domains = domains.join(tops, "suffix").select("domain", "suffix", ((F.col("y") + k2 * F.col("m1")) / (F.col("n") + k2)).alias("m2"))
    a, b = F.col("y") + k3 * F.col("m2"), F.col("n") - F.col("y") + k3 * (1 - F.col("m2"))
    mean = a / (a + b)
    low = mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))
    return hosts.join(domains, ["domain", "suffix"]).select("host", "n", "y", mean.alias("bad_rate"), low.alias("lower_bound"), (low > max_bad).alias("blocked"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, **options) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, bad_rate, lower_bound."""
    host, path = split_url(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("bad"))
    known = host_reputation(pages.select("page_id", "host"), outcomes, **options)
    rule, said = rule_of(F.col("host"), F.col("path"), RULES if rules is None else rules)
    known = saved(known.select("host", "bad_rate", "lower_bound", "blocked"))
    # beyond that many hosts the join is a shuffle, whose popular hosts Spark splits (adaptive skew join)
    out = pages.join(F.broadcast(known) if known.count() <= HOSTS else known, "host", "left")
    verdict = F.coalesce(said, F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "bad_rate", "lower_bound")

"""URL filter: explicit host/path rules first, else an empirical-Bayes reputation of the host.

Labelled page outcomes (1 = bad) are counted per host.  The rate of bad pages of a host is shrunk through
beta-binomial priors: global -> suffix -> registered domain -> host, each level's prior centred on its
parent's posterior mean, with a strength fitted to that level's over-dispersion by the method of moments.
A host is blocked when the lower posterior bound of its rate passes the limit.

All of it is aggregation and one join by host; the host table is written first, so that adaptive execution
can split a host with a large share of the pages.

Edge cases: a null url, or one without ://, has empty host and path and falls under no rule; hosts without
labels take their parent's rate; with no labels at all nothing is blocked by the method.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels that the operator knows; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "com.br", "com.cn", "com.mx", "com.ar", "co.in", "co.za", "com.tr", "co.kr")
#: One-sided normal quantile of the posterior bound, and the rate of bad pages beyond which a host is blocked.
Z, LIMIT = 1.645, 0.5


def url_host(url: str) -> Column:
    return F.translate(F.regexp_extract(text_or_empty(url), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: str) -> Column:
    return F.regexp_extract(text_or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_suffix(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def host_domain(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null.  rules: (verdict, "host/path")."""
    chain = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        chain = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chain)
    return chain


def _posterior(k: str, n: str, mean: str, strength: float, to: str) -> list[Column]:
    a, b = F.lit(strength) * F.col(mean) + F.col(k), F.lit(strength) * (1 - F.col(mean)) + F.col(n) - F.col(k)
    return [(a / (a + b)).alias(to), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias(f"{to}_sd")]


def _strength(df: DataFrame, k: str, n: str, mean: str) -> float:
    """Prior observations of a level, from one pass over its counts (one row comes back)."""
    var = F.col(mean) * (1 - F.col(mean))
    rate = F.col(k) / F.col(n)
    r = df.where(F.col(n) > 0).agg(F.sum(F.col(n) * (rate - F.col(mean)) * (rate - F.col(mean)) - var).alias("over"), F.sum(var * (F.col(n) - 1)).alias("room")).first()
    rho = (r["over"] or 0.0) / r["room"] if r["room"] else 0.0
    rho = round(min(max(rho, 0.001), 0.5), 6)
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """outcomes: host, bad (1, 0 or null for no label).  Returns host, n, k, rate, bound, bad_host for every host."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = written(hosts.select("host", host_domain(F.col("host")).alias("domain"), host_suffix(F.col("host")).alias("suffix"), "n", "k"), "url-hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    domains = written(domains, "url-domains")
    suffixes = written(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk")), "url-suffixes")
    total = suffixes.agg(F.sum("sn").alias("n"), F.sum("sk").alias("k")).first()
    base = ((total["k"] or 0) + 0.5) / ((total["n"] or 0) + 1.0)
    s = suffixes.withColumn("mean", F.lit(base))
    s = s.select("suffix", *_posterior("sk", "sn", "mean", _strength(s, "sk", "sn", "mean"), "smean"))
    d = domains.join(s, "suffix")
    d = written(d.select("domain", *_posterior("dk", "dn", "smean", _strength(d, "dk", "dn", "smean"), "dmean")), "url-domain-rates")
    h = hosts.join(d, "domain")
    h = h.select("host", "n", "k", *_posterior("k", "n", "dmean", _strength(h, "k", "n", "dmean"), "rate"))
    bound = F.col("rate") - F.lit(z) * F.col("rate_sd")
    return written(h.select("host", "n", "k", F.round("rate", 6).alias("rate"), F.round(bound, 6).alias("bound"), (F.round(bound, 6) > limit).alias("bad_host")), "url-rates")


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", keep: tuple[str, ...] = (), z: float = Z, limit: float = LIMIT) -> DataFrame:
    """Judges every row of pages: keep columns, host, path, rule, verdict, host_rate, host_bound.

    outcomes: url and bad (0 or 1); urls of pages that have no outcome need not be there.
    """
    judged = pages.select(*keep, url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    known = outcomes.select(url_host("url").alias("host"), F.col("bad").cast("int").alias("bad"))
    hosts = host_reputation(known.unionByName(judged.select("host", F.lit(None).cast("int").alias("bad"))), z, limit)
    out = judged.withColumn("_r", fitting_rule(F.col("host"), F.col("path"), rules)).join(hosts.select("host", "rate", "bound", "bad_host"), "host", "left")
    verdict = F.coalesce(F.col("_r.verdict"), F.when(F.col("bad_host"), "block").otherwise("allow"))
    return out.select(*keep, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), F.col("rate").alias("host_rate"), F.col("bound").alias("host_bound"))

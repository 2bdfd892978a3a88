"""URL filter by rules and empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted by host.  Host rates shrink to
their registered domain's, those to their suffix's, those to the overall rate,
each through a beta prior.  The prior of a row has the posterior mean of its
parent, and a variance of two parts: how far rows lie from their parents,
estimated from the spread of the level's rates (beta-binomial moments), and how
far the parent's own rate is from known, its posterior variance.  So little
evidence above means a weak prior below; nor is a prior ever stronger than the
labelled pages behind it.  A host with labelled pages of its own is blocked if
the lower posterior bound of its bad rate lies over the limit; one without has
the bound of its prior, reported but not acted on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import attach, written

#: Verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Suffixes of more than one label, if the caller gives no table of them; any
#: other host's suffix is its last label.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in")
LIMIT = 0.25
Z = 1.645
LOW_RHO, HIGH_RHO = 1e-4, 0.5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _labels_of_suffix(host: Column, suffixes: Sequence[str]) -> Column:
    """Number of labels of the host's longest suffix in the table, else 1."""
    by_labels: dict[int, list[str]] = {}
    for x in suffixes:
        by_labels.setdefault(x.count(".") + 1, []).append(x)
    out = F.lit(1)
    for n, own in sorted(by_labels.items()):
        out = F.when(F.substring_index(host, ".", -n).isin(own), n).otherwise(out)
    return out


def _last_labels(host: Column, n: Column) -> Column:
    return F.call_function("substring_index", host, F.lit("."), -n)


def suffix_of(host: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    return _last_labels(host, _labels_of_suffix(host, suffixes))


def domain_of(host: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """Registered domain: the suffix and one label more (a host without one: itself)."""
    return _last_labels(host, _labels_of_suffix(host, suffixes) + 1)


def _rho(level: DataFrame) -> float:
    """Share of variance between the rows (n, bad, mean): n (bad / n - mean)^2
    in excess of what drawing alone gives; the largest allowed where no row has
    a second page to tell."""
    spread = F.col("mean") * (1 - F.col("mean"))
    seen, drawn, room = level.filter("n > 0").agg(
        F.sum((F.col("bad") - F.col("n") * F.col("mean")) ** 2 / F.col("n")), F.sum(spread),
        F.sum(spread * (F.col("n") - 1))).first()
    return min(HIGH_RHO, max(LOW_RHO, (seen - drawn) / room)) if room else HIGH_RHO


def _shrunk(level: DataFrame, rho: float | None = None) -> DataFrame:
    """Beta parameters a, b, posterior mean ``post`` and variance ``var`` of
    every row (n, bad, mean, known, behind): the parent's posterior mean and
    variance, and the labelled pages behind the parent."""
    level = written(level, "level")
    rho = F.lit(_rho(level) if rho is None else rho)
    mean, known = F.col("mean"), F.col("known")
    spread = mean * (1 - mean)
    apart = (spread - known) * rho + known                      # variance of a row's rate about the parent's mean
    strength = F.greatest(F.least(spread / apart - 1, F.col("behind") + 1), F.lit(0.01))
    a, b = F.col("bad") + strength * mean, F.col("n") - F.col("bad") + strength * (1 - mean)
    level = level.withColumn("a", a).withColumn("b", b)
    total = F.col("a") + F.col("b")
    return (level.withColumn("post", F.col("a") / total).withColumn("var", F.col("a") * F.col("b") / (total * total * (total + 1)))
            .drop("mean", "known", "behind"))


def reputations(hosts: DataFrame, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``hosts`` (host, n labelled pages, bad among them, weight) with the
    posterior mean ``post``, its variance ``var`` and beta parameters a, b.
    Without any label every mean is one half."""
    hosts = written(hosts.withColumn("domain", domain_of(F.regexp_replace("host", r"^.*@|:[0-9]*$", ""), suffixes))
                    .withColumn("suffix", suffix_of(F.col("domain"), suffixes)), "hosts")
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    overall = (bad + 0.5) / (n + 1)
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    parent = [F.col("post").alias("mean"), F.col("var").alias("known"), F.col("n").alias("behind")]
    domains = written(hosts.groupBy("domain", "suffix").agg(*sums, F.count(F.lit(1)).alias("hosts")), "domains")
    of = domains.groupBy("suffix").agg(*sums, F.count(F.lit(1)).alias("domains"))
    top = {"mean": overall, "known": overall * (1 - overall) / (n + 2), "behind": float(n)}
    of = _shrunk(of.select("*", *[F.lit(float(v)).alias(k) for k, v in top.items()]))
    of = written(of.select("suffix", "domains", *parent), "suffixes")
    of = _shrunk(attach(domains, of, "suffix", "domains"))
    of = written(of.select("domain", "hosts", *parent), "domain_rates")
    return _shrunk(attach(hosts, of, "domain", "hosts"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, limit: float = LIMIT, z: float = Z,
          suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule,
    verdict, bad_rate, lower_bound, host_pages (labelled pages of the host).

    ``outcomes`` (page_id, bad: 0 or 1) labels some pages; several of a page
    count as their mean rounded up, null ids and values are ignored.  A url
    that is null or without ``://`` has an empty host, which has a reputation
    like any other.  ``suffixes`` lists the suffixes of more than one label.
    Repeated rows stay, extra columns are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = (outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy(F.col("page_id").alias("o_id"))
             .agg(F.ceil(F.avg("bad")).cast("long").alias("bad")))
    labelled = rows.select("page_id", "host").join(known, F.col("page_id") == F.col("o_id"), "left")
    hosts = labelled.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
                                         F.count(F.lit(1)).alias("pages"))
    rated = reputations(hosts, suffixes)
    rated = written(rated.select("host", "pages", F.col("n").alias("host_pages"), F.col("post").alias("bad_rate"),
                                 F.greatest(F.lit(0.0), F.col("post") - z * F.sqrt("var")).alias("lower_bound")), "reputations")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = attach(rows, rated, "host", "pages")
    own = F.when((F.col("lower_bound") > limit) & (F.col("host_pages") > 0), "block").otherwise("allow")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"),
                      "bad_rate", "lower_bound", "host_pages")

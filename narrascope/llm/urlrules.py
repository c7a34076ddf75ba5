"""URL verdicts: listed rules first, then host reputation by empirical Bayes.

Labelled outcomes of pages are counted by host, registered domain and suffix: the last label, or the last two where a
country's registry gives out names below a general label (co.uk); the registered domain has one label more.
At each level the rate of good pages is beta-binomial around the posterior mean one level up; how far members of a
level differ, and so how strongly they shrink, is fitted by moments. A host is blocked when the upper bound of its
posterior rate lies under a floor, so that little evidence blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrascope import runtime
from narrascope.llm.joins import join_dealt

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, FLOOR, LEAST, MOST = 2.0, 0.5, 1.0, 1000.0
#: General labels below which countries' registries give out names.
GENERAL = "ac|co|com|edu|go|gob|gov|gouv|mil|ne|net|nom|or|org|sch"
BELOW = rf"(?:{GENERAL})\.[a-z]{{2}}"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits host (or a parent domain) and path: struct(rule, verdict), or null."""
    cases = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases


def domain_of(host: Column) -> Column:
    long, short = F.regexp_extract(host, rf"([^.]+\.{BELOW})$", 1), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(long != "", long).when(short == "", host).otherwise(short)


def suffix_of(host: Column) -> Column:
    long = F.regexp_extract(host, rf"(?:^|\.)({BELOW})$", 1)
    return F.when(long != "", long).otherwise(F.regexp_extract(host, r"([^.]*)$", 1))


def strength(counts: DataFrame, mean: Column) -> DataFrame:
    """One row: the prior strength of a level, from the spread of its members' rates around the overall mean."""
    s = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count("*").alias("m"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"))
    v = mean * (1 - mean)
    spread = F.col("kk") - 2 * mean * F.col("k") + mean * mean * F.col("n")
    rho = (spread - v * (F.col("m") - 1)) / F.nullif(v * (F.col("n") - F.col("nn") / F.col("n") - (F.col("m") - 1)), F.lit(0.0))
    kappa = F.when(rho > 0, 1 / rho - 1).otherwise(F.lit(MOST))
    return s.select(F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.coalesce(kappa, F.lit(MOST)))).alias("kappa"))


def host_verdicts(hosts: DataFrame, outcomes: DataFrame, z: float = Z, floor: float = FLOOR) -> DataFrame:
    """Staged (host, verdict) for every host, from outcomes (host, good 0/1)."""
    seen = runtime.staged(outcomes.where("good is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("k")), "hosts-seen")
    seen = seen.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    domains = seen.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    whole = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n0"), F.coalesce(F.sum("k"), F.lit(0)).alias("k0")).first()
    m0 = (whole["k0"] + 1) / (whole["n0"] + 2)
    ks, kd, kh = (strength(x, F.lit(m0)).first()["kappa"] or MOST for x in (suffixes, domains, seen))  # one number each
    post = lambda k, n, kappa, m: (k + kappa * m) / (n + kappa)
    suffixes = suffixes.select("suffix", post(F.col("k"), F.col("n"), ks, F.lit(m0)).alias("ms"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    d = domains.select("domain", F.col("n").alias("nd"), F.col("k").alias("kd"))
    h = seen.select("host", F.col("n").alias("nh"), F.col("k").alias("kh"))
    # most hosts of a corpus may share one domain or suffix: rows of a key are dealt out
    all_hosts = hosts.select("host").distinct().withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    known = join_dealt(join_dealt(all_hosts.join(h, "host", "left"), runtime.staged(d, "domains"), "domain", "host"), runtime.staged(suffixes, "suffixes"), "suffix", "host")
    md = post(zero(F.col("kd")), zero(F.col("nd")), kd, F.coalesce("ms", F.lit(m0)))
    mean = post(zero(F.col("kh")), zero(F.col("nh")), kh, md)
    upper = mean + z * F.sqrt(mean * (1 - mean) / (zero(F.col("nh")) + kh + 1))
    return runtime.staged(known.select("host", F.when(upper < floor, "block").otherwise("allow").alias("verdict")), "host-verdicts")


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every page. ``labels``: page_id, good (0 or 1, null unknown).

    A null url, or one without ``://``, has empty host and path and is judged with the others of the empty host.
    Rows that repeat a page_id are judged each and share its outcomes; a null page_id has none. A url of any length is
    read whole. Of rules of equal length the first in order of (verdict, host, path) holds. Other columns are ignored,
    whatever their names; without pages there are no rows, without labels all hosts are allowed.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    outcomes = base.select("page_id", "host").join(labels.select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("long").alias("good")), "page_id")
    verdicts = host_verdicts(base, outcomes)
    found = join_dealt(base, verdicts, "host", "page_id").withColumn("_rule", fitting_rule(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", "verdict").alias("verdict"))

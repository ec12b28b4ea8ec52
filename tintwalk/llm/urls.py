"""URL filtering by rules and by empirical-Bayes host reputation.

The outcome of a page is that of the document whose number its path gives (``/language/number``, perhaps with an ending): bad if it is labelled toxic or of
low quality. Labelled pages of a host give counts of bad outcomes, and beta-binomial priors shrink them. The prior of a host is what the rest of its registered
domain shows, whose own prior is what the rest of its suffix shows, and so on up to all pages and the prior ``A``, ``B``: each page counts once for a host. How far
members of a level may lie from what the others show is estimated by moments from how much members differ; a prior is never surer than that, nor than the pages behind
it. A host is blocked if the ``BOUND`` quantile of its beta posterior is above ``RATIO`` times the posterior mean over all pages: it is
worse than the others beyond what chance explains. Rules come before reputation.

Ports and user names are no part of a domain, and an address of numbers is a domain and a suffix of its own.

Defined cases: a null url or one without ``://`` has an empty host and path, a host like any other; repeated rows each get their
verdict, and each counts as a page; labels that repeat for a document count at their worst; hosts without labelled pages have their domain's
posterior; without any labels, or with equal ones only, all pages are allowed but by rule.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tintwalk.llm.common import cut, table

#: (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BOUND, RATIO = 0.05, 1.0
#: Of the beta prior of the share of bad pages (Jeffreys).
A, B = 0.5, 0.5
#: Suffixes of several labels below which names are registered, by default; any other suffix is the last label.
LONG_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, SPLIT, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def item(at: Column) -> Column:
    """The number of the document that a page shows, from its path."""
    return F.regexp_extract(at, r"^/[^/]+/([0-9]{1,18})(?:[./]|$)", 1).try_cast("long")


def site(name: Column) -> Column:
    """A host without user and port."""
    return F.regexp_replace(F.regexp_replace(name, r"^.*@", ""), r":[0-9]*$|\.$", "")


def suffix(name: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The longest of ``suffixes`` that a site ends in, or its last label; an address is its own."""
    return _ending(name, suffixes, 0)


def domain(name: Column, suffixes: Sequence[str] = LONG_SUFFIXES) -> Column:
    """The suffix of a site and the label before it."""
    return _ending(name, suffixes, 1)


def _ending(name: Column, suffixes: Sequence[str], more: int) -> Column:
    lengths = sorted({1, *(s.count(".") + 1 for s in suffixes)})
    found = F.substring_index(name, ".", -1 - more)
    for n in lengths[1:]:
        found = F.when(F.substring_index(name, ".", -n).isin(*[s for s in suffixes if s.count(".") + 1 == n]), F.substring_index(name, ".", -n - more)).otherwise(found)
    return F.when(name.rlike(r"^[0-9]+(\.[0-9]+){3}$|^\[.*\]$"), name).otherwise(found)


def longest_rule(name: Column, at: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct<length, rule, verdict> of the longest rule that fits, or null. Rules are looked up by the ends of the host."""
    by_host: dict[str, list[Column]] = {}
    for rule, verdict in rules:
        head, slash, rest = rule.partition("/")
        entry = F.struct(F.lit(len(rule)).alias("length"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"), F.lit(slash + rest).alias("path"))
        by_host.setdefault(head, []).append(entry)
    if not by_host:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string, path: string>")
    known = F.create_map(*[x for head, entries in by_host.items() for x in (F.lit(head), F.array(*entries))])
    labels = min(max(head.count(".") + 1 for head in by_host), 127)
    ends = F.array_distinct(F.array(*[F.substring_index(name, ".", -i) for i in range(1, labels + 1)]))
    fitting = F.filter(F.flatten(F.filter(F.transform(ends, lambda end: known[end]), lambda found: found.isNotNull())), lambda r: at.startswith(r["path"]))
    return F.array_max(fitting)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Quantiles of beta distributions, by bisection on the incomplete beta function."""
    low, high = np.zeros(len(a)), np.ones(len(a))
    for _ in range(40):
        x = (low + high) / 2
        below = incomplete_beta(x, a, b) < q
        low, high = np.where(below, x, low), np.where(below, high, x)
    return (low + high) / 2


def incomplete_beta(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """P(X <= x) for X of the beta distribution (a, b): its continued fraction, evaluated on the side where it converges fast."""
    flip = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny, value, c, d = 1e-300, np.ones(len(x)), np.ones(len(x)), np.zeros(len(x))
    for i in range(400):
        m = i // 2
        if i == 0:
            step = np.ones(len(x))
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + step * d
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        c = 1 + step / c
        c = np.where(np.abs(c) < tiny, tiny, c)
        value = value * c * d
        if np.abs(c * d - 1).max(initial=0) < 1e-12:
            break
    part = np.clip(front * (value - 1), 0, 1)
    return np.where(flip, 1 - part, part)


def _differing(members: DataFrame, group: str) -> float:
    """The correlation of pages of one of ``members(group, n, k, group_n, group_k)``, by moments: how much the members of a group differ beyond chance, 0 to 1."""
    p = F.col("group_k") / F.col("group_n")
    rows = members.where((F.col("n") > 0) & (F.col("group_k") > 0) & (F.col("group_k") < F.col("group_n")))
    spread = F.sum(F.pow(F.col("k") - F.col("n") * p, 2) / F.col("n") / (p * (1 - p)))
    size = F.sum(F.col("n") - F.col("n") * F.col("n") / F.col("group_n"))
    seen, members_n, groups_n, pages = (float(x or 0) for x in rows.agg(spread, F.count(F.lit(1)), F.count_distinct(group), size).first())
    chance = members_n - groups_n
    return min(max((seen - chance) / (pages - chance), 0.0), 1.0) if pages > chance else 0.0


def _narrowed(mean: Column, weight: Column, n: Column, k: Column, rho: float) -> tuple[Column, Column]:
    """Mean and weight for a member: those of its group, as far as members differ by ``rho``, and n pages more, k of them bad."""
    # a share of this weight has the variance m (1 - m) / (weight + 1); what the member adds to it is m (1 - m) rho
    prior = F.greatest(1 / (1 / (weight + 1) + F.lit(rho)) - 1, F.lit(A + B))
    return (prior * mean + k) / (prior + n), prior + n


def reputation(hosts: DataFrame, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``(host, mean, weight, lower, base)`` from ``hosts(host, n, k)``: labelled pages and bad ones of each host; ``lower`` is a quantile of the
    posterior, ``base`` the mean over all pages."""
    levels = ["host", "domain", "suffix", "all"]
    at = site(F.col("host"))
    hosts = cut(hosts.select("host", "n", "k", domain(at, suffixes).alias("domain"), suffix(at, suffixes).alias("suffix"), F.lit(0).alias("all")), "hosts")
    sums = {"host": hosts}
    for below, name in zip(levels, levels[1:], strict=False):
        keep = levels[levels.index(name) :]
        sums[name] = cut(sums[below].groupBy(*keep).agg(F.sum("n").alias("n"), F.sum("k").alias("k")), name)
    rows = hosts.withColumnsRenamed({"n": "host_n", "k": "host_k"})
    differ = []
    for below, name in zip(levels, levels[1:], strict=False):
        group = sums[name].select(name, F.col("n").alias("group_n"), F.col("k").alias("group_k"))
        differ.append(_differing(sums[below].join(group, name), name))
        rows = rows.join(group.withColumnsRenamed({"group_n": f"{name}_n", "group_k": f"{name}_k"}), name)
    n = lambda name: F.col(f"{name}_n")
    k = lambda name: F.col(f"{name}_k")
    rest = lambda name, below: (n(name) - n(below), k(name) - k(below))
    other_n, other_k = rest("all", "suffix")
    rows = rows.withColumn("mean", (A + other_k) / (A + B + other_n)).withColumn("weight", A + B + other_n)
    for i in (2, 1, 0):
        pages = rest(levels[i], levels[i - 1]) if i else (n("host"), k("host"))
        mean, weight = _narrowed(F.col("mean"), F.col("weight"), *pages, differ[i])
        rows = rows.withColumns({"mean": mean, "weight": weight})
    rows = rows.select("host", "mean", "weight", ((A + k("all")) / (A + B + n("all"))).alias("base"))

    def bounded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            mean, weight = part["mean"].to_numpy(), part["weight"].to_numpy()
            yield part.assign(lower=beta_quantile(BOUND, mean * weight, (1 - mean) * weight))

    return rows.mapInPandas(bounded, "host string, mean double, weight double, base double, lower double")


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, ratio: float = RATIO, suffixes: Sequence[str] = LONG_SUFFIXES) -> DataFrame:
    """``page_id, host, path, rule, verdict, bad_mean, bad_lower, bad_limit`` for each row of ``pages(page_id, url)``; ``labels(doc_id, quality, toxic)``."""
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")).withColumn("item", item(F.col("path")))
    bad = F.coalesce((F.col("toxic") == 1) | (F.col("quality") == 0), F.lit(False)).cast("long")
    outcomes = labels.select(F.col("doc_id").alias("item"), bad.alias("bad")).groupBy("item").agg(F.max("bad").alias("bad"))
    hosts = rows.groupBy("host", "item").count().join(outcomes, "item", "left").groupBy("host")
    hosts = hosts.agg(F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("count"))), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("bad") * F.col("count")), F.lit(0)).alias("k"))
    limit = F.lit(ratio) * F.col("base")
    found = rows.join(reputation(hosts, suffixes), "host").withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("lower") > limit, F.lit("block")).otherwise(F.lit("allow")))
    told = F.col("mean").alias("bad_mean"), F.col("lower").alias("bad_lower"), limit.alias("bad_limit")
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), *told)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))

"""URL filters: allow / block rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (1 good, 0 bad) are counted by host. A host's good rate is
shrunk towards its registered domain, the domain's towards its suffix and the
suffix's towards the whole corpus, each through a beta-binomial prior: its mean is the
parent's posterior mean, its strength comes from the spread of the children's rates by
the method of moments. A host is blocked when the upper bound of its posterior is under
`min_good`, so that hosts with little evidence stay.

Only built-in functions run here. Counts are pre-aggregated by host before they are
shuffled; the joins back to pages are plain equi-joins whose hot keys AQE splits.

Defined cases: a null url, or one without ``://``, has the empty host and path and is
judged by the counts of the empty host; a host of one label is its own domain and
suffix; numeric hosts are their own domain and suffix; repeated pages count each time;
without any labelled page the corpus rate is taken as `rate_if_unknown`, which allows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_small, stash

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    """`host` fits itself and its subdomains; `path` is a prefix of the url's path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Reputation:
    min_good: float = 0.5
    z: float = 1.645
    least_strength: int = 1
    most_strength: int = 1000
    rate_if_unknown: float = 0.9
    #: Suffixes of more than one label, under which names are registered.
    long_suffixes: tuple[str, ...] = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "org.uk")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, nulls if none does. The rules are a parameter: a few hundred at most."""
    if len(rules) > 500:
        raise ValueError("more than 500 rules: keep them as a table and join on host suffixes")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule, verdict = F.when(fits, r.text).otherwise(rule), F.when(fits, r.verdict).otherwise(verdict)
    return rule, verdict


def with_parents(hosts: DataFrame, long_suffixes: Sequence[str]) -> DataFrame:
    """Adds `domain` and `suffix` to rows with `host`."""
    parts = F.split("host", r"\.", -1)
    last = lambda n: F.array_join(F.slice(F.col("_p"), -n, n), ".")
    n, numeric = F.size("_p"), F.col("host").rlike(r"^[0-9.:\[\]]*$")
    longer = (n >= 2) & last(2).isin(*long_suffixes)
    return (
        hosts.withColumn("_p", parts)
        .withColumn("suffix", F.when(numeric | (n < 2), F.col("host")).when(longer, last(2)).otherwise(last(1)))
        .withColumn("domain", F.when(numeric | (n < 2) | longer & (n < 3), F.col("host")).when(longer, last(3)).otherwise(last(2)))
        .drop("_p")
    )


def _strength(children: DataFrame, r: Reputation) -> int:
    """Prior strength of rows (y, n, py, pn) from their spread about the parent's rate p: E sum n (y/n - p)^2 = sum p(1-p)(1 + (n-1) rho)."""
    p = F.col("py") / F.col("pn")
    row = (
        children.where("n > 0")
        .select(F.col("n").cast("double").alias("n"), (F.col("y") / F.col("n") - p).alias("d"), (p * (1 - p)).alias("v"))
        .agg(F.sum(F.col("n") * F.col("d") * F.col("d")).alias("s"), F.sum("v").alias("v"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
        .first()
    )
    if not row["w"]:
        return r.most_strength
    rho = (row["s"] - row["v"]) / row["w"]
    if rho <= 0:
        return r.most_strength
    return int(min(r.most_strength, max(r.least_strength, round(1 / rho - 1))))


def host_reputation(outcomes: DataFrame, hosts: DataFrame, r: Reputation = Reputation()) -> DataFrame:
    """(host, domain, suffix, n, y, rate, bound, allowed) for every row of `hosts` (host).

    outcomes: (host, outcome) with outcome 1 (good) or 0; other outcomes are ignored.
    """
    seen = outcomes.where(F.col("outcome").isin(0, 1)).select("host", F.col("outcome").cast("long").alias("y"), F.lit(1).cast("long").alias("n"))
    zero = hosts.select("host", F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("n"))
    by_host = with_parents(seen.unionByName(zero).groupBy("host").agg(F.sum("y").alias("y"), F.sum("n").alias("n")), r.long_suffixes)
    by_host = stash(by_host, "hosts")
    up = lambda df, k, *more: df.groupBy(k, *more).agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    domains = stash(up(by_host, "domain").join(by_host.groupBy("domain").agg(F.min("suffix").alias("suffix")), "domain"), "domains")
    suffixes = stash(up(domains, "suffix"), "suffixes")
    total = suffixes.agg(F.sum("y").alias("y"), F.sum("n").alias("n")).first()
    ty, tn = (total["y"], total["n"]) if total["n"] else (0, 0)
    root = ty / tn if tn else r.rate_if_unknown

    def level(rows: DataFrame, parents: DataFrame | None, key: str, name: str) -> DataFrame:
        """Adds the posterior mean `rate` and the posterior's weight `m` to rows."""
        if parents is None:
            both = rows.withColumns({"py": F.lit(ty).cast("long"), "pn": F.lit(tn).cast("long"), "prior": F.lit(root)})
        else:
            both = join_small(rows, parents.select(key, F.col("y").alias("py"), F.col("n").alias("pn"), F.col("rate").alias("prior")), [key])
        both = stash(both, name)
        k = float(_strength(both, r))
        return both.withColumn("rate", (F.col("y") + k * F.col("prior")) / (F.col("n") + k)).withColumn("m", F.col("n") + k)

    s = stash(level(suffixes, None, "", "suffix-level"), "suffix-rates")
    d = stash(level(domains, s, "suffix", "domain-level").drop("py", "pn", "prior"), "domain-rates")
    h = level(by_host, d, "domain", "host-level")
    bound = F.col("rate") + F.lit(r.z) * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("m") + 1))
    return h.withColumn("bound", bound).withColumn("allowed", F.col("bound") >= r.min_good).select("host", "domain", "suffix", "n", "y", "rate", "bound", "allowed")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], r: Reputation = Reputation()) -> DataFrame:
    """(page_id, host, path, rule, verdict, ...) for every row of pages (page_id, url).

    outcomes: (host, outcome) as for `host_reputation`.
    """
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": rule, "_verdict": verdict})
    known = stash(host_reputation(outcomes, p.select("host").distinct(), r), "reputation")
    known = known.select("host", F.col("rate").alias("host_rate"), F.col("bound").alias("host_bound"), "allowed")
    judged = p.join(known, "host", "left")
    verdict = F.coalesce("_verdict", F.when(F.col("allowed"), "allow").otherwise("block"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("host_rate", 9).alias("host_rate"), F.round("host_bound", 9).alias("host_bound"))

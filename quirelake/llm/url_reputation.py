"""URL filters: curated rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (block or allow) are counted per host, without its port, user and last dot. A
host's block rate is shrunk towards its registered domain's, that towards its public suffix's, and
that towards the whole table's, each by a beta-binomial prior whose strength is fitted by moments
(between and within the children of the parent, as in an analysis of variance). An IPv4 address is its
own domain, and all of them share a suffix. A page that no rule decides is blocked where the lower
posterior bound of its host's block rate reaches a threshold. Everything is DataFrame expressions.

Defined results: a null url, or one without ``://``, has an empty host and path; no rule fits it and
the method judges the empty host (with no labelled page, by the table's own rate). Without any
labelled page every undecided page is allowed. Where the children of a parent have a page each, or it
has one child, nothing tells how much they differ and the prior has its least strength. Repeated rows
count and are judged each, as are rows without an id. Extra columns of the input are ignored, whatever
their names. Urls of any length are judged whole. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

#: What registries under a country's code of two letters sell names below.
SECOND_LEVELS = ("ac", "co", "com", "edu", "gob", "go", "gouv", "gov", "id", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
IPV4 = r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, under a path prefix (without leading slash)."""

    verdict: str
    host: str
    path: str = ""

    @property
    def text(self) -> str:
        return f"{self.host}/{self.path}"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


#: Rules that go into a plan, as one constant of some 100 bytes each.
MOST_RULES = 100_000


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits (of equal ones the last by text, of one text a
    block), or null.

    The rules are a constant of the plan: buckets by the hash of the host, so a page looks into one bucket
    for each of the last labels of its host, as many as the rules have at most, whatever their number.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules; load longer lists as labelled outcomes")
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    size = 1 << max(0, len(rules).bit_length() - 1)
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for r in dict.fromkeys(rules):
        buckets[zlib.crc32(r.host.encode()) % size].append({"n": len(r.text), "rule": r.text, "verdict": r.verdict, "host": r.host, "path": f"/{r.path}"})
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<n:int,rule:string,verdict:string,host:string,path:string>>>")
    most = max(r.host.count(".") + 1 for r in rules)
    labels = F.split(host, r"\.")
    n = F.least(F.size(labels), F.lit(most))
    ends = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, -k, k), "."))
    fits = lambda e: F.filter(F.get(table, (F.crc32(e.cast("binary")) % size).cast("int")), lambda r: (r["host"] == e) & F.startswith(path, r["path"]))
    return F.array_max(F.flatten(F.transform(ends, fits)))


def bare_host(host: Column) -> Column:
    """A host as it counts for its reputation: without user, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _two_labels(host: Column) -> Column:
    """Whether the public suffix has two labels: a second level that registries sell names below."""
    return F.regexp_like(host, F.lit(rf"(^|\.)({'|'.join(SECOND_LEVELS)})\.[a-z]{{2}}$"))


def registered_domain(host: Column) -> Column:
    labels = F.size(F.split(host, r"\."))
    return F.when(F.regexp_like(host, F.lit(IPV4)), host).when(_two_labels(host) & (labels > 2), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def public_suffix(host: Column) -> Column:
    return F.when(F.regexp_like(host, F.lit(IPV4)), "ipv4").when(_two_labels(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _moments() -> list[Column]:
    """Aggregates of one level for its parent: bad, n, and the moments of the children's rates."""
    n, bad = F.col("n"), F.col("bad")
    return [F.sum("bad").alias("bad"), F.sum("n").alias("n"), F.count_if(n > 0).alias("kids"), F.sum(F.when(n > 0, bad * bad / n)).alias("sq"), F.sum(n * n).alias("nn")]


def _prior_strength(low: float, high: float) -> Column:
    """The prior's pseudo-count 1/rho - 1, within bounds; rho is the correlation within children.

    With mean squares between and within the children, rho = (b - w) / (b + (m - 1) w), where m is their
    mean size, less what its variance takes off.
    """
    n, bad, sq, kids = F.col("n").cast("double"), F.col("bad").cast("double"), F.col("sq"), F.col("kids").cast("double")
    between = (sq - bad * bad / n) / (kids - 1)
    within = (bad - sq) / (n - kids)
    m = (n - F.col("nn") / n) / (kids - 1)
    fitted = F.when(between - within > 1e-9, (between + (m - 1) * within) / (between - within) - 1).otherwise(F.lit(high))
    return F.when((kids > 1) & (n > kids), F.greatest(F.lit(low), F.least(F.lit(high), fitted))).otherwise(F.lit(low))


def host_reputation(outcomes: DataFrame, low: float = 2.0, high: float = 200.0) -> DataFrame:
    """(host, labelled, blocked, rate, deviation) from outcomes(host, n, bad), a row per bare host or more."""
    hosts = outcomes.groupBy("host").agg(F.sum("n").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad"))
    hosts = staged(hosts.withColumns({"domain": registered_domain(F.col("host")), "suffix": public_suffix(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*_moments()).withColumn("k", _prior_strength(low, high))
    domains = staged(domains, "domains")
    suffixes = domains.groupBy("suffix").agg(*_moments()).withColumn("k", _prior_strength(low, high))
    suffixes = staged(suffixes, "suffixes")
    whole = suffixes.agg(*_moments()).withColumn("k", _prior_strength(low, high)).first()
    base, k0 = ((whole["bad"] + 0.5) / (whole["n"] + 1), whole["k"]) if whole and whole["n"] else (0.0, low)
    shrunk = lambda prior, k: (F.col("bad") + prior * k) / (F.col("n") + k)
    suffixes = suffixes.select("suffix", shrunk(F.lit(base), F.lit(k0)).alias("m1"), F.col("k").alias("k1"))
    domains = domains.join(suffixes, "suffix").select("domain", "suffix", shrunk(F.col("m1"), F.col("k1")).alias("m2"), F.col("k").alias("k2"))
    a, b = F.col("bad") + F.col("m2") * F.col("k2"), F.col("n") - F.col("bad") + (1 - F.col("m2")) * F.col("k2")
    return hosts.join(domains, ["domain", "suffix"]).select("host", F.col("n").cast("long").alias("labelled"), F.col("bad").cast("long").alias("blocked"), (a / (a + b)).alias("rate"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("deviation"))


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", bound: float = 1.64, threshold: float = 0.5) -> DataFrame:
    """Every page's host, path, rule and verdict, with its host's reputation.

    labels(id_col, blocked 0/1), a row per labelled page, are the outcomes; without them the
    rules' own decisions are: a page that a rule blocks or allows is a labelled page of its host.
    """
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    parsed = parsed.withColumns({"_hit": longest_rule(F.col("host"), F.col("path"), rules), "bare": bare_host(F.col("host"))})
    parsed = parsed.withColumns({"rule": F.col("_hit.rule"), "ruled": F.col("_hit.verdict")})
    if labels is None:
        outcome = parsed.select("bare", F.col("ruled").isNotNull().cast("long").alias("n"), F.coalesce((F.col("ruled") == "block").cast("long"), F.lit(0)).alias("bad"))
    else:
        told = labels.groupBy(id_col).agg(F.max("blocked").alias("told"))
        outcome = parsed.join(told, id_col, "left").select("bare", F.col("told").isNotNull().cast("long").alias("n"), F.coalesce(F.col("told").cast("long"), F.lit(0)).alias("bad"))
    counts = outcome.groupBy(F.col("bare").alias("host")).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    known = staged(host_reputation(counts).withColumnRenamed("host", "bare"), "reputation")
    lower = F.col("rate") - bound * F.col("deviation")
    judged = F.when(lower >= threshold, "block").otherwise("allow")
    return parsed.join(known, "bare", "left").select(id_col, "host", "path", "rule", F.coalesce("ruled", judged).alias("verdict"), F.coalesce("labelled", F.lit(0)).alias("labelled"), F.col("rate").alias("block_rate"), lower.alias("block_bound"))

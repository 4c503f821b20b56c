"""URL filtering by the reputation of hosts, with DataFrame functions only.

Labelled pages are outcomes, bad or good. A host's rate of bad pages is shrunk
towards that of its registered domain, the domain's towards its suffix, and the
suffix's towards all pages: at every level the rates of the members are taken
as draws from a beta distribution whose mean is the parent's posterior mean and
whose strength is fitted by moments over the whole level. A page is blocked if
even the lower posterior bound of its host exceeds the limit, so a few bad pages
on a little known host don't condemn it while a bad neighbourhood counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apportion.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Suffixes of two labels under which names are registered; any other suffix is the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
LIMIT = 0.5
DEVIATIONS = 1.64
WEAKEST, STRONGEST = 1.0, 1000.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or without ``://``.

    The host ends at the first ``/``, ``?`` or ``#``, keeps a port, and has A-Z in
    lower case. The path ends at ``?`` or ``#`` and may be empty.
    """
    mark = F.instr(url, "://")
    rest = F.when(mark > 0, F.substring(url, mark + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def domain_of(host: Column) -> Column:
    """Registered domain: the suffix and one label before it."""
    last_two = F.substring_index(host, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(
        last_two
    )


def suffix_of(domain: Column) -> Column:
    last_two = F.substring_index(domain, ".", -2)
    return F.when(last_two.isin(*TWO_LABEL_SUFFIXES), last_two).otherwise(
        F.substring_index(domain, ".", -1)
    )


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The rule that fits, as a struct of ``rule`` and ``verdict``, or null.

    A rule fits its host and all subdomains if the path starts with the rule's.
    The longest wins; of equally long ones, the greater text. The list is part of
    the expression: it is configuration, for large lists join on host suffixes.
    """
    tests = []
    for r in rules:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = r.host + r.path
        value = F.struct(
            F.lit(len(name)).alias("size"), F.lit(name).alias("rule"), F.lit(r.verdict).alias("verdict")
        )
        tests.append(F.when(fits, value))
    if not tests:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array(*tests))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Posterior of each host seen: ``host``, ``mean``, ``bound``.

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0 or 1). A host
    without outcomes has its domain's posterior. Without any outcome there are no
    reputations but the rate one half. Counts are summed before they are joined.
    """
    judged = outcomes.where(F.col("bad").isNotNull() & F.col("page_id").isNotNull())
    counts = judged.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    hosts = (
        pages.join(counts, "page_id", "left")
        .groupBy("host")
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
            F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        )
        .withColumn("domain", domain_of(F.col("host")))
        .withColumn("suffix", suffix_of(F.col("domain")))
    )
    hosts = written(hosts, "hosts")
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    seen, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    root = F.lit(((bad or 0) + 1) / ((seen or 0) + 2))
    above = _shrunk(suffixes.withColumn("prior", root)).select("suffix", F.col("mean").alias("prior"))
    middle = _shrunk(domains.join(above, "suffix")).select("domain", F.col("mean").alias("prior"))
    return _shrunk(hosts.join(middle, "domain")).select("host", "mean", "bound")


def _shrunk(members: DataFrame) -> DataFrame:
    """Posterior mean and lower bound of members, given their parents' means as ``prior``.

    Moments: with ``bad`` of n outcomes and the parent's mean m, the expected sum
    of (bad - n m)^2 is the sum of n m (1 - m) (1 + (n - 1) / (s + 1)), which is
    solved for the strength s of the whole level: one number.
    """
    n, spread = F.col("n"), F.col("prior") * (1 - F.col("prior"))
    excess = F.pow(F.col("bad") - n * F.col("prior"), 2.0) - n * spread
    pairs, excess = members.agg(F.sum(n * (n - 1) * spread), F.sum(excess)).first()
    strength = pairs / excess - 1 if excess and excess > 0 else STRONGEST
    strength = F.lit(min(max(strength, WEAKEST), STRONGEST))
    mean = (F.col("prior") * strength + F.col("bad")) / (strength + n)
    deviation = F.sqrt(mean * (1 - mean) / (strength + n + 1))
    return members.select("*", mean.alias("mean"), (mean - DEVIATIONS * deviation).alias("bound"))


def judge_urls(
    pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], limit: float = LIMIT
) -> DataFrame:
    """Every page with host, path, the rule that fits, and a verdict.

    The rule decides; else a host whose bound is above ``limit`` is blocked.
    Rows with null url have empty host and path and are judged like any other;
    repeated rows give repeated rows. Only page_id and url of ``pages`` are read.
    """
    parts = pages.select("page_id", "url").select("page_id", *_named_parts(F.col("url")))
    known = reputations(parts, outcomes).where(F.col("bound") > limit).select("host", F.lit(1).alias("bad"))
    ruled = parts.withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    return ruled.join(known, "host", "left").select(
        "page_id",
        "host",
        "path",
        F.col("found.rule").alias("rule"),
        F.coalesce(
            F.col("found.verdict"), F.when(F.col("bad") == 1, "block").otherwise("allow")
        ).alias("verdict"),
    )


def _named_parts(url: Column) -> tuple[Column, Column]:
    host, path = url_parts(url)
    return host.alias("host"), path.alias("path")


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from labels of the documents that the pages hold: junk or toxic is bad."""
    bad = (F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))

"""URL filter: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 bad, 0 good) are counted per host. Rates are shrunk
through a chain of beta-binomial priors, all pages to suffix (a list, longest match) to
registered domain to host; the strength of each prior comes from how far the children of a node
differ (method of moments). A host's pages are blocked where the lower posterior
bound of its bad rate is above a limit.

Everything is DataFrame functions. Each level is a hash aggregate of the level
below, so a host with a third of all pages costs one row after the partial
aggregate; the host table meets the pages in one equi-join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabforge.llm.common import ascii_lower, stored

URL_PATTERN = r"(?s)^.*?://([^/?#]*)([^?#]*)"

# Public suffixes of two labels under which names are registered one label further left.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk", "co.za", "com.ar", "com.au",
    "com.br", "com.cn", "com.co", "com.hk", "com.mx", "com.my", "com.ph", "com.pl", "com.sa", "com.sg", "com.tr", "com.tw",
    "com.ua", "com.vn", "edu.au", "edu.cn", "go.jp", "gov.au", "gov.br", "gov.cn", "gov.in", "gov.uk", "ltd.uk", "me.uk",
    "ne.jp", "net.au", "net.br", "net.cn", "net.nz", "net.uk", "nhs.uk", "or.jp", "or.kr", "org.au", "org.br", "org.cn",
    "org.nz", "org.uk", "org.za", "plc.uk", "sch.uk",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Prior:
    """Parameters of the shrinkage. ``z``: posterior standard deviations below the mean."""

    least_strength: float = 1.0
    most_strength: float = 200.0
    z: float = 1.645
    limit: float = 0.8


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, URL_PATTERN, 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, URL_PATTERN, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits the host or a parent of it and the path's start."""
    text = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        text = F.when(fits, r.text) if text is None else text.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    if text is None:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return text, verdict


def _strength(mean: Column, spread: Column, n: Column, children: Column, p: Prior) -> Column:
    """Prior strength that explains the children's spread around ``mean`` (method of moments)."""
    var = mean * (1 - mean)
    excess = spread / n - var * children / n
    raw = F.when(excess > 0, (var - spread / n) / F.nullif(excess, F.lit(0.0)))
    return F.greatest(F.lit(p.least_strength), F.least(F.lit(p.most_strength), F.coalesce(raw, F.lit(p.most_strength))))


def suffix_pattern(suffixes: Sequence[str]) -> str:
    """Pattern of a host's longest suffix of the list, else its last label."""
    listed = "|".join(x.replace(".", r"\.") for x in sorted(suffixes, key=lambda x: (-len(x), x)))
    return f"(?:{listed}|[^.]*)$" if listed else "[^.]*$"


def host_bounds(outcomes: DataFrame, prior: Prior | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """Per host of ``outcomes`` (host, bad 0/1/null): ``bound``, the lower posterior bound of its bad rate.

    A host's suffix is the longest one of ``suffixes`` that it ends in, else its last label; its registered
    domain has one label more. A host that is itself a suffix is its own domain.
    Hosts without labelled pages get the bound of their domain's prior; with no
    labelled page at all the top prior is Beta(1/2, 1/2) and nothing is blocked.
    An empty table gives an empty result.
    """
    p = prior or Prior()
    end = suffix_pattern(suffixes)
    host = (
        outcomes.groupBy("host")
        .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
        .withColumn("suffix", F.regexp_extract("host", rf"(?:^|\.)({end})", 1))
        .withColumn("domain", F.regexp_extract("host", rf"(?:^|\.)((?:[^.]*\.)?{end})", 1))
    )
    host = stored(host, "host-counts")  # every level and both scalars read it
    domain = host.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    rate = (F.sum("x") + 0.5) / (F.sum("n") + 1.0)
    top = suffix.agg(rate.alias("m")).scalar()

    def spread(of: Column) -> Column:
        """n times the squared distance of a node's rate to ``of``; nodes without labels add nothing."""
        return F.when(F.col("n") > 0, F.col("n") * F.pow(F.col("x") / F.nullif(F.col("n"), F.lit(0)) - of, 2))

    def fit(children: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, pm, k): a parent's mean and the strength of the prior it gives its children."""
        sums = children.groupBy(*keys).agg(
            F.max("m").alias("pm"), F.sum("n").alias("pn"), F.sum(F.when(F.col("n") > 0, 1)).alias("pc"),
            F.coalesce(F.sum(spread(F.col("m"))), F.lit(0.0)).alias("ps"),
        )
        strength = _strength(F.col("pm"), F.col("ps"), F.nullif(F.col("pn"), F.lit(0)), F.col("pc"), p)
        return sums.select(*keys, "pm", F.when(F.col("pn") > 0, strength).otherwise(F.lit(p.most_strength)).alias("k"))

    def posterior(nodes: DataFrame) -> DataFrame:
        return nodes.withColumn("m", (F.col("x") + F.col("k") * F.col("pm")) / (F.col("n") + F.col("k"))).drop("pm")

    def shrink(nodes: DataFrame, above: DataFrame, keys: list[str]) -> DataFrame:
        """Posterior mean ``m`` of each node under its parent's; keeps the prior's strength as ``k``."""
        return posterior(nodes.join(fit(nodes.join(above.select(*keys, "m"), keys), keys), keys))

    first = fit(suffix.withColumn("m", top), [])
    suffix = posterior(suffix.withColumns({c: first.select(c).scalar() for c in ("pm", "k")}))
    domain = shrink(domain, suffix, ["suffix"])
    host = shrink(host, domain, ["suffix", "domain"])
    sd = F.sqrt(F.col("m") * (1 - F.col("m")) / (F.col("n") + F.col("k") + 1))
    return host.select("host", F.col("n").alias("n_labelled"), (F.col("m") - p.z * sd).alias("bound"))


def judge_urls(
    pages: DataFrame, url: str, rules: list[Rule], prior: Prior | None = None, suffixes: Sequence[str] = SUFFIXES
) -> DataFrame:
    """Adds host, path, rule, verdict and n_labelled to every row of ``pages``.

    The labelled outcomes are the pages that a rule decides: block is bad, allow is
    good. Pages under a rule keep its verdict; the others take their host's. A null
    url, or one without ``://``, has the empty host, whose pages are judged like any
    other host's. Repeated rows are judged one by one. Of rules of equal length that fit,
    the first by text holds; a bound equal to the limit allows. Urls of any length are
    read whole, and an empty table gives an empty result. Input columns named like an
    output are replaced; other extra columns pass through.
    """
    p = prior or Prior()
    added = ("host", "path", "rule", "verdict", "n_labelled")
    kept = [c for c in pages.columns if c.lower() not in added]
    text, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select(*kept, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    ruled = parsed.select("*", text.alias("rule"), verdict.alias("verdict"))
    outcomes = ruled.select("host", (F.col("verdict") == "block").cast("long").alias("bad"))
    bounds = host_bounds(outcomes, p, suffixes)
    by_host = F.when(F.col("bound") > p.limit, "block").otherwise("allow")
    return ruled.join(bounds, "host", "left").select(
        *kept, "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), "n_labelled"
    )

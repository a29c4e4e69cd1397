"""URL filters: rules by host and path, else empirical-Bayes host reputation.

Labelled pages (bad or not) are counted by host; the counts add up to
registered domains, public suffixes and the whole corpus. From the top down
each level's bad rate is shrunk towards its parent's through a beta-binomial
model: with ``k`` bad of ``n`` pages and a parent rate ``m``, the posterior is
Beta(k + s*m, n - k + s*(1 - m)). The prior strength ``s`` of a level is
estimated from the spread of its own units by the method of moments. A host is
blocked when the lower bound of its bad rate (mean less ``z`` standard
deviations of the posterior) is over ``most_bad``; a host without labelled
pages takes its domain's posterior, and so on upwards.

DataFrame expressions only. What reaches the driver is three numbers a level.

Reputation belongs to the site: the host without user and port. An address of
numbers is a domain of its own.

Defined results: a null URL or one without ``://`` has empty host and path and
is judged by the corpus rate; a null outcome is no label; repeated pages count
each; very long URLs are read whole; other columns of the input are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower

# Common public suffixes of two labels that the generic rule (last label) does not cover; a whole list can be given instead.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "ne.jp", "or.jp", "org.au", "org.uk")


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")


def _is_address(site: Column) -> Column:
    return site.rlike(r"^([0-9]+\.){3}[0-9]+$|^\[")


def read_suffixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Suffixes of several labels from a public suffix list (a file of some 10,000 lines); its wildcards and exceptions are left out."""
    line = F.trim("value")
    rows = spark.read.text(path).select(line.alias("s")).where(line.rlike(r"^[^/!*\s.]+(\.[^/!*\s.]+)+$"))
    return tuple(sorted(r.s for r in rows.distinct().collect()))


def _labels(site: Column, suffixes: Sequence[str], more: int) -> Column:
    """The public suffix (the longest listed, else the last label) and ``more`` labels before it."""
    out = F.substring_index(site, ".", -1 - more)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        listed = F.substring_index(site, ".", -n).isin(*(s for s in suffixes if s.count(".") + 1 == n))
        out = F.when(listed, F.substring_index(site, ".", -n - more)).otherwise(out)
    return out


def suffix_of(site: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    return F.when(_is_address(site), F.lit("")).otherwise(_labels(site, suffixes, 0))


def domain_of(site: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """The public suffix and one label more; the site itself if it is no longer than that, or an address."""
    return F.when(_is_address(site), site).otherwise(_labels(site, suffixes, 1))


def longest_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits; of equally long ones the first in order of text."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _strength(units: DataFrame, least: float = 1.0, most: float = 1e4) -> float:
    """Prior strength from units (k, n) by moments: between-unit variance beyond the binomial's."""
    r = units.agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("units"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r.n or r.units < 2 or r.n * r.n == r.nn:
        return least
    m = r.k / r.n
    spread = units.agg(F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.lit(m), 2))).first()[0]
    between = (spread - (r.units - 1) * m * (1 - m)) / (r.n - r.nn / r.n)
    if m in (0, 1) or between <= 0:
        return most
    return float(min(most, max(least, m * (1 - m) / between - 1)))


def reputations(outcomes: DataFrame, z: float, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Lower bounds of the bad rate by host, domain and suffix, and for the corpus; from rows (host, bad)."""
    hosts = outcomes.groupBy("host").agg(F.sum(F.col("bad").cast("long")).alias("k"), F.count("*").alias("n"))
    levels = {"host": hosts}
    levels["domain"] = hosts.groupBy(domain_of(F.col("host"), suffixes).alias("domain")).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    levels["suffix"] = hosts.groupBy(suffix_of(F.col("host"), suffixes).alias("suffix")).agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("k"), F.sum("n")).first()
    k, n = total[0] or 0, total[1] or 0
    a, b = k + 1.0, n - k + 1.0
    top = a / (a + b)

    def posterior(units: DataFrame, strength: float, prior: Column) -> DataFrame:
        a, b = F.col("k") + strength * prior, F.col("n") - F.col("k") + strength * (1 - prior)
        return units.withColumn("rate", a / (a + b)).withColumn("bound", F.col("rate") - z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))))

    suffix = posterior(levels["suffix"], _strength(levels["suffix"]), F.lit(top))
    domain = posterior(levels["domain"].withColumn("suffix", suffix_of(F.col("domain"), suffixes)).join(suffix.select("suffix", F.col("rate").alias("up")), "suffix"), _strength(levels["domain"]), F.col("up"))
    host = posterior(levels["host"].withColumn("domain", domain_of(F.col("host"), suffixes)).join(domain.select("domain", F.col("rate").alias("up")), "domain"), _strength(levels["host"]), F.col("up"))
    return host.select("host", "rate", "bound"), domain.select("domain", "rate", "bound"), suffix.select("suffix", "rate", "bound"), top - z * (top * (1 - top) / (a + b + 1)) ** 0.5


def judge(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], most_bad: float, z: float = 1.645, id_col: str = "page_id", url_col: str = "url", suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """id, host, path, rule, verdict and the bound that the host's reputation gives, for every page.

    ``outcomes``: rows (url, bad boolean), labelled pages only.
    """
    url = F.col(url_col)
    seen = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path")).withColumn("site", site_of(F.col("host")))
    host, domain, suffix, top = reputations(outcomes.where("bad is not null").select(site_of(host_of(F.col("url"))).alias("host"), "bad"), z, suffixes)
    # a bound for each site on a page, then one join: a hot site meets one row
    known = seen.select(F.col("site").alias("host")).distinct().withColumn("domain", domain_of(F.col("host"), suffixes)).withColumn("suffix", suffix_of(F.col("host"), suffixes))
    known = known.join(host.select("host", F.col("bound").alias("b0")), "host", "left").join(domain.select("domain", F.col("bound").alias("b1")), "domain", "left").join(suffix.select("suffix", F.col("bound").alias("b2")), "suffix", "left")
    bounds = known.select(F.col("host").alias("site"), F.coalesce("b0", "b1", "b2", F.lit(top)).alias("bad_bound"))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    judged = seen.join(bounds, "site", "left").withColumn("rule", rule)
    verdict = F.coalesce(said, F.when(F.col("bad_bound") > most_bad, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bad_bound")

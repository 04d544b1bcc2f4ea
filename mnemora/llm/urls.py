"""Operator 7: URL filters by rules and by empirical-Bayes host reputation.

Labelled page outcomes are counted a host, and the rate of good pages is shrunk down a hierarchy:
the corpus is the prior of a public suffix, the suffix of a registered domain, the domain of a host.
How strongly each level is drawn to the one above comes from the spread between its groups (moments
of the beta-binomial). A host passes if the lower posterior bound of its rate reaches a threshold.

Outcomes are a column of the caller's; ``page_outcome`` makes them from the pages themselves. A host
is known by its name alone: user parts, ports and a final dot of a url do not make another host.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, meet

#: Words in an address that mark bought or adult traffic.
MARKERS = ("adult", "bets", "casino", "escort", "pills", "porn", "spam", "viagra", "warez")
#: Public suffixes of two labels that are in wide use; a caller with the whole public list passes it instead.
SUFFIXES = ("ac.uk", "blogspot.com", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "github.io", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk")
#: Parts of a page that are not its own text.
CHROME = r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<footer.*?</footer>|<!--.*?-->|<[^>]*>"
#: Words of its own that a good page has at least.
LEAST_WORDS = 50


@dataclass(frozen=True)
class Rule:
    """A verdict for a host, its subdomains, and the paths that start with ``path``."""

    verdict: str
    host: str
    path: str


@dataclass(frozen=True)
class Reputation:
    """Parameters of the method: the bound's distance in standard deviations, the rate it must reach, limits of prior strength."""

    z: float = 1.0
    threshold: float = 0.5
    weakest: float = 2.0
    strongest: float = 200.0


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.instr(url, "://") > 0, host).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct(rule, verdict) of the longest fitting rule, else null; rules are a stated list of some hundreds at most."""
    ordered = sorted(rules, key=lambda r: (-len(r.host + r.path), r.host, r.path))
    out = None
    for r in ordered:
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        got = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, got) if out is None else out.when(fits, got)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def page_outcome(url: Column, html: Column, least_words: int = LEAST_WORDS, markers: Sequence[str] = MARKERS) -> Column:
    """1.0 for a page with enough words of its own and no marker in its address, 0.0 for another; null without html or url.

    Words are runs of letters outside of head, navigation, footer, scripts, comments and tags, in the whole page.
    """
    words = F.size(F.regexp_extract_all(F.regexp_replace(html, CHROME, " "), F.lit(r"\p{L}+"), F.lit(0)))
    marked = F.lower(url).rlike("|".join(markers))
    return F.when(html.isNotNull() & url.isNotNull(), F.when((words >= least_words) & ~marked, 1.0).otherwise(0.0))


def name_of(host: Column) -> Column:
    """The host's name: without the user part, the port and a final dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.+$", "")


def suffix_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The last label, or the last two where they are a public suffix; a name of digits and dots is its own."""
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*suffixes), two).otherwise(F.substring_index(name, ".", -1))


def domain_of(name: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The suffix and the label before it."""
    two = F.substring_index(name, ".", -2)
    return F.when(name.rlike("^[0-9.]+$"), name).when(two.isin(*suffixes), F.substring_index(name, ".", -3)).otherwise(two)


def strength(groups: DataFrame, mean: str, p: Reputation) -> float:
    """Prior strength from the groups' (n, good, mean above): a weak spread between groups makes a strong prior.

    The excess of squared deviations over binomial noise estimates the variance v between groups; a
    beta prior with mean m has v = m (1 - m) / (strength + 1). Three sums reach the driver.
    """
    m, n, rate = F.col(mean), F.col("n"), F.col("good") / F.col("n")
    noise, ceiling = m * (1 - m) / n, m * (1 - m)
    row = groups.filter("n > 0").agg(F.sum(n * ((rate - m) * (rate - m) - noise)), F.sum(n * ceiling)).first()
    excess, most = row[0] or 0.0, row[1] or 0.0
    if excess <= 0 or most <= 0:
        return p.strongest
    return float(min(p.strongest, max(p.weakest, most / excess - 1)))


def reputations(outcomes: DataFrame, p: Reputation, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """``outcomes`` (host, n labelled pages, good ones, and more) with rate and bound; hosts without labels get their prior.

    Counts are sums of doubles below 2**53, so they are exact. Each level's table is far smaller than the one below; a domain
    with very many hosts is met by them in as many parts as their number asks for.
    """
    hosts = outcomes.withColumns({"domain": domain_of(F.col("host"), suffixes), "suffix": suffix_of(F.col("host"), suffixes)})
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.count("*").alias("hosts"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    total = suffixes.agg(F.sum("n"), F.sum("good")).first()
    top = ((total[1] or 0.0) + 1.0) / ((total[0] or 0.0) + 2.0)
    suffixes = suffixes.withColumn("above", F.lit(top))

    def shrunk(groups: DataFrame, name: str) -> DataFrame:
        s = strength(groups, "above", p)
        return groups.withColumn(name, (F.col("good") + s * F.col("above")) / (F.col("n") + s))

    suffix_rate = shrunk(suffixes, "rate").select("suffix", F.col("rate").alias("above"))
    domain_rate = shrunk(domains.join(suffix_rate, "suffix"), "rate").select("domain", F.col("rate").alias("above"), F.col("hosts").alias("_hosts"))
    hosts = meet(hosts, materialise(domain_rate, "domains"), ["domain"], "_hosts", F.xxhash64("host")).drop("_hosts")
    s = strength(hosts, "above", p)
    a, b = F.col("good") + s * F.col("above"), F.col("n") - F.col("good") + s * (1 - F.col("above"))
    rate, size = a / (a + b), a + b
    bound = rate - p.z * F.sqrt(rate * (1 - rate) / (size + 1))
    return hosts.select(*outcomes.columns, rate.alias("rate"), bound.alias("bound"))


def judge(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule], outcome: Column, p: Reputation | None = None, suffixes: Sequence[str] = SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, bound) of every page: its rule's verdict, else that of its host's reputation.

    ``outcome`` is a column of ``pages``: how good a page turned out, 0 to 1, null where that is unknown.
    A null url, or one without ``://``, has an empty host and path and is judged by the empty host's
    reputation. Null and repeated ids stay, a row each; other columns are not carried; an empty
    table gives an empty result. Pages are counted a host before anything is shuffled; a hot host's
    pages are dealt over as many parts as its count asks for when they meet its reputation.
    """
    p = p or Reputation()
    url = F.col(url_col).cast("string")
    seen = pages.select(F.col(id_col).alias("_id"), host_of(url).alias("host"), path_of(url).alias("path"), outcome.cast("double").alias("_outcome"))
    seen = seen.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).withColumn("_name", name_of(F.col("host")))
    known = F.col("_outcome").isNotNull().cast("double")
    outcomes = seen.groupBy("_name").agg(F.sum(known).alias("n"), F.sum(F.coalesce("_outcome", F.lit(0.0))).alias("good"), F.count("*").alias("pages"))
    outcomes = materialise(outcomes.withColumnRenamed("_name", "host"), "hosts")
    bounds = reputations(outcomes, p, suffixes).select(F.col("host").alias("_name"), "bound", "pages")
    ruled = seen.drop("_outcome").withColumn("_rule", best_rule(F.col("host"), F.col("path"), rules))
    joined = meet(ruled, materialise(bounds, "bounds"), ["_name"], "pages", F.xxhash64("_id", "path"))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("bound") >= p.threshold, "allow").otherwise("block"))
    return joined.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "bound")

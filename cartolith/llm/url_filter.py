"""URL filter: fixed rules first, then a posterior bound on the reputation of the host.

Labelled page outcomes (good or bad) are counted by host, registered domain and public suffix. Each
level shrinks towards the one above it: a beta prior whose mean is the parent's posterior mean and
whose strength is fitted to all groups of the level by moments of the beta-binomial. A page passes if the lower
quantile of its host's beta posterior reaches the threshold; a host without outcomes is judged by its domain,
suffix, or the whole. Hosts are grouped without user, port and final dot. Counting is partial before every shuffle, and pages
meet a table of one row a host, so a host with a third of all rows can be split.

A null url, or one without ``://``, has an empty host and path and is judged by the overall rate, unless such pages have
outcomes themselves. Urls are read whole, whatever their length. Without any outcome all hosts have the uniform prior.
Repeated rows are judged alike; an empty table gives no rows; ties between rules of one length cannot fit one url.
Columns beside those named are not read, so they may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Second-level names under which domains are registered, as in co.uk.
SECOND_LEVEL = ("co", "com", "org", "net", "ac", "gov", "edu", "or", "ne", "go", "gob", "gouv", "mil", "nom", "ltd", "plc", "sch", "asso", "info", "id", "art", "web", "firm", "adm", "jus")


@dataclass(frozen=True)
class Rule:
    """verdict for a host (and its subdomains) and the beginning of a path."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, A-Z lower-cased; empty without."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host without user, port and final dot."""
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"(?::[0-9]*+)?\.?$|\.(?::[0-9]*+)$", "")


def is_address(host: Column) -> Column:
    """Hosts that are IPv4 addresses, or IPv6 ones in brackets: no part of them names an owner."""
    return host.rlike(r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])$")


def suffix_of(host: Column) -> Column:
    """The public suffix: the last label, or two where the last is a country under a generic second level; an address is its own."""
    two = F.regexp_extract(host, r"(?:^|\.)((?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2})$", 1)
    return F.when(is_address(host), host).when(two != "", two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffix: Column | None = None) -> Column:
    """The registered domain: the suffix, by default suffix_of(), and one label before it; an address is its own."""
    suffix = suffix_of(host) if suffix is None else suffix
    return F.when(F.length(suffix) == F.length(host), host).otherwise(
        F.concat_ws(".", F.substring_index(F.substring(host, F.lit(1), F.length(host) - F.length(suffix) - 1), ".", -1), suffix)
    )


def named(hosts: DataFrame, suffixes: DataFrame | None) -> DataFrame:
    """hosts with their domain and suffix. suffixes: a table of public suffixes (suffix), of which the longest that ends a host is its own;
    hosts that none ends have suffix_of()."""
    host = F.col("host")
    if suffixes is None:
        return hosts.withColumn("suffix", suffix_of(host)).withColumn("domain", domain_of(host))
    ends = F.transform(F.sequence(F.lit(1), F.size(F.split(host, r"\."))), lambda k: F.array_join(F.slice(F.split(host, r"\."), k, 1_000_000), "."))
    listed = suffixes.where("suffix is not null").select(F.lower("suffix").alias("end")).distinct()
    found = hosts.where(~is_address(host)).select("host", F.explode(ends).alias("end")).join(listed, "end").groupBy("host").agg(F.max_by("end", F.length("end")).alias("listed"))
    out = hosts.join(found, "host", "left").withColumn("suffix", F.coalesce("listed", suffix_of(host))).drop("listed")
    return out.withColumn("domain", domain_of(host, F.col("suffix")))


def ruled(host: Column, path: Column, rules: tuple[Rule, ...], field: str) -> Column:
    """Text or verdict of the longest rule that fits, or null. Rules are a short list, part of the program."""
    fits = lambda r: ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
    order = sorted(rules, key=lambda r: -len(r.text))
    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r), F.lit(getattr(r, field))) for r in order])


def _level(joined: DataFrame, key: str, floor: float = 2.0) -> DataFrame:
    """Posterior (a, b) of each group, shrunk to its parent's mean; joined: key, good, n, p_mean.

    The strength is the moment fit of the beta-binomial over all groups: with p the parent's mean, the
    summed squared residuals (good - n p)^2 are n p (1-p) (1 + (n-1) rho) in expectation. It is one
    number, fetched by the driver."""
    p, n = F.col("p_mean"), F.col("n")
    over, most = joined.agg(F.sum(F.pow(F.col("good") - n * p, 2) - n * p * (1 - p)), F.sum(n * (n - 1) * p * (1 - p))).first()
    rho = min(0.99, max(0.001, over / most)) if most else 0.1
    strength = max(floor, 1 / rho - 1)
    return joined.select(key, (p * strength + F.col("good")).alias("a"), ((1 - p) * strength + n - F.col("good")).alias("b"))


def _log_gamma(z: Column) -> Column:
    """Stirling's series, eight steps above z."""
    w = z + 8
    series = (w - 0.5) * F.log(w) - w + 0.5 * math.log(2 * math.pi) + 1 / (w * 12) - 1 / (F.pow(w, 3) * 360) + 1 / (F.pow(w, 5) * 1260)
    return series - sum((F.log(z + k) for k in range(1, 8)), F.log(z))


def _fraction(x: Column, a: Column, b: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; in the order of sqrt(a + b) steps."""

    def turn(s: Column, part: Column) -> Column:
        d, c = 1 / (part * s["d"] + 1), part / s["c"] + 1
        return F.struct(d.alias("d"), c.alias("c"), (s["h"] * d * c).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + m * 2 - 1) * (a + m * 2))
        odd = -(a + m) * (a + b + m) * x / ((a + m * 2) * (a + m * 2 + 1))
        return let(let(s, lambda v: turn(v, even)), lambda v: turn(v, odd))

    d = 1 / (1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(1), (F.sqrt(a + b) * 3).cast("int") + 30)
    return F.aggregate(steps, F.struct(d.alias("d"), F.lit(1.0).alias("c"), d.alias("h")), step, lambda s: s["h"])


def beta_cdf(x: Column, a: Column, b: Column) -> Column:
    """Chance that a beta variable of (a, b) is at most x, for x strictly between 0 and 1."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    return F.when(x < (a + 1) / (a + b + 2), front * _fraction(x, a, b) / a).otherwise(1 - front * _fraction(1 - x, b, a) / b)


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """The quantile of Beta(a, b) that lies z standard deviations low on the normal scale, by halving; to 2 ** -40."""
    level = 0.5 * math.erfc(z / math.sqrt(2))

    def of(p: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            middle = (s["lo"] + s["hi"]) / 2
            return let(F.struct(middle.alias("m"), (beta_cdf(middle, p["a"], p["b"]) < level).alias("up")), lambda t: F.struct(F.when(t["up"], t["m"]).otherwise(s["lo"]).alias("lo"), F.when(t["up"], s["hi"]).otherwise(t["m"]).alias("hi")))

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(40)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2)

    return let(F.struct(a.alias("a"), b.alias("b")), of)


def reputations(outcomes: DataFrame, z: float, suffixes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, float]:
    """Bounds by host, domain and suffix, and overall; outcomes: host, good (0 or 1), one row a labelled page."""
    hosts = outcomes.where("host is not null and good is not null").groupBy("host").agg(F.sum(F.col("good").cast("double")).alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    hosts = materialise(named(hosts, suffixes), "op4-hosts")
    up = lambda d, *keys: d.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    good, n = hosts.agg(F.coalesce(F.sum("good"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    mean = lambda d, key: d.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("p_mean"))
    s = _level(up(hosts, "suffix").withColumn("p_mean", F.lit((good + 1) / (n + 2))), "suffix")
    d = _level(up(hosts, "domain", "suffix").join(mean(s, "suffix"), "suffix"), "domain")
    h = _level(hosts.join(mean(d, "domain"), "domain"), "host")
    bound = lower_bound(F.col("a"), F.col("b"), z)
    overall = hosts.sparkSession.range(1).select(lower_bound(F.lit(good + 1.0), F.lit(n - good + 1.0), z)).first()[0]
    return h.select("host", bound.alias("by_host")), d.select("domain", bound.alias("by_domain")), s.select("suffix", bound.alias("by_suffix")), overall


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5, z: float = 1.645, suffixes: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, bound.

    outcomes: page_id, good (0 or 1); several outcomes of a page all count. The verdict is the longest
    rule's, else allow where the bound is at least threshold. suffixes: see named()."""
    d = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("site", site_of(F.col("host")))
    labelled = d.select("page_id", F.col("site").alias("host")).join(outcomes.select("page_id", "good"), "page_id")
    by_host, by_domain, by_suffix, overall = reputations(labelled, z, suffixes)
    # each distinct host is judged once; pages meet the verdict of their host
    hosts = named(d.select(F.col("site").alias("host")).distinct(), suffixes)
    judged = hosts.join(by_host, "host", "left").join(by_domain, "domain", "left").join(by_suffix, "suffix", "left")
    judged = materialise(judged.select(F.col("host").alias("site"), F.coalesce("by_host", "by_domain", "by_suffix", F.lit(overall)).alias("bound")), "op4-judged")
    rule = lambda field: ruled(F.col("host"), F.col("path"), rules, field)
    return d.join(judged, "site").select(
        "page_id", "host", "path", rule("text").alias("rule"),
        F.coalesce(rule("verdict"), F.when(F.col("bound") >= threshold, "allow").otherwise("block")).alias("verdict"), "bound",
    )

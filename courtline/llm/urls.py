"""URL filters: list rules first, and for the rest a host's reputation by empirical Bayes.

Labelled page outcomes (bad or not) are counted per host, registered domain and suffix. Each level is shrunk towards the
one above by a beta-binomial prior whose strength is estimated by moments from how much rates differ between siblings:
suffixes towards all pages, domains towards their suffix, hosts towards their domain. A page is blocked where the lower
bound of its host's posterior bad rate is at least the cut. Everything is DataFrame expressions; the driver sees one
row of sums per level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# (verdict, host, path)
RULES = (
    ("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"),
)
# Suffixes of two labels under which names are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "net.au", "co.jp", "ne.jp", "com.br", "co.in", "co.nz")
# Standard deviations below the posterior mean, and the bad rate from which a host is blocked.
BOUND = 1.645
CUT = 0.5
# Limits of the share of variance that lies between siblings; the prior's strength is 1 / share - 1.
LEAST_SHARE, MOST_SHARE = 0.001, 0.999

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null or without."""
    found = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host_: Column, path_: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict); null where none does."""
    fits = [
        F.when(
            ((host_ == h) | host_.endswith(f".{h}")) & path_.startswith(p),
            F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def suffix(host_: Column) -> Column:
    labels = F.split(host_, r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    wide = (F.size(labels) >= 2) & two.isin(*TWO_LABEL_SUFFIXES)
    return F.when(wide, two).otherwise(F.element_at(labels, -1))


def domain(host_: Column) -> Column:
    """The registered domain: the suffix and one label more, or the host if it has no more."""
    labels = F.split(host_, r"\.")
    size = F.size(F.split(suffix(host_), r"\.")) + 1
    return F.when(F.size(labels) <= size, host_).otherwise(F.concat_ws(".", F.slice(labels, -size, size)))


def _strength(children: DataFrame) -> float:
    """Prior strength of one level, from rows (n, bad, mean): by moments, pooled over all parents."""
    n, mean = F.col("n").cast("double"), F.col("mean")
    spread = mean * (1 - mean)
    row = children.where((F.col("n") > 0) & (spread > 0)).agg(
        F.sum(n * F.pow(F.col("bad") / n - mean, F.lit(2)) / spread).alias("seen"),
        F.count(F.lit(1)).alias("rows"), F.sum(n).alias("n"), F.sum(n * n).alias("squares"),
    ).first()
    rows, total = row["rows"], row["n"] or 0.0
    if rows < 2:
        return 1 / LEAST_SHARE - 1
    free = total - row["squares"] / total - (rows - 1)
    share = (row["seen"] - (rows - 1)) / free if free > 0 else LEAST_SHARE
    return 1 / min(max(share, LEAST_SHARE), MOST_SHARE) - 1


def _shrunk(strength: float) -> Column:
    return (F.col("mean") * strength + F.col("bad")) / (F.lit(strength) + F.col("n"))


def reputations(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(host, n, bad, rate, bound) for every host of ``pages`` (page_id, url).

    ``outcomes`` has page_id and bad (0 or 1); outcomes of other pages and null ones are ignored, and a page is bad if
    one of its outcomes is. Hosts without outcomes have their domain's rate.
    """
    known = outcomes.where(F.col("page_id").isNotNull() & F.col("bad").isin(0, 1)).groupBy("page_id").agg(
        F.max("bad").alias("bad")
    )
    rows = pages.select("page_id", host(F.col("url")).alias("host")).join(known, "page_id", "left")
    hosts = rows.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = hosts.withColumns({"domain": domain(F.col("host")), "suffix": suffix(F.col("host"))})
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    row = suffixes.agg(*sums).first()
    mean = row["bad"] / row["n"] if row["n"] else 0.0

    suffixes = suffixes.withColumn("mean", F.lit(mean))
    rates = suffixes.select("suffix", _shrunk(_strength(suffixes)).alias("mean"))
    domains = domains.join(rates, "suffix")
    rates = domains.select("domain", _shrunk(_strength(domains)).alias("mean"))
    hosts = hosts.join(rates, "domain")
    strength = _strength(hosts)
    rate = _shrunk(strength)
    deviation = F.sqrt(rate * (1 - rate) / (F.lit(strength) + F.col("n") + 1))
    return hosts.select("host", "n", "bad", rate.alias("rate"), (rate - BOUND * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, cut: float = CUT) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row per row of ``pages`` (page_id, url; others are ignored).

    Urls that are null or have no ``://`` have an empty host and path and no rule; they are judged as one host. Without
    outcomes nothing is blocked but by rules. An empty table gives no rows.
    """
    told = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    told = told.withColumn("found", matching_rule(F.col("host"), F.col("path"), rules))
    standing = reputations(pages, outcomes).select("host", (F.col("bound") >= cut).alias("shady"))
    verdict = F.coalesce("found.verdict", F.when(F.col("shady"), "block"), F.lit("allow"))
    return told.join(standing, "host", "left").select(
        "page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict")
    )


def label_outcomes(labels: DataFrame) -> DataFrame:
    """The labels table as page outcomes: a page is bad if the label with its id is of low quality or toxic."""
    bad = (F.coalesce("quality", F.lit(1)) == 0) | (F.coalesce("toxic", F.lit(0)) == 1)
    return labels.select(F.col("doc_id").alias("page_id"), bad.cast("int").alias("bad"))

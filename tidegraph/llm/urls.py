"""URL filtering by empirical-Bayes host reputation, with allow and block rules.

Labelled page outcomes are counted by host.  A beta-binomial prior is shrunk down the levels
all, suffix, registered domain and host: each level's posterior mean is the prior mean of the
level below, with a prior strength fitted by the method of moments over all groups of that
level.  The fit takes the overdispersion at one standard error above its estimate, as a few groups rarely
show that there is none; the strength so stays finite and a host's own outcomes always count.  A page is
blocked if the upper bound of its host's posterior good rate is below a share of the overall rate.
Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: A host is blocked below this share of the overall good rate; the bound is the one-sided 95 % one.
LEAST_SHARE, Z = 1.0, 1.645
#: The least prior strength, and that of a level without a group of two outcomes; the mean of all outcomes starts from one good and one bad page.
LEAST_STRENGTH, NO_STRENGTH = 2.0, 100.0
#: Suffixes of two labels under which names are registered; all others have one label.
SUFFIXES = (
    "ac.at co.at or.at com.au edu.au gov.au net.au org.au com.ar com.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn com.co com.hk co.id co.il co.in net.in org.in "
    "ac.jp co.jp go.jp ne.jp or.jp co.ke co.kr or.kr com.mx com.my co.nz net.nz org.nz com.pe com.ph com.pl com.sg co.th com.tr com.tw com.ua ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk com.ve com.vn co.za"
).split()
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The public suffix: the last two labels where they are among ``suffixes``, else the last."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """The registered domain: the suffix and the label before it."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(list(suffixes)), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null; of equal length the first by name."""
    fits = []
    for domain, prefix, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1])):
        own = (host == domain) | host.endswith("." + domain)
        fits.append(F.when(own & path.startswith(prefix), F.struct(F.lit(domain + prefix).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength() -> Column:
    """Over groups (n, good, prior mean m): how many outcomes the prior is worth, by the method of moments and one standard error."""
    ok = F.col("n") > 1
    n, rate, m = F.col("n"), F.col("good") / F.col("n"), F.col("m")
    between = F.sum(F.when(ok, n * (rate - m) * (rate - m)))
    within = F.sum(F.when(ok, m * (1 - m)))
    spread = F.sum(F.when(ok, (n - 1) * m * (1 - m)))
    rho = (between - within) / spread
    error = F.sqrt(2.0 * F.sum(F.when(ok, m * (1 - m) * m * (1 - m)))) / spread  # of rho where groups do not differ
    bound = F.greatest(rho, F.lit(0.0)) + error
    return F.coalesce(F.greatest(1 / bound - 1, F.lit(LEAST_STRENGTH)), F.lit(NO_STRENGTH))


def reputations(outcomes: DataFrame) -> DataFrame:
    """(host, n, good, rate, upper, overall) from labelled outcomes (host, good 0/1, pages); rows without a label are left out.

    Suffixes, domains and hosts are shrunk in this order; a level's fit is an aggregate of its groups.  A host's counts are
    stored once, and each level's posterior.
    """
    hosts = outcomes.where(F.col("good").isNotNull()).groupBy("host").agg(F.sum("pages").alias("n"), F.sum(F.col("good") * F.col("pages")).cast("double").alias("good"))
    hosts = stored(hosts.withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host"))), "url-hosts")
    everything = stored(hosts.agg(((F.coalesce(F.sum("good"), F.lit(0.0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m")), "url-overall")  # one row
    above = everything
    for level, parent in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        groups = hosts.groupBy(level, *([parent] if parent else [])).agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
        groups = stored(groups.join(above, parent) if parent else groups.join(F.broadcast(above)), "url-groups")
        groups = groups.join(F.broadcast(groups.agg(_strength().alias("k"))))  # one row
        a, b = F.col("m") * F.col("k") + F.col("good"), (1 - F.col("m")) * F.col("k") + F.col("n") - F.col("good")
        post = groups.select(level, "n", "good", (a / (a + b)).alias("rate"), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))).alias("sd"))
        above = post.select(level, F.col("rate").alias("m"))
    upper = post.select("host", "n", "good", "rate", (F.col("rate") + Z * F.col("sd")).alias("upper"))
    return upper.join(F.broadcast(everything.select(F.col("m").alias("overall"))))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, good, pages): a page stands for the document whose number its path ends with; it is good if that has quality 1 and is not toxic."""
    number = F.regexp_extract(path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1)
    named = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number.cast("long")).alias("doc_id")).where(F.col("doc_id").isNotNull() & (F.col("host") != ""))
    known = labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
    bad = (F.coalesce(F.col("quality"), F.lit(1)) != 1) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    judged = known.groupBy("doc_id").agg(F.min(F.when(bad, 0).otherwise(1)).alias("good"))
    counted = named.groupBy("doc_id", "host").agg(F.count("*").alias("pages"))  # pages of one document on one host, before the join
    return counted.join(judged, "doc_id").select("host", "good", "pages")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, least_share: float = LEAST_SHARE) -> DataFrame:
    """(page_id, host, path, rule, verdict, rate, upper) for each page.

    A rule's verdict wins; else a host is blocked if its upper posterior bound is below ``least_share`` of the overall rate.
    A null url, or one without ``://``, has an empty host and path and is allowed, as hosts without
    labelled pages are.  Repeated rows get equal verdicts; other columns of ``pages`` are ignored.
    """
    hosts = reputations(outcomes)
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    own = own.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    judged = own.join(hosts.select("host", "rate", "upper", "overall"), "host", "left")
    blocked = (F.col("host") != "") & F.coalesce(F.col("upper") < least_share * F.col("overall"), F.lit(False))
    return judged.select("page_id", "host", "path", "fit.rule", F.coalesce(F.col("fit.verdict"), F.when(blocked, "block").otherwise("allow")).alias("verdict"), "rate", "upper")

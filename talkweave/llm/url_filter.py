"""URL filters: hand-written rules first, an empirical-Bayes reputation of hosts for all other pages.

DataFrame operations only. A rule is a host and a path prefix; it fits its host and all subdomains, and the longest
rule that fits counts. Pages with a known outcome (by default those that a rule judges: 1 for allow, 0 for block)
are counted for each host, registered domain and public suffix. The share of good pages is shrunk through beta
priors: a suffix towards the share of all labelled pages, a domain towards its suffix, a host towards its domain.
How strongly each level is shrunk is learnt from the table by the beta-binomial's moments: with parent means m, the
expected squared residual of a group is n m (1 - m) (1 + (n - 1) rho), and the prior counts as 1 / rho - 1 pages.
A host whose Beta posterior has its upper bound (mean and `z` standard deviations) below `limit` is blocked if its
registered domain has any labelled page: no page is blocked for what is known of other domains alone.

Hot hosts: outcomes are counted before the shuffle, and every join back deals both sides anew, so that adaptive
execution can split a hot host, domain or suffix. The driver gets three sums a level.

Defined results: a null url, or one without "://", has an empty host and path, which are a host like any other; a
null id is carried through; rows that repeat count each; user names, ports and final dots belong to the host as given,
but not to its registered domain; a number-like or dotless host is its own domain and suffix; without labelled pages
every host's share is one half and nothing is blocked; extra columns are ignored, whatever their names; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkweave.llm.common import durable, spread_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Common public suffixes of two labels; all others have one.
TWO_LABELS = ("ac.uk", "co.uk", "gov.uk", "org.uk", "ac.jp", "co.jp", "ne.jp", "or.jp", "com.au", "net.au", "org.au", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "co.kr", "co.nz", "co.za")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: then up to "?", "#" or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching(host: Column, path: Column, rules: list[tuple[str, str]], value: int) -> Column:
    """Of the longest rule that fits, its name (value 0) or its verdict (value 1); null if none fits."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the last one is asked first
        own, slash, prefix = rule[0].partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + prefix)
        found = F.when(fits, F.lit(rule[value])).otherwise(found)
    return found


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, public suffix) of a host."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "[.]?(:[0-9]*)?$", "")
    plain = bare.rlike(r"^[^.]*$|^[0-9.]+$|^\[")
    suffix = F.when(F.substring_index(bare, ".", -2).isin(*TWO_LABELS), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))
    labels = F.when(F.substring_index(bare, ".", -2).isin(*TWO_LABELS), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))
    return F.when(plain, bare).otherwise(labels), F.when(plain, bare).otherwise(suffix)


def strength(groups: DataFrame, mean: Column) -> float:
    """Pages that a prior counts as, by the moments of groups (n, k) around the means of their parents."""
    spread = mean * (1 - mean)
    r = groups.filter("n > 1").agg(
        F.sum((F.col("k") - F.col("n") * mean) ** 2 - F.col("n") * spread).alias("over"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("all"),
    ).first()
    rho = min(max(r["over"] / r["all"], 0.001), 0.999) if r["all"] else 0.5
    return 1 / rho - 1


def reputations(hosts: DataFrame, z: float = 1.28) -> DataFrame:
    """host, n, k, labelled (n of its domain), reputation (posterior mean of the share of good pages), low, high (its bounds).

    hosts: host, n (pages with an outcome) and k (good ones), one row a host."""
    domain, suffix = levels(F.col("host"))
    hosts = durable(hosts.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix")))
    domains = durable(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    suffixes = durable(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    total = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    mean = F.lit((total["k"] + 1) / (total["n"] + 2))
    s = strength(suffixes, mean)
    suffixes = suffixes.select("suffix", ((F.col("k") + s * mean) / (F.col("n") + s)).alias("prior"))
    domains = durable(spread_join(domains, suffixes, "suffix", "inner"))
    s = strength(domains, F.col("prior"))
    domains = domains.select("domain", F.col("n").alias("labelled"), ((F.col("k") + s * F.col("prior")) / (F.col("n") + s)).alias("prior"))
    hosts = durable(spread_join(hosts, domains, "domain", "inner"))
    s = strength(hosts, F.col("prior"))
    all_ = F.col("n") + s
    d = hosts.select("host", "n", "k", "labelled", ((F.col("k") + s * F.col("prior")) / all_).alias("reputation"), all_.alias("size"))
    sd = F.sqrt(F.col("reputation") * (1 - F.col("reputation")) / (F.col("size") + 1))
    return d.select("host", "n", "k", "labelled", "reputation", (F.col("reputation") - z * sd).alias("low"), (F.col("reputation") + z * sd).alias("high"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], outcome: Column | None = None, id_col: str = "page_id", url_col: str = "url", z: float = 1.28, limit: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, reputation, high: one row for each row of pages.

    rules: (host and path prefix, "allow" or "block"), a short hand-written list. outcome: a column of pages that is
    true for good pages, false for bad ones and null where nothing is known; by default what the rules say."""
    host, path = host_and_path(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    d = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), (F.lit(None) if outcome is None else outcome).cast("boolean").alias("good"))
    d = d.withColumn("rule", matching(F.col("host"), F.col("path"), rules, 0)).withColumn("told", matching(F.col("host"), F.col("path"), rules, 1))
    good = F.col("told") == "allow" if outcome is None else F.col("good")
    hosts = d.groupBy("host").agg(F.count(good).alias("n"), F.coalesce(F.sum(good.cast("long")), F.lit(0)).alias("k"))
    known = reputations(hosts, z).select("host", "labelled", "reputation", "high")
    judged = spread_join(d, known, "host", "inner")
    own = F.when((F.col("high") < limit) & (F.col("labelled") > 0), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "reputation", "high")

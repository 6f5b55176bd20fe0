"""URL filters by rules and by empirical-Bayes host reputation.

Outcomes (good or bad) of labelled pages are summed by host (without user and port), registered domain and suffix. A
suffix is the last label, or the last two if they are in a list (a parameter); a registered domain has one label more. At each level a beta-binomial prior is fitted to the spread of the level's groups: its strength
comes from the method of moments. Shares are then shrunk from all pages to the suffix, the domain and the host, and a
host is blocked if the lower bound of its posterior share of bad pages lies over a limit.

A rule, if one fits, goes before the reputation: it holds for its host and all subdomains and for paths that begin
with its path; the longest wins (ties: the lesser text).

Null urls and such without :// have an empty host and path, no rule, and the reputation of the empty host. Null
outcomes and outcomes of unknown pages count nothing. Without any outcome every host has the share of the flat prior,
1/2, which is no evidence: its bound lies under the limit. Every row gives one row, repeated rows too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Z = 1.645
LIMIT = 0.25
#: Copies of a host's row that pages of one host are dealt to.
SALT = 16
#: Suffixes of two labels under which names are registered; a longer list can be given.
SUFFIXES = (
    "ac.jp", "ac.uk", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw",
    "edu.au", "gov.au", "gov.uk", "me.uk", "ne.jp", "net.au", "net.uk", "or.jp", "org.au", "org.br", "org.nz", "org.uk", "org.za",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare(host: Column) -> Column:
    """The host without user and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits: a struct of rule and verdict, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def strength(groups: DataFrame) -> float:
    """The weight of the prior, in pages, that the spread of groups (n, bad) speaks for."""
    t = groups.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"), F.count("*").alias("m")).first()
    if not t.n or not 0 < t.bad < t.n:
        return 2.0
    p = t.bad / t.n
    spread = t.s - t.bad * p  # sum of n (share - p)^2
    rest = t.n - t.n2 / t.n - (t.m - 1)
    rho = (spread / (p * (1 - p)) - (t.m - 1)) / rest if rest > 0 else 0.0
    rho = min(0.5, max(0.001, rho))
    return 1 / rho - 1


def reputation(outcomes: DataFrame, hosts: DataFrame, z: float = Z, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row a host of `hosts` (host): pages, bad, share and bound. outcomes: host, bad (0 or 1)."""
    two = F.substring_index("host", ".", -2)
    listed = two.isin(*suffixes)
    domain = F.when(listed, F.substring_index("host", ".", -3)).otherwise(two)
    suffix = F.when(listed, two).otherwise(F.substring_index("host", ".", -1))
    by_host = outcomes.where("bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("bigint")).alias("bad"))
    by_host = hosts.select("host").distinct().join(by_host, "host", "left").select("host", domain.alias("domain"), suffix.alias("suffix"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bad", F.lit(0)).alias("bad"))
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    some = F.col("n") > 0
    m_host, m_domain, m_suffix = (strength(t.where(some)) for t in (by_host, by_domain, by_suffix))
    whole = by_suffix.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)).alias("p")).first().p
    of_suffix = by_suffix.select("suffix", ((F.col("bad") + m_suffix * whole) / (F.col("n") + m_suffix)).alias("suffix_share"))
    of_domain = by_domain.join(of_suffix, "suffix").select("domain", ((F.col("bad") + m_domain * F.col("suffix_share")) / (F.col("n") + m_domain)).alias("domain_share"))
    share = (F.col("bad") + m_host * F.col("domain_share")) / (F.col("n") + m_host)
    spread = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("n") + m_host + 1))
    return by_host.join(of_domain, "domain").withColumn("share", share).select("host", F.col("n").alias("pages"), "bad", "share", (F.col("share") - z * spread).alias("bound"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]], key: str = "page_id", url: str = "url", limit: float = LIMIT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """One row a page: key, host, path, rule, verdict, share and bound of its host. outcomes: host, bad."""
    text = pages[url].cast("string")
    df = pages.select(pages[key].alias("key"), host_of(text).alias("host"), path_of(text).alias("path")).withColumn("bare", bare(F.col("host")))
    known = reputation(outcomes.select(bare(F.col("host")).alias("host"), "bad"), df.select(F.col("bare").alias("host")), suffixes=suffixes).withColumnRenamed("host", "bare")
    copies = known.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    df = df.withColumn("salt", F.pmod(F.xxhash64("key", "path"), F.lit(SALT)).cast("int")).join(copies, ["bare", "salt"])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("bound") > limit, "block").otherwise("allow"))
    return df.withColumn("found", rule).select(F.col("key").alias(key), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "share", "bound")


def outcomes_by_number(pages: DataFrame, labels: DataFrame, url: str = "url") -> DataFrame:
    """Outcomes (host, bad) of pages whose path is /<part>/<number...>, the number being a labelled document."""
    text = pages[url].cast("string")
    numbered = pages.select(host_of(text).alias("host"), F.regexp_extract(path_of(text), r"^/[^/]*/([0-9]{1,18})", 1).alias("number")).where("number <> ''")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("number")).agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    return numbered.withColumn("number", F.col("number").cast("bigint")).join(known, "number").select("host", "bad")

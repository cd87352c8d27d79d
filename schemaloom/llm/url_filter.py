"""URL filter: explicit host and path rules first, host reputation for the rest.

Reputation is empirical Bayes. Pages with a label are trials of their host, bad or not. Each level's rate (suffix,
registered domain, host) is shrunk by a beta prior whose mean is the estimate of the level above; the prior's weight comes
from the spread of the level's rates by the method of moments. A host is blocked when even the lower bound of its
posterior lies above the tolerated rate of bad pages, and only if pages of its own registered domain were labelled: what is
known of a suffix alone blocks nobody.

Reputation goes by the host without user info, port and final dot. An IP address is its own domain and suffix. Suffixes of
two labels come from a list, a parameter; any other host has its last label as suffix, so strangers under a suffix that is not
on the list share a domain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from schemaloom.llm.shared import ascii_lower, lookup, staged

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: A host is blocked if its rate of bad pages lies above this, by so many standard deviations of the posterior.
TOLERATED, BOUND = 0.3, 1.645
#: The prior's weight in pages when a level has too few nodes to measure it, and its limits.
WEIGHT, LEAST, MOST = 20.0, 2.0, 1000.0
#: Suffixes of two labels under which anybody can have a name: a selection of public ones.
SUFFIXES = ("co.uk", "org.uk", "me.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "edu.au", "gov.au", "co.nz", "org.nz", "co.jp", "ne.jp",
            "or.jp", "ac.jp", "go.jp", "com.br", "net.br", "org.br", "com.cn", "net.cn", "org.cn", "com.mx", "com.ar", "com.co", "com.tr", "com.pl",
            "com.ua", "com.tw", "com.sg", "com.hk", "com.my", "com.ph", "com.vn", "co.in", "net.in", "org.in", "co.id", "co.il", "co.kr", "or.kr",
            "co.th", "co.za", "org.za", "co.ke", "com.ng", "com.eg", "com.sa", "com.pk", "com.bd", "github.io", "gitlab.io", "blogspot.com",
            "wordpress.com", "tumblr.com", "weebly.com", "wixsite.com", "appspot.com", "web.app", "herokuapp.com", "netlify.app", "vercel.app",
            "pages.dev", "workers.dev", "azurewebsites.net", "cloudfront.net")
_ADDRESS = r"^(\[.*\]|\d{1,3}(\.\d{1,3}){3})$"


def site_of(host: Column) -> Column:
    """The host without user info, port and final dot."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":\d*$", ""), r"\.$", "")


def suffix_and_domain(site: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(suffix, registered domain). A site that is an address, a suffix or a single label is its own domain."""
    address, two = F.regexp_like(site, F.lit(_ADDRESS)), F.substring_index(site, ".", -2)
    listed = two.isin(*suffixes) if suffixes else F.lit(False)
    suffix = F.when(address, site).when(listed, two).otherwise(F.substring_index(site, ".", -1))
    return suffix, F.when(address, site).when(listed, F.substring_index(site, ".", -3)).otherwise(two)


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits; null where none does. Rules are tried longest first."""
    name = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name, verdict = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def _shrunk(nodes: DataFrame, parents: DataFrame | None, parent: str | None) -> DataFrame:
    """Nodes with `trials` and `bad`, their posterior `alpha` and `beta` under the beta prior of their parents, and `above`, the parents' trials."""
    if parents is None:
        s = nodes.agg(F.sum("bad").alias("bad"), F.sum("trials").alias("trials")).first()
        nodes = nodes.withColumn("mean", F.lit(s["bad"] / s["trials"] if s["trials"] else 0.0)).withColumn("above", F.lit(s["trials"]))
    else:
        above = parents.select(parent, (F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("mean"), F.col("trials").alias("above"), "children")
        nodes = lookup(nodes, above, [parent], "children", nodes.count())
    m, n = F.col("mean"), F.col("trials")
    rate = F.col("bad") / n
    s = nodes.where("trials > 0").agg(
        F.sum(n * (rate - m) * (rate - m)).alias("between"), F.sum(m * (1 - m)).alias("within"),
        F.sum(n * m * (1 - m)).alias("total"), F.count("*").alias("nodes")).first()
    return (nodes.withColumn("alpha", F.lit(_weight(s)) * m + F.col("bad"))
            .withColumn("beta", F.lit(_weight(s)) * (1 - m) + n - F.col("bad")).drop("mean"))


def _weight(s) -> float:
    """The prior's weight by moments: E[between] = within + rho * (total - within), weight = (1 - rho) / rho."""
    if s["nodes"] < 3 or s["total"] - s["within"] <= 0:
        return WEIGHT
    rho = (s["between"] - s["within"]) / (s["total"] - s["within"])
    return MOST if rho <= 0 else min(MOST, max(LEAST, (1 - rho) / rho))


def host_reputation(sites: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """`sites` (site, pages, trials, bad) with posterior `alpha` and `beta`, and `above`, the trials of its domain; written once per
    level to the shared folder."""
    suffix, domain = suffix_and_domain(F.col("site"), suffixes)
    sites = staged(sites.withColumn("suffix", suffix).withColumn("domain", domain))
    totals = [F.sum("trials").alias("trials"), F.sum("bad").alias("bad"), F.count("*").alias("children")]
    domains = staged(sites.groupBy("domain", "suffix").agg(*totals))
    tops = staged(_shrunk(domains.groupBy("suffix").agg(*totals), None, None))
    domains = staged(_shrunk(domains.withColumnRenamed("children", "sites"), tops, "suffix").drop("above")
                     .withColumnRenamed("sites", "children"))
    return staged(_shrunk(sites, domains, "domain").select("site", "pages", "trials", "bad", "alpha", "beta", "above"))


def url_filter(pages: DataFrame, labels: DataFrame, rules=RULES, tolerated: float = TOLERATED, bound: float = BOUND,
               page_id: str = "page_id", url: str = "url", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, p_bad for every row of `pages`.

    `labels` (doc_id, quality, toxic) are outcomes of pages by id: bad if any of a page's labels says quality 0 or toxic 1;
    null labels say nothing. Without a fitting rule, a host is blocked if mean - bound * deviation of its posterior lies
    above `tolerated`. Hosts without labels take their domain's estimate, and are allowed if the domain has none either; an
    empty host is a host of its own. Null urls and urls without :// have empty host and path. Repeated rows are judged alike.
    """
    outcome = (labels.groupBy(F.col("doc_id").alias("id"))
               .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad")).where("bad IS NOT NULL"))
    seen = staged(pages.select(F.col(page_id).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
                  .withColumn("site", site_of(F.col("host"))))
    tried = (seen.join(outcome, seen.page_id == outcome.id, "left")
             .groupBy("site").agg(F.count("*").alias("pages"), F.count("bad").alias("trials"),
                                  F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")))
    known = host_reputation(tried, suffixes)
    a, b = F.col("alpha"), F.col("beta")
    mean, dev = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    judged = known.select("site", "pages", F.when(a + b > 0, mean).otherwise(0.0).alias("p_bad"),
                          F.coalesce((F.col("above") > 0) & (mean - F.lit(bound) * dev > tolerated), F.lit(False)).alias("bad_host"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return (lookup(seen, judged, ["site"], "pages", seen.count())
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(verdict, F.when(F.col("bad_host"), "block").otherwise("allow")).alias("verdict"), "p_bad"))

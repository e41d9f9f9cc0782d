"""URL filter: rules first, then the reputation of the host.

Method: empirical Bayes. A labelled page is bad if its label says low quality or toxic. The share of bad pages of a
suffix is shrunk towards that of all pages, a registered domain's towards its suffix, a host's towards its domain:
each group's posterior is Beta(strength * prior + bad, strength * (1 - prior) + good), with the strength of a level
estimated from all its groups (method of moments). A page is blocked if even the lower posterior bound of its host's
bad share, `z` standard deviations below the mean, exceeds `limit`: few outcomes do not block.

Rules see the host as it stands in the url. Reputation is that of its site: the host without user, port and trailing
dots. A numeric address is its own registered domain, under one suffix of all addresses. The suffix of a site is its
last label, or its last two if a country's two letters follow one of the labels in `SECOND` (`co.uk`, `com.br`).

Everything is built-in DataFrame functions; outcomes are summed on the map side before any shuffle.

Edge cases: a null url or one without `://` has empty host and path, no rule and the prior of all pages; labels that
are null or missing give no outcome; a page with several labels counts each; repeated pages are judged each; with no
labels at all every verdict but a rule's is allow. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewarden.llm import common

#: (verdict, host, path), fixed by the query's contract.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Labels under which domains are registered if a country's label of two letters follows.
SECOND = ("ac", "co", "com", "edu", "gob", "gov", "gv", "info", "ltd", "mil", "ne", "net", "nhs", "nom", "or", "org", "plc", "sch")
#: User, port and trailing dots of a host; a suffix of two labels at its end; a numeric address and its suffix.
EXTRAS = (r"(?s)^.*@", r":[0-9]*\z", r"\.+\z")
TWO_LABELS = rf"(?:^|\.)(?:{'|'.join(SECOND)})\.[a-z][a-z]\z"
ADDRESS, ADDRESSES = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[[^\]]*\])\z", "#address"
#: Posterior bound in standard deviations, and the bad share above which a host is blocked.
Z, LIMIT = 1.645, 0.35
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def site_of(host: Column) -> Column:
    """The host that a reputation is of."""
    for extra in EXTRAS:
        host = F.regexp_replace(host, extra, "")
    return host


def _by_labels(site: Column, address: Column, labels: int) -> Column:
    """The last labels of a site, one more under a suffix of two."""
    two = F.substring_index(site, ".", -labels - 1)
    return F.when(F.rlike(site, F.lit(ADDRESS)), address).when(F.rlike(site, F.lit(TWO_LABELS)), two).otherwise(F.substring_index(site, ".", -labels))


def suffix_of(site: Column) -> Column:
    return _by_labels(site, F.lit(ADDRESSES), 1)


def domain_of(site: Column) -> Column:
    return _by_labels(site, site, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule = verdict = None
    for says, at, start in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == at) | F.endswith(host, F.lit(f".{at}"))) & F.startswith(path, F.lit(start))
        rule = F.when(fits, at + start) if rule is None else rule.when(fits, at + start)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule, verdict


def shrunk(groups: DataFrame, key: str, prior: Column) -> DataFrame:
    """key, mean, strength: each group's posterior mean and its number of outcomes, real and prior.

    groups: key, n, bad and the columns that `prior` reads. The level's strength comes from the spread of the groups'
    shares around their priors beyond what n outcomes make by chance.
    """
    g = groups.withColumn("prior", prior)
    # One row: sums over all groups of the level.
    p, q = F.col("prior"), F.col("prior") * (1 - F.col("prior"))
    level = g.agg(
        F.sum(F.col("n").cast("double") * F.pow(F.col("bad") / F.col("n") - p, 2)).alias("seen"),
        F.sum(q).alias("chance"),
        F.sum((F.col("n") - 1) * q).alias("room"),
    )
    share = (F.col("seen") - F.col("chance")) / F.col("room")
    bounded = F.when(F.coalesce(F.col("room"), F.lit(0.0)) <= 0, 0.01).otherwise(F.greatest(F.lit(0.001), F.least(F.lit(0.5), share)))
    level = level.select((1 / bounded - 1).alias("kappa"))
    # The level has one row whatever the input, so its join is a broadcast of 8 bytes.
    both = g.join(F.broadcast(level))
    return both.select(key, ((F.col("kappa") * F.col("prior") + F.col("bad")) / (F.col("kappa") + F.col("n"))).alias("mean"), (F.col("kappa") + F.col("n")).alias("strength"))


def reputations(pages: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Posterior tables of all pages (one row), suffixes, registered domains and sites that have outcomes, written one by one.

    pages: page_id, site. labels: doc_id, quality, toxic.
    """
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("bad IS NOT NULL")
    sites = pages.join(outcomes, "page_id").groupBy("site").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    sites = common.written(sites.select("site", suffix_of(F.col("site")).alias("suffix"), domain_of(F.col("site")).alias("domain"), "n", "bad"), "site-outcomes")
    every = sites.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    every = every.select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("base"), (F.col("n") + 2).cast("double").alias("base_strength"))
    suffixes = shrunk(sites.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).join(F.broadcast(every)), "suffix", F.col("base"))
    suffixes = common.written(suffixes, "suffixes")
    domains = sites.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = common.written(shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("up")), "suffix"), "domain", F.col("up")), "domains")
    leaves = common.written(shrunk(sites.join(domains.select("domain", F.col("mean").alias("up")), "domain"), "site", F.col("up")), "sites")
    return every, suffixes, domains, leaves


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, z: float = Z, limit: float = LIMIT) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    url = F.col("url")
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    split = common.written(split.withColumn("site", site_of(F.col("host"))), "urls")
    every, suffixes, domains, leaves = reputations(split, labels)
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    named = lambda t, key, p: t.select(key, F.col("mean").alias(f"{p}_mean"), F.col("strength").alias(f"{p}_strength"))
    # Sites are judged once each; a page then looks its site up.
    sites = split.select("site").distinct().withColumn("suffix", suffix_of(F.col("site"))).withColumn("domain", domain_of(F.col("site")))
    sites = sites.join(named(leaves, "site", "h"), "site", "left").join(named(domains, "domain", "d"), "domain", "left").join(named(suffixes, "suffix", "s"), "suffix", "left").join(F.broadcast(every))
    mean = F.coalesce("h_mean", "d_mean", "s_mean", "base")
    strength = F.coalesce("h_strength", "d_strength", "s_strength", "base_strength")
    bound = mean - z * F.sqrt(mean * (1 - mean) / (strength + 1))
    sites = common.written(sites.select("site", bound.alias("bad_bound")), "bounds")
    verdict = F.coalesce(says, F.when(F.col("bad_bound") > limit, "block").otherwise("allow"))
    return split.join(sites, "site").select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "labels"))


_LEVEL = """
{name}_level AS (
  SELECT CASE WHEN coalesce(sum((n - 1) * up * (1 - up)), 0) <= 0 THEN 0.01
    ELSE greatest(0.001, least(0.5, (sum(n * pow(bad / n - up, 2)) - sum(up * (1 - up))) / sum((n - 1) * up * (1 - up)))) END AS share
  FROM {name}_groups),
{name}_post AS (
  SELECT {key}, ((1 / share - 1) * up + bad) / ((1 / share - 1) + n) AS mean, (1 / share - 1) + n AS strength FROM {name}_groups, {name}_level)"""


def _last(k: int) -> str:
    return f"array_to_string(list_slice(string_split(site, '.'), -{k}, -1), '.')"


def _labels_sql(address: str, k: int) -> str:
    return f"CASE WHEN regexp_matches(site, '{ADDRESS}') THEN {address} WHEN regexp_matches(site, '{TWO_LABELS}') THEN {_last(k + 1)} ELSE {_last(k)} END"


_RULES_SQL = "\n    ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{k}}}'" for k, (v, h, p) in enumerate(sorted(RULES, key=lambda r: -len(r[1] + r[2]))))
_SORTED = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

OP10_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
split AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '{EXTRAS[0]}', ''), '{EXTRAS[1]}', ''), '{EXTRAS[2]}', '') AS site FROM parts),
outcomes AS (
  SELECT doc_id AS page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END AS bad FROM labels),
sites AS (
  SELECT site, {_labels_sql(f"'{ADDRESSES}'", 1)} AS suffix, {_labels_sql("site", 2)} AS domain FROM (SELECT DISTINCT site FROM split)),
seen AS (SELECT site, suffix, domain, n, bad FROM (
  SELECT site, count(*)::DOUBLE AS n, sum(bad)::DOUBLE AS bad FROM split JOIN outcomes USING (page_id) WHERE bad IS NOT NULL GROUP BY site) JOIN sites USING (site)),
every AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS base, coalesce(sum(n), 0) + 2 AS base_strength FROM seen),
s_groups AS (SELECT suffix, n, bad, base AS up FROM (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY suffix), every),
{_LEVEL.format(name="s", key="suffix")},
d_groups AS (SELECT domain, n, bad, mean AS up FROM (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM seen GROUP BY domain, suffix) JOIN s_post USING (suffix)),
{_LEVEL.format(name="d", key="domain")},
h_groups AS (SELECT site, n, bad, mean AS up FROM seen JOIN d_post USING (domain)),
{_LEVEL.format(name="h", key="site")},
judged AS (
  SELECT site, coalesce(h.mean, d.mean, s.mean, base) AS m, coalesce(h.strength, d.strength, s.strength, base_strength) AS k
  FROM sites LEFT JOIN h_post h USING (site) LEFT JOIN d_post d USING (domain) LEFT JOIN s_post s USING (suffix), every)
SELECT page_id, host, path,
  CASE {_RULES_SQL.format(*[h + p for _, h, p in _SORTED])} END AS rule,
  CASE {_RULES_SQL.format(*[v for v, _, _ in _SORTED])}
    WHEN m - {Z} * sqrt(m * (1 - m) / (k + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM split JOIN judged USING (site)
"""

"""URL filter with empirical-Bayes host reputation (operator 3).

Rules judge the pages they fit. Their verdicts are the labelled outcomes of hosts: a host of n
judged pages, k of them allowed, is a beta-binomial draw around its registered domain, a domain
around its suffix, a suffix around the mean of the suffixes, each of which is one draw. The strength c of each level is fitted by the
method of moments. A parent is known only as well as its own posterior says, a beta of strength T:
the prior of a child has the parent's mean and, by moments, the strength T c / (T + c + 1), less than
either. So a host without judged pages is at least as uncertain as its parent, and without judged
pages all the way up it is wide open. A page no rule fits is blocked when the upper bound of its
host's posterior allow rate is below ``THRESHOLD``: only when the evidence is clear.

Null urls, and those without ``://``, have empty host and path and no rule; the empty host is a
host. Repeated rows count each. Rates of an empty table are never needed. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landspan.llm.tables import ascii_lower
from landspan.workspace import materialize

RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
# Suffixes of several labels under which names are registered; a full list is a parameter.
WIDE_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz")
THRESHOLD = 0.5
# Standard deviations between the posterior mean and its upper bound.
BOUND = 1.645


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path, both empty when there is no ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return ascii_lower(host), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule, _ in sorted(rules, key=lambda r: len(r[0])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _moments(units: DataFrame, center: str) -> float:
    """Strength of the beta prior of units (n, k) around their centers.

    Of the variance between units, the part that binomial draws alone don't explain. A spread seen in a
    few units is not known well, so the strength is at most the number of units with outcomes.
    """
    m = F.col(center)
    sums = units.agg(
        F.sum(F.pow(F.col("k") - F.col("n") * m, 2)), F.sum(F.col("n") * m * (1 - m)),
        F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)), F.count_if(F.col("n") > 0)).first()
    spread, plain, room, seen = (float(x or 0.0) for x in sums)
    excess = (spread - plain) / room if room > 0 else 0.5
    return max(min(1 / min(max(excess, 0.001), 0.999) - 1, seen), 0.001)


def registered(host: Column, suffixes: Sequence[str] = WIDE_SUFFIXES) -> tuple[Column, Column]:
    """The name under which a host is registered, and its suffix.

    The suffix is the longest of the list that ends the host, else its last label; the name has one
    label more. A host that is a suffix itself is its own name.
    """
    labels = F.split(host, r"\.")

    def tail(n: int) -> Column:
        return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")

    domain, suffix = tail(2), tail(1)
    for n in sorted({s.count(".") + 1 for s in suffixes}):
        fits = (F.size(labels) >= n) & tail(n).isin(*[s for s in suffixes if s.count(".") + 1 == n])
        domain, suffix = F.when(fits, tail(n + 1)).otherwise(domain), F.when(fits, tail(n)).otherwise(suffix)
    return domain, suffix


def reputation(pages: DataFrame, suffixes: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """host, bound (upper bound of the allow rate), rate: one row a host, written.

    pages: host, rule_verdict (null where no rule fits). They are read once.
    """
    good = F.col("rule_verdict") == "allow"
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = materialize(pages.groupBy("host").agg(F.count("rule_verdict").alias("n"), F.count_if(good).alias("k")).select(
        "host", "n", "k", domain.alias("domain"), suffix.alias("suffix")), "hosts")
    domains = materialize(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    seen, rates = tops.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("k") / F.col("n")), F.lit(0.0))).first()

    def posterior(units: DataFrame, *names: str) -> DataFrame:
        """mean and strength of the posterior of units (n, k, prior, known)."""
        c = F.lit(_moments(units, "prior"))
        c = F.col("known") * c / (F.col("known") + c + 1)
        return units.withColumn("c", c).select(
            *names, ((F.col("k") + F.col("c") * F.col("prior")) / (F.col("n") + F.col("c"))).alias("mean"),
            (F.col("n") + F.col("c")).alias("strength"))

    def below(parents: DataFrame) -> DataFrame:
        return parents.withColumnsRenamed({"mean": "prior", "strength": "known"})

    tops = posterior(tops.withColumns({"prior": F.lit((rates + 1) / (seen + 2)), "known": F.lit(float(seen + 2))}), "suffix")
    domains = posterior(domains.join(below(tops), "suffix"), "domain", "suffix")
    rates = posterior(hosts.join(below(domains), ["domain", "suffix"]), "host")
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("strength") + 1))
    return materialize(rates.select("host", (F.col("mean") + F.lit(BOUND) * spread).alias("bound"),
                                    F.col("mean").alias("rate")), "reputation")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES,
               threshold: float = THRESHOLD, suffixes: Sequence[str] = WIDE_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page row."""
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn(
        "rule_verdict", F.element_at(F.create_map(*[F.lit(x) for r in rules for x in r]), F.col("rule")))
    known = reputation(ruled.select("host", "rule_verdict"), suffixes)
    return ruled.join(known, "host").select(
        "page_id", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("bound") < threshold, "block").otherwise("allow")
                   ).alias("verdict"))


def op3_url_reputation(spark, sf_dir: str) -> DataFrame:
    """Verdicts for every page."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


ORACLE_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut
), parts AS (
  SELECT page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule
  FROM parts
), judged AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
                 WHEN rule IS NOT NULL THEN 'block' END AS rule_verdict FROM ruled
), hosts AS (
  SELECT host, count(rule_verdict) AS n, count(*) FILTER (rule_verdict = 'allow') AS k,
    array_to_string(string_split(host, '.')[-2:], '.') AS two,
    array_to_string(string_split(host, '.')[-3:], '.') AS three,
    string_split(host, '.')[-1] AS one FROM judged GROUP BY host
), named AS (
  SELECT host, n, k,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN three ELSE two END AS domain,
    CASE WHEN two IN ('co.uk','org.uk','ac.uk','com.au','co.jp','com.br','co.nz') THEN two ELSE one END AS suffix
  FROM hosts
), domains AS (
  SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM named GROUP BY ALL
), suffixes AS (
  SELECT suffix, n, k, count(*) FILTER (n > 0) OVER () + 2 AS t,
    (coalesce(sum(k / nullif(n, 0)) OVER (), 0) + 1) / (count(*) FILTER (n > 0) OVER () + 2) AS m
  FROM (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix)
), s_prior AS (
  SELECT greatest(least(1 / least(greatest(coalesce((sum(pow(k - n * m, 2)) - sum(n * m * (1 - m)))
      / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.999) - 1, count(*) FILTER (n > 0)), 0.001) AS c
  FROM suffixes
), s_rate AS (
  SELECT suffix, (k + t * c / (t + c + 1) * m) / (n + t * c / (t + c + 1)) AS m, n + t * c / (t + c + 1) AS t
  FROM suffixes, s_prior
), d_units AS (
  SELECT domain, domains.suffix, n, k, m, t FROM domains JOIN s_rate USING (suffix)
), d_prior AS (
  SELECT greatest(least(1 / least(greatest(coalesce((sum(pow(k - n * m, 2)) - sum(n * m * (1 - m)))
      / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.999) - 1, count(*) FILTER (n > 0)), 0.001) AS c
  FROM d_units
), d_rate AS (
  SELECT domain, suffix, (k + t * c / (t + c + 1) * m) / (n + t * c / (t + c + 1)) AS m,
    n + t * c / (t + c + 1) AS t FROM d_units, d_prior
), h_units AS (
  SELECT host, n, k, m, t FROM named JOIN d_rate USING (domain, suffix)
), h_prior AS (
  SELECT greatest(least(1 / least(greatest(coalesce((sum(pow(k - n * m, 2)) - sum(n * m * (1 - m)))
      / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.999) - 1, count(*) FILTER (n > 0)), 0.001) AS c
  FROM h_units
), posterior AS (
  SELECT host, (k + t * c / (t + c + 1) * m) / (n + t * c / (t + c + 1)) AS m, n + t * c / (t + c + 1) AS t
  FROM h_units, h_prior
)
SELECT page_id, host, path, rule, coalesce(rule_verdict,
  CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (t + 1)) < 0.5
       THEN 'block' ELSE 'allow' END) AS verdict
FROM judged JOIN posterior USING (host)
"""

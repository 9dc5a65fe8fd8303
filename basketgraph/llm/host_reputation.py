"""Operator 1: empirical-Bayes host reputation and url rules.

Labelled page outcomes (good or not) are counted by host, registered domain and suffix. At
each level a beta-binomial is fitted by moments (the intraclass correlation of the groups'
rates gives the prior's strength), and each level's posterior mean is the prior mean of the
level below: overall rate -> suffix -> domain -> host. A host is blocked when even the upper
posterior bound ``mean + z * sd`` of its good rate stays below ``min_good``; a host without
labels has its domain's posterior. Explicit rules come before the method's verdict.

Pages are aggregated by host before any other shuffle, so a hot host is one row a map task;
the table of hosts joins back broadcast if its measured size allows, else as a shuffle join
that AQE splits.

Defined cases: a null url or one without ``://`` has empty host and path and the verdict of
the overall rate; null outcomes are ignored; without outcomes the overall rate is 0.5;
repeated pages are each judged; rules on the same host and path resolve to block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Second labels that belong to the suffix under a two-letter top domain.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def _rest(url: str) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))


def url_host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: str = "url") -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def with_domain(hosts: DataFrame) -> DataFrame:
    """Adds suffix and domain; user and port do not count, an address is its own domain."""
    name = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(F.col("name"), r"\.")
    n = F.size("parts")
    two = (n >= 2) & F.element_at("parts", -1).rlike("^[a-z]{2}$") & \
        F.coalesce(F.try_element_at("parts", F.lit(-2)).isin(*SECOND_LEVEL), F.lit(False))
    k = F.when(two, 2).otherwise(1)
    lone = F.col("name").rlike(r"^[0-9.]+$") | F.col("name").contains("[") | (n <= k)
    tail = lambda size: F.array_join(F.expr(f"slice(parts, greatest(size(parts) - {size} + 1, 1), {size})"), ".")
    return (hosts.withColumn("name", name).withColumn("parts", parts).withColumn("k", k)
            .withColumn("suffix", F.when(lone, F.col("name")).otherwise(tail("k")))
            .withColumn("domain", F.when(lone, F.col("name")).otherwise(tail("(k + 1)")))
            .drop("name", "parts", "k"))


def _strength(groups: DataFrame, rate: float) -> float:
    """Strength (a + b) of the beta prior whose groups vary as these do, by moments."""
    r = groups.where("n > 0").agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("n2"),
        F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - F.lit(rate), F.lit(2.0))).alias("s")).first()
    if not r["n"] or r["k"] < 2 or not 0 < rate < 1:
        return 1000.0
    spare = r["n"] - r["n2"] / r["n"] - (r["k"] - 1)
    rho = (r["s"] / (rate * (1 - rate)) - (r["k"] - 1)) / spare if spare > 0 else 0.0
    rho = min(max(rho, 0.001), 0.5)
    return 1 / rho - 1


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.64,
                    min_good: float = 0.5) -> tuple[DataFrame, int]:
    """(host, n, good, mean, upper, verdict) for every host of ``pages`` (page_id, url), and
    the number of hosts. ``outcomes``: page_id, good (0/1)."""
    o = outcomes.where("page_id is not null and good is not null").groupBy("page_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("good").alias("good")).withColumnRenamed("page_id", "o_id")
    counted = (pages.select("page_id", url_host().alias("host"))
               .join(o, F.col("page_id") == F.col("o_id"), "left").groupBy("host")
               .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("good")))
    hosts, seen = kept(with_domain(counted), "hosts", n=F.sum("n"), good=F.sum("good"))
    rate = seen["good"] / seen["n"] if seen["n"] else 0.5
    both = [F.sum("n").alias("n"), F.sum("good").alias("good")]
    domains, n_domains = kept(hosts.groupBy("domain", "suffix").agg(*both), "domains")
    suffixes, n_suffixes = kept(domains.groupBy("suffix").agg(*both), "suffixes")
    ks, kd, kh = (_strength(x, rate) for x in (suffixes, domains, hosts))
    s = suffixes.select(F.col("suffix").alias("s_key"), ((ks * rate + F.col("good")) / (ks + F.col("n"))).alias("s_mean"))
    d = (domains.join(small(s, n_suffixes["rows"], 64), F.col("suffix") == F.col("s_key"))
         .select(F.col("domain").alias("d_key"), ((kd * F.col("s_mean") + F.col("good")) / (kd + F.col("n"))).alias("d_mean")))
    h = hosts.join(small(d, n_domains["rows"], 96), F.col("domain") == F.col("d_key"))
    total = F.lit(kh) + F.col("n")
    mean = (kh * F.col("d_mean") + F.col("good")) / total
    upper = F.col("mean") + z * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (total + 1))
    judged = h.withColumn("mean", mean).withColumn("upper", upper)
    return judged.select("host", "n", "good", "mean", "upper",
                         F.when(F.col("upper") < min_good, "block").otherwise("allow").alias("verdict")), seen["rows"]


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules): for each host the rules on it or a domain above it."""
    above = hosts.select("host", F.split("host", r"\.").alias("p")).select("host", F.explode(F.expr(
        "transform(sequence(1, size(p)), i -> array_join(slice(p, i, size(p)), '.'))")).alias("above"))
    r = rules.select(F.col("host").alias("r_host"), F.struct(
        F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), "verdict",
        "path", F.concat("host", "path").alias("rule")).alias("rule"))
    return above.join(r, F.col("above") == F.col("r_host")).groupBy("host").agg(F.collect_list("rule").alias("rules"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: DataFrame, z: float = 1.64,
               min_good: float = 0.5) -> DataFrame:
    """One row a page: page_id, host, path, rule, verdict. ``rules``: host, path, verdict;
    a rule fits its host and all subdomains when the url's path starts with its path, and
    the longest rule wins."""
    hosts, n = host_reputation(pages, outcomes, z, min_good)
    table = hosts.select(F.col("host").alias("h"), F.col("verdict").alias("method"))
    fits = host_rules(hosts.select("host"), rules).withColumnRenamed("host", "f")
    table, seen = kept(table.join(fits, F.col("h") == F.col("f"), "left").drop("f"), "judged",
                       bytes=F.sum(F.length("h") + 24 + 80 * F.coalesce(F.size("rules"), F.lit(0))))
    urls = pages.select("page_id", url_host().alias("host"), url_path().alias("path"))
    one = max(1, -(-(seen["bytes"] or 0) // max(1, seen["rows"])))
    best = F.array_max(F.expr("filter(rules, r -> startswith(path, r.path))"))
    return (urls.join(small(table, seen["rows"], one), F.col("host") == F.col("h"))
            .withColumn("best", best)
            .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                    F.coalesce("best.verdict", "method").alias("verdict")))


def op1_host_reputation(spark, sf_dir):
    """Outcomes: the label of the page's id in ``labels`` (quality 1 is good)."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    rules = spark.createDataFrame(list(RULES), "host string, path string, verdict string")
    return judge_urls(pages, outcomes, rules)


_STRENGTH = """
  SELECT CASE WHEN coalesce(sum(n), 0) = 0 OR count(*) < 2 OR any_value(rate) <= 0 OR any_value(rate) >= 1 THEN 1000.0::DOUBLE
    ELSE 1 / least(greatest(CASE WHEN sum(n) - sum(n * n)::DOUBLE / sum(n) - (count(*) - 1) > 0
      THEN (sum(n * pow(good::DOUBLE / n - rate, 2)) / (any_value(rate) * (1 - any_value(rate))) - (count(*) - 1))
           / (sum(n) - sum(n * n)::DOUBLE / sum(n) - (count(*) - 1)) ELSE 0 END, 0.001), 0.5) - 1 END AS kappa
  FROM {0}, r WHERE n > 0"""

OP1_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
o AS (SELECT doc_id, count(*) AS n, sum(quality) AS good FROM labels
      WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
h0 AS (
  SELECT host, coalesce(sum(n), 0)::BIGINT AS n, coalesce(sum(good), 0)::BIGINT AS good,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM p LEFT JOIN o ON p.page_id = o.doc_id GROUP BY host),
h1 AS (SELECT *, string_split(name, '.') AS parts FROM h0),
h2 AS (
  SELECT *, CASE WHEN len(parts) >= 2 AND regexp_matches(parts[-1], '^[a-z][a-z]$')
                  AND parts[-2] IN {SECOND_LEVEL} THEN 2 ELSE 1 END AS k FROM h1),
h AS (
  SELECT host, n, good,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') OR contains(name, '[') OR len(parts) <= k THEN name
              ELSE array_to_string(parts[-k:], '.') END AS suffix,
         CASE WHEN regexp_matches(name, '^[0-9.]+$') OR contains(name, '[') OR len(parts) <= k THEN name
              ELSE array_to_string(parts[-(k + 1):], '.') END AS domain FROM h2),
r AS (SELECT CASE WHEN sum(n) > 0 THEN sum(good)::DOUBLE / sum(n) ELSE 0.5 END AS rate FROM h),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY suffix),
ks AS ({_STRENGTH.format('s')}), kd AS ({_STRENGTH.format('d')}), kh AS ({_STRENGTH.format('h')}),
sm AS (SELECT suffix, (kappa * rate + good) / (kappa + n) AS m FROM s, ks, r),
dm AS (SELECT domain, (kappa * m + good) / (kappa + n) AS m FROM d JOIN sm USING (suffix), kd),
hm AS (SELECT host, n + kappa AS t, (kappa * m + good) / (kappa + n) AS m FROM h JOIN dm USING (domain), kh),
v AS (SELECT host, CASE WHEN m + 1.64::DOUBLE * sqrt(m * (1 - m) / (t + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS method FROM hm),
rules(rh, rp, rv) AS (VALUES {', '.join(str(x) for x in RULES)}),
f AS (
  SELECT p.page_id, p.host, p.path, rh || rp AS rule, rv,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(rh || rp) DESC, rv DESC) AS k
  FROM (SELECT DISTINCT * FROM p) p JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rv, v.method) AS verdict
FROM p JOIN v USING (host) LEFT JOIN f ON f.page_id = p.page_id AND f.host = p.host AND f.path = p.path AND f.k = 1
"""

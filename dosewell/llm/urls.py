"""URL filters by host rules and empirical-Bayes host reputation, with DataFrame functions only.

Labelled pages are counted by host. A beta prior is passed down from all pages to the public suffix,
to the registered domain, to the host: each level's mean shrinks towards its parent's by a strength
estimated from how much that level's groups differ (method of moments). A page is allowed if the
lower bound of its host's share of good pages, by a normal approximation of the posterior, reaches the threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path): fits the host and its subdomains if the URL's path starts with the path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Public suffixes of two labels; any other suffix is the last label. Fixed values.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.nz", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.au", "org.uk")
#: Lower bound of a good share that is still allowed, and its standard deviations below the mean.
THRESHOLD, Z = 0.7, 1.645
#: A strength is kept between these numbers of pages.
LEAST, MOST = 1.0, 1000.0


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(the longest fitting rule, its verdict), null if none fits."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):  # a later one wins
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the mean good share and the prior strength of groups with _n pages, _k of them good."""
    n, k = F.col("_n").cast("double"), F.col("_k").cast("double")
    x = groups.agg(F.count("*").cast("double").alias("g"), F.coalesce(F.sum(n), F.lit(0.0)).alias("n"), F.coalesce(F.sum(k), F.lit(0.0)).alias("k"), F.coalesce(F.sum(n * n), F.lit(0.0)).alias("n2"), F.coalesce(F.sum(k * k / n), F.lit(0.0)).alias("k2"))
    mean = F.when(F.col("n") > 0, F.col("k") / F.col("n")).otherwise(0.5)
    x = x.withColumn("m", mean).withColumn("v", F.col("m") * (1 - F.col("m")))
    between, free = F.col("k2") - F.col("n") * F.col("m") * F.col("m") - F.col("v") * (F.col("g") - 1), F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)
    rho = F.when((F.col("n") > 0) & (F.col("v") > 0) & (free > 0), between / (F.col("v") * free)).otherwise(0.0)
    rho = F.greatest(F.least(rho, F.lit(1 / (1 + LEAST))), F.lit(1 / (1 + MOST)))
    return x.select(F.col("m").alias(f"_m_{name}"), (1 / rho - 1).alias(f"_s_{name}"))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host -> good_share, lower_bound, n_labelled.

    `pages` has page_id and host, `outcomes` page_id and good (boolean), several a page allowed. A page
    that is repeated counts once, and one without an id has no outcomes. Pages are counted by host
    first, so all further steps are over hosts; domains and suffixes are sums that hosts look up, and
    no host, domain or suffix needs a task of its own. A host without labels has its domain's mean;
    without any labels at all the mean is 0.5.
    """
    pages = pages.distinct()
    labelled = outcomes.filter(F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("int")).alias("k"))
    hosts = pages.join(labelled, "page_id", "left").groupBy("host").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("k"), F.lit(0)).alias("_k"))
    hosts = hosts.withColumn("_domain", domain_of(F.col("host"))).withColumn("_suffix", suffix_of(F.col("host")))
    total = lambda key: hosts.groupBy(key).agg(F.sum("_n").alias("_n"), F.sum("_k").alias("_k"))
    level = lambda key: total(key).filter("_n > 0")
    priors = _strength(level("_suffix"), "suffix").crossJoin(_strength(level("_domain"), "domain")).crossJoin(_strength(level("host"), "host"))  # one row each
    domains = total("_domain").withColumnsRenamed({"_n": "_nd", "_k": "_kd"})
    suffixes = total("_suffix").withColumnsRenamed({"_n": "_ns", "_k": "_ks"})
    x = hosts.join(domains, "_domain").join(suffixes, "_suffix").crossJoin(F.broadcast(priors))
    shrunk = lambda parent, strength, k, n: (F.col(strength) * F.col(parent) + F.col(k)) / (F.col(strength) + F.col(n))
    x = x.withColumn("_ps", shrunk("_m_suffix", "_s_suffix", "_ks", "_ns"))
    x = x.withColumn("_pd", shrunk("_ps", "_s_domain", "_kd", "_nd"))
    x = x.withColumn("good_share", shrunk("_pd", "_s_host", "_k", "_n"))
    deviation = F.sqrt(F.greatest(F.col("good_share") * (1 - F.col("good_share")), F.lit(0.0)) / (F.col("_s_host") + F.col("_n") + 1))
    return x.select("host", "good_share", (F.col("good_share") - Z * deviation).alias("lower_bound"), F.col("_n").alias("n_labelled"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules: tuple = RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judges every page: page_id, host, path, rule, verdict, good_share, lower_bound.

    A fitting rule decides, the longest first; otherwise the posterior bound of the host does. A null
    URL or one without `://` has an empty host and path and is judged by the reputation of the empty
    host. Repeated rows are judged alike and count once in reputations; an empty table gives no rows;
    other columns are not read.
    """
    x = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    reputation = host_reputation(x.select("page_id", "host"), outcomes).withColumnRenamed("host", "_host")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    by_bound = F.when(F.round("lower_bound", 9) >= threshold, "allow").otherwise("block")
    return x.join(reputation, F.col("host") == F.col("_host"), "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_bound).alias("verdict"), F.round("good_share", 6).alias("good_share"), F.round("lower_bound", 6).alias("lower_bound"))


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels of the documents that pages show: the number after the language in a path is the doc_id."""
    number = F.regexp_extract(path_of(F.col("url")), r"^/[a-z]{2}/(\d{1,18})", 1)
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"), F.when(number != "", number).cast("long").alias("_doc")).distinct()
    good = labels.select(F.col("doc_id").cast("long").alias("_doc"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return ids.filter(F.col("_doc").isNotNull()).join(good, "_doc").select("page_id", "good")


ORACLE = r"""
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
o AS (
  SELECT p.page_id, count(*) AS n, sum(CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END) AS k
  FROM (SELECT DISTINCT page_id, TRY_CAST(regexp_extract(path, '^/[a-z]{2}/(\d{1,18})', 1) AS BIGINT) AS doc FROM p) p JOIN labels l ON l.doc_id = p.doc GROUP BY p.page_id),
two AS (SELECT host, coalesce(sum(n), 0) AS n, coalesce(sum(k), 0) AS k, array_to_string(string_split(host, '.')[-2:], '.') AS t2,
        array_to_string(string_split(host, '.')[-3:], '.') AS t3, array_to_string(string_split(host, '.')[-1:], '.') AS t1
        FROM (SELECT DISTINCT page_id, host FROM p) LEFT JOIN o USING (page_id) GROUP BY host),
h AS (
  SELECT host, CAST(n AS DOUBLE) AS n, CAST(k AS DOUBLE) AS k,
         CASE WHEN t2 IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.au', 'org.uk') THEN t3 ELSE t2 END AS dom,
         CASE WHEN t2 IN ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'com.cn', 'gov.uk', 'org.au', 'org.uk') THEN t2 ELSE t1 END AS suf FROM two),
g AS (
  SELECT 'host' AS lev, n, k FROM h WHERE n > 0
  UNION ALL SELECT 'dom', sum(n), sum(k) FROM h GROUP BY dom HAVING sum(n) > 0
  UNION ALL SELECT 'suf', sum(n), sum(k) FROM h GROUP BY suf HAVING sum(n) > 0),
m AS (SELECT lev, count(*) AS g, sum(n) AS n, sum(n * n) AS n2, sum(k * k / n) AS k2, sum(k) / sum(n) AS m FROM g GROUP BY lev),
f AS (SELECT lev, m, m * (1 - m) AS v, n - n2 / n - (g - 1) AS free, k2 - n * m * m - m * (1 - m) * (g - 1) AS between_ FROM m),
s AS (SELECT lev, m, 1 / greatest(least(CASE WHEN v > 0 AND free > 0 THEN between_ / (v * free) ELSE 0 END, 0.5), 1 / 1001.0) - 1 AS s FROM f),
u AS (SELECT coalesce((SELECT m FROM s WHERE lev = 'suf'), 0.5) AS m, coalesce((SELECT s FROM s WHERE lev = 'suf'), 1000) AS ss, coalesce((SELECT s FROM s WHERE lev = 'dom'), 1000) AS sd, coalesce((SELECT s FROM s WHERE lev = 'host'), 1000) AS sh),
a AS (
  SELECT h.*, u.*, sum(n) OVER (PARTITION BY dom) AS nd, sum(k) OVER (PARTITION BY dom) AS kd, sum(n) OVER (PARTITION BY suf) AS ns, sum(k) OVER (PARTITION BY suf) AS ks FROM h, u),
b AS (SELECT *, (ss * m + ks) / (ss + ns) AS ps FROM a),
c AS (SELECT *, (sd * ps + kd) / (sd + nd) AS pd FROM b),
e AS (SELECT *, (sh * pd + k) / (sh + n) AS good FROM c),
q AS (SELECT host, good, good - 1.645 * sqrt(greatest(good * (1 - good), 0) / (sh + n + 1)) AS low FROM e),
j AS (
  SELECT p.*, q.good, q.low,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM p JOIN q USING (host))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN round(low, 9) >= 0.7 THEN 'allow' ELSE 'block' END AS verdict,
       round(good, 6) AS good_share, round(low, 6) AS lower_bound
FROM j
"""

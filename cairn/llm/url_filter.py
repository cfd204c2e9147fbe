"""Operator 2. URL filter by empirical-Bayes host reputation.

Labelled pages give each host good and bad outcomes. Rates are shrunk level by level: the suffix (all
after the registered name) toward the global rate, the registered domain toward its suffix, the host
toward its domain. At each level the pseudo-count of the beta prior is fitted by moments to the units of
that level, weighted by their outcomes, against the means they are shrunk to. A page is dropped when the
lower posterior bound of its host's bad rate, mean less ``Z`` standard deviations, exceeds the global rate: the host is credibly worse than pages are at large.

Defined results: a page is labelled by the label row of the same id, bad when its quality is 0 or it is
toxic; several label rows count each; labels with a null id or with both outcomes null do not count. A URL
that is null or has no host has the host ``''`` and is kept with the prior of the level above; hosts are
lower-cased and lose port, user and a trailing dot; a host of one label or of four numbers is its own domain with the
suffix ``''``. Pages are kept or dropped row by row: repeated pages and null ids are judged by their host and each counts its labels. Extra
columns are ignored; an empty table gives an empty result. A host without labels takes its domain's posterior mean with the prior's width. Without any label the global rate is 0.5 with the least strength.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import narrowed, small, written

#: Standard deviations from the posterior mean to its lower bound: three in four hosts whose bound is beyond the global rate are worse than it.
Z = 0.674
LEAST, MOST = 2.0, 1000.0
#: Suffixes of two labels: these below a country's; any other suffix is the last label.
SECOND_LEVEL = r"^(ac|co|com|edu|go|gob|gov|mil|ne|net|nom|or|org|sch)[.][a-z][a-z]$"


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(raw, r"\.$", "")


def _parts(host: Column) -> tuple[Column, Column]:
    labels = F.split(host, r"\.")
    two = F.concat_ws(".", F.slice(labels, -2, 2))
    whole = (F.size(labels) < 2) | host.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    deep = (F.size(labels) > 2) & two.rlike(SECOND_LEVEL)
    domain = F.when(whole, host).when(deep, F.concat_ws(".", F.slice(labels, -3, 3))).otherwise(two)
    suffix = F.when(whole, F.lit("")).when(deep, two).otherwise(F.element_at(labels, -1))
    return domain, suffix


def _shrunk(units: DataFrame, key: str) -> DataFrame:
    """``units(key, bad, n, m)`` with posterior ``a, b`` under the fitted strength ``k``; ``m`` is the mean to shrink to."""
    seen = F.col("n") > 0
    sq = F.sum(F.when(seen, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("m"), 2)).otherwise(0.0))
    inside = F.sum(F.col("n") * F.col("m") * (1 - F.col("m")))
    noise = F.sum(F.when(seen, F.col("m") * (1 - F.col("m"))).otherwise(0.0))
    fit = units.agg(sq.alias("sq"), inside.alias("inside"), noise.alias("noise"))
    k = F.coalesce(F.least(F.greatest(F.col("inside") / F.greatest(F.col("sq") - F.col("noise"), F.lit(1e-9)) - 1, F.lit(LEAST)), F.lit(MOST)), F.lit(LEAST))
    fit = fit.select(k.alias("k"))
    a, b = F.col("bad") + F.col("k") * F.col("m"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("m"))
    return units.crossJoin(F.broadcast(fit)).withColumns({"a": a, "b": b})  # one row


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a host: ``host, domain, suffix, n, bad, mean, lower``."""
    outcome = labels.select(F.col("doc_id").alias("page_id"), ((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)).cast("long").alias("bad"), (F.col("quality").isNotNull() | F.col("toxic").isNotNull()).alias("known")).where("known and page_id is not null")
    outcome = outcome.groupBy("page_id").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n"))
    seen = pages.select("page_id", host_of(F.col("url")).alias("host")).join(outcome, "page_id", "left")
    hosts = seen.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    domain, suffix = _parts(F.col("host"))
    hosts = written(hosts.withColumns({"domain": domain, "suffix": suffix}), "host-outcomes")
    up = lambda df, key, *more: df.groupBy(key, *more).agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    rate = hosts.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1.0)).alias("m"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    suffixes = _shrunk(up(hosts, "suffix").crossJoin(F.broadcast(rate)), "suffix").select("suffix", mean.alias("m"))
    domains = _shrunk(up(hosts, "domain", "suffix").join(suffixes, "suffix"), "domain").select("domain", "suffix", mean.alias("m"))
    out = _shrunk(hosts.join(domains, ["domain", "suffix"]), "host")
    total = F.col("a") + F.col("b")
    lower = F.greatest(mean - Z * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1))), F.lit(0.0))
    out = out.crossJoin(F.broadcast(rate.select(F.col("m").alias("all"))))  # one row
    return out.select("host", "domain", "suffix", "n", "bad", mean.alias("mean"), lower.alias("lower"), "all")


def filter_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's result: every page with its host's posterior and whether it is kept."""
    pages, labels = narrowed(pages, "page_id", "url"), narrowed(labels, "doc_id", "quality", "toxic")
    rep = written(host_reputation(pages, labels), "reputation")
    df = pages.withColumn("host", host_of(F.col("url"))).join(small(rep), "host", "left")
    return df.select("page_id", "host", "domain", "suffix", F.col("n").alias("labelled"), F.col("bad").alias("bad_outcomes"), F.round("mean", 6).alias("bad_rate"), F.round("lower", 6).alias("bad_rate_lower"), ((F.col("host") == "") | (F.col("lower") <= F.col("all"))).alias("keep"))


def _level(name: str, src: str) -> str:
    k = f"coalesce(least(greatest(sum(n * m * (1 - m)) / greatest(sum(CASE WHEN n > 0 THEN n * (bad / n - m) ** 2 ELSE 0 END) - sum(CASE WHEN n > 0 THEN m * (1 - m) ELSE 0 END), 1e-9) - 1, {LEAST}), {MOST}), {LEAST})"
    return f"{name}_k AS (SELECT {k} AS k FROM {src}), {name}_p AS (SELECT *, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM {src}, {name}_k)"


SQL = f"""
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\\.$', '') AS host FROM pages),
o AS (SELECT doc_id AS page_id, sum((coalesce(quality, 1) = 0 OR coalesce(toxic, 0) = 1)::INT) AS bad, count(*) AS n FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, coalesce(sum(bad), 0) AS bad, coalesce(sum(n), 0) AS n FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l, array_to_string(string_split(host, '.')[-2:], '.') AS two FROM h0),
h2 AS (SELECT host, bad, n, l, two, len(l) < 2 OR regexp_matches(host, '^[0-9]+(\\.[0-9]+){{3}}$') AS whole, len(l) > 2 AND regexp_matches(two, '{SECOND_LEVEL}') AS deep FROM h1),
h AS (SELECT host, bad, n, CASE WHEN whole THEN host WHEN deep THEN array_to_string(l[-3:], '.') ELSE two END AS domain, CASE WHEN whole THEN '' WHEN deep THEN two ELSE l[-1] END AS suffix FROM h2),
rate AS (SELECT (coalesce(sum(bad), 0) + 0.5::DOUBLE) / (coalesce(sum(n), 0) + 1) AS m FROM h),
s0 AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY suffix),
s AS (SELECT s0.*, (SELECT m FROM rate) AS m FROM s0),
{_level("s", "s")},
d0 AS (SELECT domain, suffix, sum(bad) AS bad, sum(n) AS n FROM h GROUP BY domain, suffix),
d AS (SELECT d0.*, a / (a + b) AS m FROM d0 JOIN (SELECT suffix, a, b FROM s_p) USING (suffix)),
{_level("d", "d")},
g AS (SELECT h.*, a / (a + b) AS m FROM h JOIN (SELECT domain, suffix, a, b FROM d_p) USING (domain, suffix)),
{_level("g", "g")},
r AS (SELECT *, a / (a + b) AS mean, greatest(a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS lower_ FROM g_p)
SELECT page_id, host, domain, suffix, n::BIGINT AS labelled, bad::BIGINT AS bad_outcomes, round(mean, 6) AS bad_rate, round(lower_, 6) AS bad_rate_lower, host = '' OR lower_ <= (SELECT m FROM rate) AS keep
FROM p JOIN r USING (host)"""

"""URL filter: a rule list, and where no rule fits, an empirical-Bayes reputation of the host.

Every labelled page is an outcome, bad or good, of its host.  A host's rate of bad pages is shrunk by
a beta-binomial prior towards its registered domain, the domain's towards its suffix, the suffix's
towards the whole; how strongly, each level tells itself by the spread of its members around their
parents (moments of the beta-binomial).  A page is blocked when even the lower posterior bound of its
host's bad rate is above a limit, so a host with few outcomes is never blocked on their account alone.

Only DataFrame functions are used.  Pages are counted per host before anything is shuffled, so a host
with a third of all pages is one row a task; the counts are written once.  Verdicts come back in one
join on the host, which Spark splits where a host is hot; pages that a rule decides take no part in it.

Defined cases: a NULL url, or one without ``://``, has empty host and path, fits no rule and is
judged as the host ``''``.  A page with a NULL label counts for no host.  Without any labelled page every host
has the rate 1/2 and is allowed.  Repeated pages count each; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritable.llm.common import field, kept


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Suffixes of two labels under which names are registered; all others have one.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.in", "co.nz")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of text and verdict; NULL if none fits."""
    out = F.lit(None).cast("struct<text: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; an address of digits is its own."""
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two, three = F.substring_index(bare, ".", -2), F.substring_index(bare, ".", -3)
    return F.when(bare.rlike(r"^[0-9.]+$"), bare).when(two.isin(*TWO_LABEL_SUFFIXES), three).otherwise(two)


def suffix_of(host: Column) -> Column:
    bare = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.substring_index(bare, ".", -2)
    return (
        F.when(bare.rlike(r"^[0-9.]+$"), F.lit(""))
        .when(two.isin(*TWO_LABEL_SUFFIXES), two)
        .otherwise(F.substring_index(bare, ".", -1))
    )


def junk(html: Column, share: float = 0.25) -> Column:
    """1 where marks (runs of signs, lone bars, words in capitals before ``!!``) make up more than ``share`` of the visible
    words, 0 elsewhere, NULL without a page."""
    shown = F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), r"<[^>]*>", " ")
    n = F.regexp_count(shown, F.lit(r"[^ \t\n\x0B\f\r]+"))
    odd = F.regexp_count(shown, F.lit(r"[%$&*#!|]{2,}|[ \n][|][ \n]"))
    return F.when(odd > share * n, F.lit(1)).when(html.isNotNull(), F.lit(0))


def _strength(members: DataFrame) -> float:
    """Pseudo-counts of the prior: 1 / rho - 1, rho being the members' overdispersion around ``parent``.

    A member with one outcome says nothing about spread within members and is left out."""
    noise = F.col("parent") * (1 - F.col("parent"))
    r = members.filter((F.col("n") > 1) & (noise > 0)).agg(
        F.sum(F.pow(F.col("k") - F.col("n") * F.col("parent"), 2) / F.col("n")).alias("seen"),
        F.sum(noise).alias("expected"),
        F.sum(noise * (F.col("n") - 1)).alias("room"),
    ).first()
    if not r["room"]:
        return 1.0
    rho = min(max((r["seen"] - r["expected"]) / r["room"], 0.001), 0.999)
    return 1 / rho - 1


def reputation(pages: DataFrame, z: float = 1.645, limit: float = 0.5) -> DataFrame:
    """From ``host`` and ``bad`` (1, 0 or NULL), one row a host: counts, posterior mean, lower bound, ``host_verdict``."""
    counted = pages.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("k"))
    hosts = kept(
        counted.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "k"),
        "hosts",
    )
    totals = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    domains = hosts.groupBy("domain", "suffix").agg(*totals)
    suffixes = domains.groupBy("suffix").agg(*totals)
    whole = suffixes.agg(*totals).first()
    rate = ((whole["k"] or 0) + 0.5) / ((whole["n"] or 0) + 1)

    def shrunk(members: DataFrame) -> Column:
        m = _strength(members)
        return (m * F.col("parent") + F.col("k")) / (m + F.col("n")), m

    suffixes = suffixes.withColumn("parent", F.lit(rate))
    mean, _ = shrunk(suffixes)
    domains = domains.join(suffixes.select("suffix", mean.alias("parent")), "suffix")
    mean, _ = shrunk(domains)
    hosts = hosts.join(domains.select("domain", "suffix", mean.alias("parent")), ["domain", "suffix"])
    mean, m = shrunk(hosts)
    size = F.lit(m) + F.col("n")
    bound = F.greatest(mean - z * F.sqrt(mean * (1 - mean) / (size + 1)), F.lit(0.0))
    return hosts.select(
        "host",
        "n",
        "k",
        mean.alias("bad_rate"),
        bound.alias("lower_bound"),
        F.when(bound > limit, F.lit("block")).otherwise(F.lit("allow")).alias("host_verdict"),
    )


def judge(pages: DataFrame, rules: list[UrlRule], bad: Column, z: float = 1.645, limit: float = 0.5) -> DataFrame:
    """One row a page: ``page_id, host, path, rule, verdict``.  ``bad`` labels a page of ``pages``."""
    url = field(pages, "url").cast("string")
    host = host_of(url)
    hosts = reputation(pages.select(host.alias("host"), bad.alias("bad")), z, limit)
    rows = pages.select(field(pages, "page_id").alias("page_id"), host.alias("host"), path_of(url).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    ruled = rows.filter(F.col("found").isNotNull()).select(
        "page_id", "host", "path", F.col("found.text").alias("rule"), F.col("found.verdict").alias("verdict")
    )
    rest = rows.filter(F.col("found").isNull()).join(hosts.select("host", "host_verdict"), "host", "left")
    return ruled.unionByName(
        rest.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.col("host_verdict").alias("verdict"))
    )


RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


def op4(pages: DataFrame) -> DataFrame:
    """The digest of the registered query: the contract's rules, outcomes by the pages' own junk."""
    return judge(pages, RULES, junk(field(pages, "html").cast("string")))


_STRENGTH = """
SELECT CASE WHEN coalesce(sum(parent * (1 - parent) * (n - 1)), 0) = 0 THEN 1.0 ELSE
  1 / least(greatest((sum(pow(k - n * parent, 2) / n) - sum(parent * (1 - parent))) / sum(parent * (1 - parent) * (n - 1)), 0.001), 0.999) - 1 END AS m
FROM {0} WHERE n > 1 AND parent * (1 - parent) > 0"""

_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)

ORACLE = rf"""
WITH cut AS (
  SELECT page_id, html,
    coalesce(translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
shown AS (
  SELECT host, html, regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM cut),
labelled AS (
  SELECT host, CASE WHEN html IS NULL THEN NULL
    WHEN len(regexp_extract_all(t, '[%$&*#!|]{{2,}}|[ \n][|][ \n]')) > 0.25 * len(regexp_extract_all(t, '[^ \t\n\x0B\f\r]+')) THEN 1 ELSE 0 END AS bad FROM shown),
counted AS (
  SELECT host, regexp_replace(host, ':[0-9]*$', '') AS bare, count(bad) AS n, coalesce(sum(bad), 0) AS k FROM labelled GROUP BY host),
parts AS (SELECT *, string_split(bare, '.') AS p, regexp_matches(bare, '^[0-9.]+$') AS ip FROM counted),
named AS (SELECT *, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three FROM parts),
hosts0 AS (
  SELECT host, n, k, CASE WHEN ip THEN bare WHEN two IN ({_TWO}) THEN three ELSE two END AS domain,
    CASE WHEN ip THEN '' WHEN two IN ({_TWO}) THEN two ELSE p[-1] END AS suffix FROM named),
domains0 AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts0 GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k,
  (SELECT (coalesce(sum(k), 0) + 0.5) / (coalesce(sum(n), 0) + 1) FROM domains0) AS parent FROM domains0 GROUP BY suffix),
ms AS ({_STRENGTH.format("suffixes")}),
domains AS (SELECT d.*, (m * s.parent + s.k) / (m + s.n) AS parent FROM domains0 d JOIN suffixes s USING (suffix), ms),
md AS ({_STRENGTH.format("domains")}),
hosts AS (SELECT h.*, (m * d.parent + d.k) / (m + d.n) AS parent FROM hosts0 h JOIN domains d USING (domain, suffix), md),
mh AS ({_STRENGTH.format("hosts")}),
posterior AS (SELECT host, (m * parent + k) / (m + n) AS mean, m + n AS size FROM hosts, mh),
verdicts AS (SELECT host, CASE WHEN greatest(mean - 1.645 * sqrt(mean * (1 - mean) / (size + 1)), 0) > 0.5 THEN 'block' ELSE 'allow' END AS host_verdict FROM posterior),
rules(rule, rhost, rpath, rverdict) AS (VALUES {", ".join(f"('{r.text}', '{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
fitting AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(rverdict, length(rule)) AS rverdict
  FROM (SELECT DISTINCT host, path FROM cut) c JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(rverdict, host_verdict) AS verdict
FROM cut LEFT JOIN fitting USING (host, path) LEFT JOIN verdicts USING (host)
"""

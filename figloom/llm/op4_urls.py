"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (bad or not) are counted per host.  A beta-binomial prior
is passed down from all pages to the suffix, the registered domain and the host: each level's
prior mean is its parent's posterior mean, its weight comes from the spread
between the level's units (method of moments).  So a host without labelled pages
has its domain's reputation, and a domain without any its suffix's.  A host is blocked where
the lower posterior bound of its share of bad pages exceeds a limit: the share
of bad pages among all labelled ones, unless another is given.  So only hosts that are
credibly worse than the whole are blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialise


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)
#: Standard deviations of the posterior bound below the mean.
Z = 1.645
#: Suffixes of two labels under which names are registered (a choice; give your own list).
SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx",
    "com.tr", "com.tw", "edu.au", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.br", "org.uk",
)
#: Bounds of a prior's weight in pages.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 10_000.0
#: So many hosts are broadcast; beyond, the join is by shuffle (adaptive execution splits a hot host).
BROADCAST_HOSTS = 50_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty without ``://`` or for null."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.coalesce(F.get(F.split(url, "://", 2), F.lit(1)), F.lit(""))
    return F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest rule that fits (ties: the earlier), as a struct of its text and verdict, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _level(units: DataFrame, prior: str) -> DataFrame:
    """Units (k bad of n, the parent's mean in ``prior``) with this level's posterior as ``a`` and ``b``."""
    p = F.sum("k") / F.sum("n")
    total = units.filter("n > 0").agg(
        p.alias("p"),
        F.sum("n").cast("double").alias("s1"),
        (F.sum(F.col("n") * F.col("n"))).cast("double").alias("s2"),
        F.count(F.lit(1)).alias("j"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"),
    )
    spread = F.col("q") - F.col("p") * F.col("p") * F.col("s1")
    inner = F.col("p") * (1 - F.col("p"))
    room = F.col("s1") - F.col("s2") / F.col("s1")
    between = (spread - inner * (F.col("j") - 1)) / F.when(room > 0, room)
    weight = F.when(between > 0, F.least(F.lit(MOST_WEIGHT), F.greatest(F.lit(LEAST_WEIGHT), inner / between - 1)))
    total = total.select(F.coalesce(weight, F.lit(MOST_WEIGHT)).alias("_w"))  # one row
    out = units.crossJoin(F.broadcast(total))
    mean = F.coalesce(F.col(prior), F.lit(0.0))
    return out.withColumn("a", F.col("_w") * mean + F.col("k")).withColumn(
        "b", F.col("_w") * (1 - mean) + F.col("n") - F.col("k")
    ).drop("_w")


def registered(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without its port.  An address of digits is its own domain, with suffix ``ip``."""
    name = F.regexp_replace(host, ":[0-9]*$", "")
    ip = name.rlike(r"^[0-9.]+$")
    two = F.substring_index(name, ".", -2).isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(ip, name).when(two, F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    suffix = F.when(ip, F.lit("ip")).when(two, F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    return domain, suffix


def host_reputation(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """From (host, bad 0/1 or null) rows: host, domain, suffix, k, n and the posterior's ``a``, ``b``; ``base`` is the share of all.

    A null outcome counts as unlabelled (such a host has n = 0).  Without any outcome the posteriors
    are of share zero and ``base`` is null.  An empty table gives no rows.
    """
    hosts = outcomes.groupBy("host").agg(
        F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).cast("long").alias("k"), F.count("bad").alias("n")
    )
    domain, suffix = registered(F.col("host"), suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    hosts = materialise(hosts, "hosts")
    add = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    suffixes = hosts.groupBy("suffix").agg(*add)
    domains = hosts.groupBy("domain", "suffix").agg(*add)
    everything = suffixes.agg((F.sum("k") / F.nullif(F.sum("n"), F.lit(0))).alias("_m"))  # one row
    suffixes = _level(suffixes.crossJoin(F.broadcast(everything)), "_m")
    suffixes = suffixes.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("_m"))
    domains = _level(domains.join(suffixes, "suffix"), "_m")
    domains = domains.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("_m"))
    out = _level(hosts.join(domains, "domain"), "_m").drop("_m")
    return out.crossJoin(F.broadcast(everything.select(F.col("_m").alias("base"))))


def judge_urls(
    pages: DataFrame,
    outcomes: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    z: float = Z,
    max_bad: float | None = None,
    broadcast_hosts: int = BROADCAST_HOSTS,
    suffixes: tuple[str, ...] = SUFFIXES,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, lower_bound.

    ``outcomes`` has page_id and bad (0/1 or null); several rows of one page
    count each.  ``max_bad`` is the share of bad pages that is tolerated (None: the share among all
    labelled pages; without labels every page is allowed that no rule blocks).  Null urls give an empty host and
    path; page ids may be null or repeat; other columns are ignored; an empty table gives no rows.
    """
    url = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    seen = url.select("page_id", "host").join(outcomes.select("page_id", "bad"), "page_id", "left")
    hosts = materialise(host_reputation(seen, suffixes), "reputation")
    mean = F.col("a") / (F.col("a") + F.col("b"))
    sd = F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    limit = F.col("base") if max_bad is None else F.lit(max_bad)
    hosts = hosts.select("host", (mean - z * sd).alias("lower_bound"), limit.alias("limit"))
    small = hosts.count() <= broadcast_hosts
    out = url.join(F.broadcast(hosts) if small else hosts, "host", "left")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower_bound") > F.col("limit"), "block").otherwise("allow")
    out = out.withColumn("_r", rule)
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("_r.rule").alias("rule"),
        F.coalesce(F.col("_r.verdict"), own).alias("verdict"),
        "lower_bound",
    )


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of its number: bad if of low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return judge_urls(pages, outcomes).drop("lower_bound")


QUERIES = {"op4_url_filter": op4_url_filter}


def _oracle() -> str:
    def level(name: str, source: str) -> str:
        return f"""{name}_t AS (
  SELECT p, s1, CASE WHEN between_ > 0 THEN least({MOST_WEIGHT}, greatest({LEAST_WEIGHT}, p * (1 - p) / between_ - 1)) ELSE {MOST_WEIGHT} END AS w
  FROM (SELECT p, s1, (q - p * p * s1 - p * (1 - p) * (j - 1)) / nullif(greatest(s1 - s2 / s1, 0), 0) AS between_
        FROM (SELECT sum(k) / sum(n) AS p, CAST(sum(n) AS DOUBLE) AS s1, CAST(sum(n * n) AS DOUBLE) AS s2, count(*) AS j,
                     sum(k * k / n) AS q FROM {source} WHERE n > 0))
), {name} AS (SELECT s.*, w * m + k AS a, w * (1 - m) + n - k AS b FROM {source} s, {name}_t)"""

    fits = "\n".join(
        f"    WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text} {r.verdict}'"
        for r in sorted(RULES, key=lambda r: -len(r.text))
    )
    return f"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), n AS (
  SELECT host, CAST(coalesce(sum(CAST(quality = 0 OR toxic = 1 AS INTEGER)), 0) AS BIGINT) AS k,
         count(quality = 0 OR toxic = 1) AS n, regexp_replace(host, ':[0-9]*$', '') AS name
  FROM u LEFT JOIN labels ON page_id = doc_id GROUP BY host
), l AS (
  SELECT *, string_split(name, '.') AS part, regexp_matches(name, '^[0-9.]+$') AS ip,
         array_to_string(string_split(name, '.')[-2:], '.') IN ({", ".join(f"'{x}'" for x in SUFFIXES)}) AS two FROM n
), h AS (
  SELECT host, k, n, CASE WHEN ip THEN name WHEN two THEN array_to_string(part[-3:], '.') ELSE array_to_string(part[-2:], '.') END AS domain,
         CASE WHEN ip THEN 'ip' WHEN two THEN array_to_string(part[-2:], '.') ELSE part[-1] END AS suffix FROM l
), s0 AS (
  SELECT suffix, CAST(sum(k) AS BIGINT) AS k, CAST(sum(n) AS BIGINT) AS n, (SELECT sum(k) / sum(n) FROM h) AS m FROM h GROUP BY suffix
), {level("s1", "s0")}, d0 AS (
  SELECT domain, h.suffix, CAST(sum(h.k) AS BIGINT) AS k, CAST(sum(h.n) AS BIGINT) AS n, any_value(a / (a + b)) AS m
  FROM h JOIN s1 ON h.suffix = s1.suffix GROUP BY domain, h.suffix
), {level("d1", "d0")}, h0 AS (
  SELECT h.*, d1.a / (d1.a + d1.b) AS m FROM h JOIN d1 ON h.domain = d1.domain
), {level("h1", "h0")}, lb AS (
  SELECT host, a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) AS bound FROM h1
), r AS (
  SELECT *, CASE
{fits}
    END AS hit FROM (SELECT u.*, bound FROM u LEFT JOIN lb ON u.host = lb.host)
)
SELECT page_id, host, path, string_split(hit, ' ')[1] AS rule,
       coalesce(string_split(hit, ' ')[2], CASE WHEN bound > (SELECT sum(k) / sum(n) FROM h) THEN 'block' ELSE 'allow' END) AS verdict
FROM r
"""


ORACLE_SQL = {"op4_url_filter": _oracle()}

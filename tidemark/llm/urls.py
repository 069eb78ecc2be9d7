"""URL filter: decisions of rules spread over redirect and canonical-link aliases."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import components
from .jaccard import small
from .store import Scratch

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))

#: Tags that name another address of a page: canonical links, and refreshes without delay.
CANONICAL = r"(?i)<link\s[^>]*rel\s*=\s*[\x22']?canonical[^>]*>"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\x22']?refresh[^>]*>"
HREF = r"(?i)href\s*=\s*[\x22']?([^\x22'\s>]+)"
TARGET = r"(?i)url\s*=\s*[\x22']?([^\x22'\s>]+)"


def lower(c: Column) -> Column:
    """A-Z alone in lower case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def resolve(link: Column, host: Column, path: Column) -> Column:
    """The address that a link on a page means."""
    here = F.concat(F.lit("http://"), host)
    return (
        F.when(link.contains("://"), link)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(here, link))
        .otherwise(F.concat(here, F.regexp_replace(path, r"[^/]*$", ""), link))
    )


def aliases(pages: DataFrame, html: str = "html") -> DataFrame:
    """(host, path, host2, path2) of each canonical link and refresh of pages(host, path, html)."""
    text = F.col(html)
    links = F.array(
        F.when(text.rlike(CANONICAL), F.regexp_extract(F.regexp_extract(text, CANONICAL, 0), HREF, 1)),
        F.when(text.rlike(REFRESH), F.regexp_extract(F.regexp_extract(text, REFRESH, 0), TARGET, 1)),
    )
    found = pages.where("host <> ''").select("host", "path", F.explode(links).alias("link")).where("link <> ''")
    to = resolve(F.col("link"), F.col("host"), F.col("path"))
    return found.select("host", "path", host(to).alias("host2"), path(to).alias("path2")).where("host2 <> ''")


def ruled(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """addresses(key, host, path) with rule and verdict of the longest rule(rule_host, rule_path,
    verdict) that fits, null if none does. Each address meets the rules of its host and of the
    hosts above it, in an equi-join; rules are broadcast only where they are few."""
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    met = addresses.select("key", "path", F.explode(above).alias("h")).join(small(rules), (F.col("h") == F.col("rule_host")) & F.col("path").startswith(F.col("rule_path")))
    name = F.concat("rule_host", "rule_path")
    # longest; of two as long, the one that allows
    best = met.groupBy("key").agg(F.max(F.struct(F.length(name).alias("n"), (F.col("verdict") == "allow").alias("a"), name.alias("rule"), F.col("verdict").alias("verdict"))).alias("best"))
    best = best.select(F.col("key").alias("k"), "best.rule", "best.verdict")
    return addresses.join(best, F.col("key") == F.col("k"), "left").drop("k")


def judge(pages: DataFrame, rules: DataFrame, *, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block), one row per page.

    Pages of one host and path are one address, whatever scheme, query and fragment. An address
    that a rule fits has the verdict of the longest. Canonical links, refreshes and rows of
    `redirects` (src, dst) make addresses aliases; the others take the verdict of what they reach:
    allow if a rule allows any alias, else block if a rule blocks one, else allow. Aliases that are
    no page count too. Only addresses and aliases are shuffled, and components are found step by
    step, so no group of aliases is ever in one task.

    Links are taken as they stand: character references aren't decoded, `..` isn't resolved, and the
    first canonical tag of a page counts wherever it is, in a comment too.

    Null urls and urls without :// have an empty host and path, no rule and no alias, and are
    allowed. Null html has no links. Repeated rows are judged one by one. Empty: no rows.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark)
    u = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), host(u).alias("host"), path(u).alias("path"), F.col(f"`{html}`").alias("html"))
    pairs = aliases(rows)
    if redirects is not None:
        pairs = pairs.unionByName(redirects.select(host(F.col("src")).alias("host"), path(F.col("src")).alias("path"), host(F.col("dst")).alias("host2"), path(F.col("dst")).alias("path2")).where("host <> '' and host2 <> ''"))
    pairs = scratch.save(pairs.distinct())
    rows = rows.drop("html")
    key = lambda h, p: F.xxhash64(h, p)
    own = rows.select("host", "path").where("host <> ''")
    own = own.unionByName(pairs.select("host", "path")).unionByName(pairs.select(F.col("host2").alias("host"), F.col("path2").alias("path"))).distinct()
    own = scratch.save(ruled(own.withColumn("key", key("host", "path")), rules))
    comp = components(pairs.select(key("host", "path").alias("u"), key("host2", "path2").alias("v")), scratch)
    own = own.join(comp, F.col("key") == F.col("node"), "left").withColumn("component", F.coalesce("component", "key"))
    said = own.where("verdict is not null").groupBy("component").agg(F.min("verdict").alias("said")).withColumnRenamed("component", "c")  # allow before block
    own = own.join(said, F.col("component") == F.col("c"), "left").select("key", "rule", F.coalesce("verdict", "said").alias("verdict"))
    out = rows.withColumn("k", F.when(F.col("host") != "", key("host", "path"))).join(own, F.col("k") == F.col("key"), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "rule_host string, rule_path string, verdict string")
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


OP9_SQL = r"""
WITH RECURSIVE p AS MATERIALIZED (
  SELECT page_id, html,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
l AS (
  SELECT host, path, regexp_extract(regexp_extract(html, '(?i)<link\s[^>]*rel\s*=\s*[\x22'']?canonical[^>]*>'), '(?i)href\s*=\s*[\x22'']?([^\x22''\s>]+)', 1) AS link FROM p WHERE host <> ''
  UNION ALL
  SELECT host, path, regexp_extract(regexp_extract(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*[\x22'']?refresh[^>]*>'), '(?i)url\s*=\s*[\x22'']?([^\x22''\s>]+)', 1) FROM p WHERE host <> ''),
t AS (
  SELECT host, path, CASE WHEN contains(link, '://') THEN link WHEN starts_with(link, '//') THEN 'http:' || link
         WHEN starts_with(link, '/') THEN 'http://' || host || link ELSE 'http://' || host || regexp_replace(path, '[^/]*$', '') || link END AS dst
  FROM l WHERE link <> ''),
e AS (
  SELECT DISTINCT host, path, translate(regexp_extract(dst, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host2,
         regexp_extract(dst, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path2 FROM t),
both_ways AS MATERIALIZED (SELECT * FROM e WHERE host2 <> '' UNION SELECT host2, path2, host, path FROM e WHERE host2 <> ''),
reach AS (
  SELECT host, path, host2, path2 FROM both_ways
  UNION SELECT r.host, r.path, b.host2, b.path2 FROM reach r JOIN both_ways b ON r.host2 = b.host AND r.path2 = b.path),
rules(rule_host, rule_path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS MATERIALIZED (SELECT host, path FROM p WHERE host <> '' UNION SELECT host, path FROM both_ways),
m AS MATERIALIZED (
  SELECT host, path, rule_host || rule_path AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, verdict) AS n
  FROM a JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
s AS (SELECT r.host, r.path, min(m.verdict) AS said FROM reach r JOIN m ON m.n = 1 AND r.host2 = m.host AND r.path2 = m.path GROUP BY r.host, r.path)
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.verdict, s.said, 'allow') AS verdict
FROM p LEFT JOIN m ON m.n = 1 AND p.host = m.host AND p.path = m.path LEFT JOIN s ON p.host = s.host AND p.path = s.path
"""

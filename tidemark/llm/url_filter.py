"""URL rules: host-suffix and path-prefix expressions, joined on short digests.

Each URL becomes the suffixes of its host that a rule could have; those meet the rules' hosts in an
equi-join on the first 32 bits of a SHA-256 digest. For each host that the whole digest confirms, the
URL becomes the expressions ``host + prefix of its path``, with the path lengths of that host's rules
only; they meet the rules in the same way. The longest confirmed rule gives the verdict. Everything
is DataFrame expressions.

A URL's expressions are bounded by the rules of its own hosts and not by its length or by other
hosts' rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, narrowed

#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast (about 200 bytes each); more are shuffled.
BROADCAST_RULES = 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """The host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """The path: what follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules (verdict, host + path, like ``("block", "example.org/es/")``) as a DataFrame, without Python rows."""
    text = lambda x: F.lit(x).cast("string")
    rows = F.array(*[F.struct(text(v).alias("verdict"), text(r).alias("rule")) for v, r in rules])
    return spark.range(1).select(F.inline(rows))


def short(digest: str) -> Column:
    """The part of a digest that joins compare."""
    return F.substring(digest, 1, PREFIX_DIGITS).alias("short")


def apply_rules(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: columns verdict (allow or block) and rule (host, then a path from its first ``/`` on).
    A rule fits its host and all subdomains where the URL's path starts with the rule's path. The
    longest fitting rule wins; of the same rule with two verdicts, block. No rule: rule is null and
    the verdict is ``default``. Null URLs and such without ``://`` have an empty host and path, and
    no rule; URLs of any length are taken whole. Repeated rows stay repeated; an empty table of pages
    or rules is fine; rules without a verdict, without text or without a path fit nothing. Of the
    other columns of pages, those that are named like a result are replaced.
    """
    rules = narrowed(rules, "verdict", "rule").where(F.col("verdict").isNotNull() & F.col("rule").contains("/"))
    rules = rules.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block is after allow
    rules = rules.select("rule", "verdict", F.substring_index("rule", "/", 1).alias("rule_host"), F.sha2("rule", 256).alias("digest"))
    hosts = rules.groupBy("rule_host").agg(F.sort_array(F.collect_set(F.length("rule") - F.length("rule_host"))).alias("chars"))  # a host's path lengths
    hosts = hosts.withColumn("digest", F.sha2("rule_host", 256))
    # A number, and a set of small ones: as large as the longest host.
    known = rules.agg(F.count("*").alias("n"), F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("labels")).first()
    labels = sorted(known["labels"]) or [1]
    small = F.broadcast if known["n"] <= BROADCAST_RULES else lambda df: df
    hosts = small(hosts.select(short("digest"), "digest", "chars"))
    rules = small(rules.select(short("digest"), "digest", "rule", "verdict"))

    u, h, p, best_name = free_names(pages, "_url", "_host", "_path", "_best")
    has_host = F.coalesce(F.col(url).contains("://"), F.lit(False))
    urls = pages.where(has_host).select(F.col(url).alias(u)).distinct().select(u, url_host(F.col(u)).alias(h), url_path(F.col(u)).alias(p))
    suffixes = urls.select(u, p, F.explode(F.array_distinct(F.array(*[F.substring_index(h, ".", -n) for n in labels]))).alias("suffix"))
    suffixes = suffixes.withColumn("full", F.sha2("suffix", 256)).withColumn("short", short("full"))
    fitting = suffixes.join(hosts, "short").where(F.col("full") == F.col("digest"))
    prefixes = F.transform(F.filter("chars", lambda n: n <= F.length(p)), lambda n: F.concat(F.col("suffix"), F.substring(F.col(p), F.lit(1), n)))
    candidates = fitting.select(u, F.explode(prefixes).alias("expression")).withColumn("full", F.sha2("expression", 256))
    hits = candidates.select(u, "full", short("full")).join(rules, "short").where(F.col("full") == F.col("digest"))
    best = hits.groupBy(u).agg(F.max(F.struct(F.length("rule").alias("n"), "rule", "verdict")).alias(best_name))
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]

    def judged(some: DataFrame, rule: Column, verdict: Column) -> DataFrame:
        own = [url_host(F.col(f"`{url}`")).alias("host"), url_path(F.col(f"`{url}`")).alias("path")]
        return some.select(*[F.col(f"`{c}`") for c in kept], *own, rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))

    nothing = F.lit(None).cast("string")
    ruled = pages.where(has_host).join(best, F.col(url) == F.col(u), "left")
    return judged(ruled, F.col(f"{best_name}.rule"), F.col(f"{best_name}.verdict")).unionByName(judged(pages.where(~has_host), nothing, nothing))


#: The rules of the registered query. Fixed values.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL; without a rule a page is allowed."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return apply_rules(pages, rules_frame(spark, RULES)).drop("url")


SQL = """
WITH r(verdict, rule_host, rule_path) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, row_number() OVER () AS k,
  CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
m AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN m USING (k)
"""

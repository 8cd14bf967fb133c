"""URL filters: host-suffix and path-prefix expressions joined with a rule table by short hash prefixes.

Each distinct URL is expanded into the expressions (host suffix + path prefix) that a rule could have; a distinct
expression's SHA-256 is cut to a short prefix for an equality join, the full digest confirms, and the longest
rule wins. Rules may be many millions: they are joined, never collected. Only the distinct lengths of rule
paths reach the driver, and a URL's length bounds those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.llm.common import read

#: The production rules: (host, path, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules has host, path and verdict. A rule fits its host and the host's subdomains when the path starts with
    the rule's path; of several the longest (host + path) wins, then the longer host, then "block". Where a URL
    is null or has no "://", host and path are empty and no rule fits. Repeated rows and repeated rules change
    nothing; further columns of pages are kept, and those named host, path, rule or verdict are replaced.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    key = rules.select(
        F.col("host").alias("_rule_host"),
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_rule_verdict"),
    ).where("_rule IS NOT NULL")
    key = key.withColumn("_full", F.sha2("_rule", 256)).withColumn("_short", F.substring("_full", 1, PREFIX_HEX))
    lengths = [r[0] for r in rules.where("path IS NOT NULL").select(F.length("path")).distinct().collect()]
    asked = pages.select(F.col(url).alias("_url")).distinct().where("_url IS NOT NULL")
    asked = asked.select("_url", host_of(F.col("_url")).alias("_host"), path_of(F.col("_url")).alias("_path"))
    parts = F.split("_host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    fitting = F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]).cast("array<int>"), lambda n: n <= F.length("_path"))
    asked = asked.select("_url", "_path", F.explode(suffixes).alias("_suffix"))
    asked = asked.select("_url", "_suffix", F.explode(F.transform(fitting, lambda n: F.substring(F.col("_path"), F.lit(1), n))).alias("_start"))
    asked = asked.select("_url", F.length("_suffix").alias("_host_length"), F.unhex(F.sha2(F.concat("_suffix", "_start"), 256)).alias("_digest"))
    # an expression that very many URLs have ("com/") meets the rules once; the rules that fit any then go back to the URLs
    single = asked.select("_digest", "_host_length").distinct().withColumn("_hex", F.lower(F.hex("_digest")))
    single = single.withColumn("_short", F.substring("_hex", 1, PREFIX_HEX))
    fits = single.join(key, "_short").where((F.col("_hex") == F.col("_full")) & (F.col("_host_length") == F.length("_rule_host")))
    fits = fits.select("_digest", "_host_length", "_rule", "_rule_verdict").distinct()
    hits = asked.join(fits, ["_digest", "_host_length"])
    order = F.struct(F.length("_rule"), "_host_length", F.col("_rule_verdict") == "block", "_rule")
    best = hits.groupBy("_url").agg(F.max_by(F.struct("_rule", "_rule_verdict"), order).alias("_best"))
    joined = pages.join(best, pages[url] == best["_url"], "left")
    return joined.select(
        *[pages[c] for c in pages.columns],
        host_of(pages[url]).alias("host"),
        path_of(pages[url]).alias("path"),
        F.col("_best._rule").alias("rule"),
        F.coalesce(F.col("_best._rule_verdict"), F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


SQL = r"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), judged AS (
  SELECT page_id, host, path,
    CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

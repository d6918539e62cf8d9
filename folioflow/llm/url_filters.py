"""URL filters by expression expansion and hash-prefix lookup (DataFrame functions only).

A rule is (host, path, action). Each distinct url is expanded into its host suffixes times those of its path prefixes
whose length some rule has; the expressions meet the rules in an equi-join on a short hash prefix, the full SHA-256
digests confirm, and the longest rule wins (then the longer host, then the smaller text).

Defined results: a null url or one without ``://`` has empty host and path and gets the default verdict; repeated rows
are each judged and stay; very long urls are expanded no further than rule lengths allow, and whole in their host
suffixes; an empty table gives an empty result; of other columns none is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the contract: host, path, action.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rules are broadcast up to so many, about 200 bytes each; more of them are joined by shuffling.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _keyed(df: DataFrame, host: Column, path: Column) -> DataFrame:
    digest = F.sha2(F.concat(host, F.lit("\n"), path), 256)
    return df.withColumn("_digest", digest).withColumn("_short", F.substring("_digest", 1, PREFIX_HEX))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct urls of ``pages`` that some rule fits, with the winning rule and its action."""
    r = rules.select(F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("action").alias("r_action")).where("r_host is not null and r_path is not null and r_action is not null").distinct()
    r = _keyed(r, F.col("r_host"), F.col("r_path"))
    lengths, n_rules = r.agg(F.collect_set(F.length("r_path")).alias("x"), F.count("*").alias("n")).first()  # as many as rule paths have different lengths
    urls = pages.select("url").where(F.col("url").contains("://")).distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size("_labels")), lambda i: F.array_join(F.slice(F.col("_labels"), i, F.size("_labels")), "."))
    cuts = F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>")
    prefixes = F.transform(F.filter(cuts, lambda k: k <= F.length("path")), lambda k: F.substring(F.col("path"), F.lit(1), k))
    x = urls.withColumn("_labels", labels).withColumn("_prefixes", prefixes).where(F.size("_prefixes") > 0)
    x = x.select("url", "_prefixes", F.explode(suffixes).alias("_host")).select("url", "_host", F.explode("_prefixes").alias("_path"))
    x = _keyed(x, F.col("_host"), F.col("_path")).select("url", F.col("_short"), F.col("_digest").alias("_full"))
    r = r.select("_short", "_digest", "r_host", "r_path", "r_action")
    hits = x.join(F.broadcast(r) if n_rules <= BROADCAST_RULES else r, "_short").where(F.col("_full") == F.col("_digest"))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"), (F.col("r_action") == "block").alias("b"))
    best = F.max(F.struct(rank.alias("rank"), F.concat("r_host", "r_path").alias("rule"), F.col("r_action").alias("action")))
    return hits.groupBy("url").agg(best.alias("b")).select("url", F.col("b.rule").alias("rule"), F.col("b.action").alias("action"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: page_id, url, host, path, rule (null if none fits) and verdict."""
    j = judged(pages, rules).withColumnRenamed("url", "_url")
    # urls that no rule can fit, null among them, meet nothing: they are dealt by page, as a third of all rows may share one
    key = F.when(F.col("url").contains("://"), F.col("url")).otherwise(F.xxhash64("page_id").cast("string"))
    out = pages.select("page_id", "url", key.alias("_key")).join(j, F.col("_key") == F.col("_url"), "left")
    return out.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def contract_rules(spark) -> DataFrame:
    values = ", ".join(f"('{host}', '{path}', '{action}')" for host, path, action in RULES)
    return spark.sql(f"SELECT * FROM VALUES {values} AS rules(host, path, action)")


SQL = r"""
WITH r(rh, rp, act) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
             CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path, row_number() OVER () AS k FROM pages),
h AS (SELECT k, arg_max(rh || rp, length(rh) + length(rp)) AS rule, arg_max(act, length(rh) + length(rp)) AS act FROM p JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY k)
SELECT page_id, url, host, path, rule, coalesce(act, 'allow') AS verdict FROM p LEFT JOIN h ON p.k = h.k
"""

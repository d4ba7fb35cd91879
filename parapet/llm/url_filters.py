"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

Every url becomes the expressions (host suffix, path prefix) that a rule could be written as.
Expressions and rules meet in an equi-join on the first four bytes of a SHA-256 digest; the full
digest confirms a hit. Of the rules that fit a url the longest text wins, then the longer host,
then a block before an allow. Urls are reduced to distinct (host, path) before they are expanded,
and no expression is made that is longer or has more host labels than the longest rule has, so
even a very long url gives few of them.

Defined results: a null url or one without ``://`` has an empty host and path and fits no rule;
a host is taken literally (a port or user part belongs to it); an empty path fits only rules
without a path; without rules every url gets the default verdict; repeated urls and repeated
page ids each keep their row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = (
    ("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"),
)
PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules as (rule, host, path, verdict) from texts like ``net/es/``; a rule needs a host."""
    rows = []
    for text, verdict in rules:
        host, slash, path = text.partition("/")
        if not host or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {text!r}, {verdict!r}")
        rows.append((text, host.translate(str.maketrans(_UPPER, _LOWER)), slash + path, verdict))
    return spark.createDataFrame(rows, "rule string, host string, path string, verdict string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path).cast("binary"), 256)


def _reach(rules: DataFrame) -> tuple[int, int, list[int]]:
    """What the rules can ask for: most labels and characters of a host, and their path lengths."""
    row = rules.agg(
        F.max(F.size(F.split("host", r"\."))).alias("labels"), F.max(F.length("host")).alias("chars"),
        F.sort_array(F.collect_set(F.length("path"))).alias("paths"),
    ).first()
    return row.labels or 0, row.chars or 0, row.paths


def expressions(places: DataFrame, labels: int, chars: int, lengths: list[int]) -> DataFrame:
    """(host, path) with one row per expression: ``suffix``, ``prefix``, ``digest`` and its ``short`` form."""
    tail = F.substring_index("host", ".", -labels)
    parts = F.split(tail, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    suffixes = F.filter(suffixes, lambda s: F.length(s) <= chars)
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    rows = places.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    digest = _digest(F.col("suffix"), F.col("prefix"))
    return rows.withColumn("digest", digest).withColumn("short", F.substring("digest", 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow") -> DataFrame:
    """One row per page: ``key``, host, path, the winning rule (else null) and the verdict."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    labels, chars, lengths = _reach(rules)
    if not lengths:
        return rows.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    places = rows.select("host", "path").distinct()
    wanted = rules.select(
        _digest(F.col("host"), F.col("path")).alias("rule_digest"), "rule", "verdict", F.length("host").alias("host_chars")
    ).withColumn("rule_short", F.substring("rule_digest", 1, PREFIX_HEX))
    hits = expressions(places, labels, chars, lengths).join(wanted, F.col("short") == F.col("rule_short"))
    hits = hits.where(F.col("digest") == F.col("rule_digest"))
    rank = F.struct(F.length("rule"), F.col("host_chars"), F.col("verdict") == "block", F.col("rule"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("best"))
    return rows.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict")
    )


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rule, rule_host, rule_path, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
         ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split) s JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path
)
SELECT page_id, s.host, s.path, rule, coalesce(verdict, 'allow') AS verdict FROM split s LEFT JOIN best b ON s.host = b.host AND s.path = b.path
"""

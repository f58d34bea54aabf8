"""URL filter: host-suffix x path-prefix expressions, joined with rules on short hash prefixes, then on whole digests.

DataFrame functions only.  Each url becomes all expressions `host suffix + path prefix` that a rule could equal; these
equi-join with the rules on the first four bytes of SHA-256, the whole digest confirms, and the longest rule that fits
decides.  Suffixes have up to as many labels as any rule's host, prefixes the lengths of rules' paths: no other expression can
equal a rule, so a url of any length has few.  A rule fits whenever the path starts with the rule's.  One shuffle: the best rule is found per task before rows move, one row a url.

Defined cases: null, or no `://`: host and path are empty, no rule fits, the default verdict holds.  Of rules with the same
length that fit, the greater text wins, and block wins over allow for the same text.  Repeated rows stay repeated.  Extra columns are
dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, host, path) of the contract's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Rules that fit this many rows are sent to all executors; more are joined by a shuffle.
BROADCAST_RULES = 1_000_000


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first `://` up to `/`, `?`, `#` or the end, lower-cased; then up to `?`, `#` or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("_url"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All `host suffix + path prefix` that a rule could equal, each once: suffixes of up to so many labels, prefixes of these lengths."""
    suffixes = F.array_distinct(F.array(*[F.substring_index(host, ".", -k) for k in range(1, labels + 1)]))
    cuts = F.filter(F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(suffixes, lambda s: F.transform(cuts, lambda p: F.concat(s, p))))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules as (rank, rule, action, digest, prefix); a higher rank takes precedence."""
    order = sorted({(h + p, v) for v, h, p in rules}, key=lambda x: (len(x[0]), x[0], x[1] == "block"))
    last = {rule: (rank, verdict) for rank, (rule, verdict) in enumerate(order)}
    df = spark.createDataFrame([(rank, rule, verdict) for rule, (rank, verdict) in last.items()], "rank int, rule string, action string")
    digest = F.sha2("rule", 256)
    return df.select("rank", "rule", "action", digest.alias("digest"), F.substring(digest, 1, 8).alias("prefix"))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits), verdict of every row of df."""
    spark = df.sparkSession
    r = rule_table(spark, rules)
    known = F.broadcast(r) if len(rules) <= BROADCAST_RULES else r
    lengths = sorted({len(p) for _, _, p in rules}) or [0]
    labels = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    base = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = split_url(F.col("_url"))
    base = base.select(F.monotonically_increasing_id().alias("_row"), "_id", host.alias("_host"), path.alias("_path"))
    wide = base.withColumn("_expr", F.explode_outer(expressions(F.col("_host"), F.col("_path"), labels, lengths)))
    digest = F.sha2("_expr", 256)
    wide = wide.select("_row", "_id", "_host", "_path", digest.alias("_digest"), F.substring(digest, 1, 8).alias("_prefix"))
    hit = wide.join(known, (F.col("_prefix") == F.col("prefix")) & (F.col("_digest") == F.col("digest")), "left")
    best = hit.groupBy("_row", "_id", "_host", "_path").agg(F.max("rank").alias("_rank"))
    names = known.select(F.col("rank").alias("_rank"), "rule", "action")
    return best.join(names, "_rank", "left").select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("action", F.lit(default)).alias("verdict"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule,
  CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'allow'
       WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'block'
       WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'allow'
       WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'block' ELSE 'allow' END AS verdict
FROM p
"""

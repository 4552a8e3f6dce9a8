"""URL filters: a sort-merge range join of urls against nested rule intervals, native throughout.

A host turned round, ``www.example.com`` -> ``com.example.www.``, makes a rule's host and all its subdomains one
interval of keys, and so does a path for all that begins with it: from the key up to the key and a byte that no
text holds. Intervals of prefixes nest or are disjoint. A sweep goes through points and interval boundaries in key
order with the stack of active intervals: a running sum of openings and closings is the stack's height, and what a
height holds is the last interval opened there. The innermost one is the longest prefix.

Two sweeps judge a url. The first finds each host's innermost rule host; that and the rule hosts above it are
those that fit. The second takes (rule host, path) as keys and finds the longest rule path for each. Of these the
longest rule wins.

Scale: only distinct hosts and distinct (rule host, path) are swept, so a host with a third of all rows is one row of
the first sweep, and its urls are spread by path in the second. Sweeps run in range partitions; what a partition
inherits from those before it is a row for each height. A rule host may have any number of paths: a url meets the longest
only. Joins back to the urls are equi-joins, which adaptive execution splits when skewed.

Defined cases: null urls and urls without ``://`` have empty host and path; no rule fits an empty
host; a rule whose host is empty is refused. Of equal rules block wins over allow. An empty table gives an empty result.
Extra columns of the input are dropped; result columns are fixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gistra.staging import cut

Rule = tuple[str, str, str]


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return lower_ascii(F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def longest_prefixes(points: DataFrame, prefixes: DataFrame, partitions: int) -> DataFrame:
    """(key, value) of the points (key) that begin with one of the prefixes (key, value): the longest's value, by one pass over
    points and interval boundaries in order. Keys are binary, distinct on each side."""
    kind = prefixes.schema["value"].dataType
    none = F.lit(None).cast(kind)
    marks = prefixes.select("key", "value", F.lit(0).alias("kind"), F.lit(1).alias("opens"))
    ends = prefixes.select(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), none.alias("value"), F.lit(0).alias("kind"), F.lit(-1).alias("opens"))
    rows = points.select("key", none.alias("value"), F.lit(1).alias("kind"), F.lit(0).alias("opens")).unionByName(marks).unionByName(ends)
    ranged = cut(rows.repartitionByRange(partitions, "key", "kind").withColumn("part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each partition, so the single-task window stays small
    base = ranged.groupBy("part").agg(F.sum("opens").alias("left")).select("part", F.coalesce(F.sum("left").over(before), F.lit(0)).alias("base"))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    heights = ranged.withColumn("run", F.sum("opens").over(so_far)).join(F.broadcast(base), "part").withColumn("height", F.col("base") + F.col("run")).filter("opens >= 0")
    same = Window.partitionBy("part", "height").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = heights.withColumn("here", F.last("value", ignorenulls=True).over(same))
    # what each partition leaves at each height, for the partitions after it
    left = swept.groupBy("part", "height").agg(F.max_by("value", F.when(F.col("opens") == 1, F.struct("key", "kind"))).alias("leaves"))
    handed = left.select("part", "height", F.last("leaves", ignorenulls=True).over(Window.partitionBy("height").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("handed"))
    inside = swept.filter("kind = 1 AND height > 0").join(handed, ["part", "height"])
    return inside.select("key", F.coalesce("here", "handed").alias("value"))


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge every url: id, host, path, rule (null if none fits) and verdict (``default`` if none fits).

    ``rules`` are (verdict, host, path) rows; hosts are lower-case.
    """
    spark = pages.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(list(rules), "verdict string, host string, path string")
    table = table.select("verdict", F.when((F.col("host") == "") | F.col("host").isNull(), F.raise_error("a rule needs a host")).otherwise(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    binary = lambda c: c.cast("binary")
    pair = lambda host, path: F.concat(binary(host), F.unhex(F.lit("00")), binary(path))
    keyed = table.withColumn("up", host_key(F.col("host")))
    rules_ = keyed.groupBy("up", "path").agg(F.max(F.struct((F.length("host") + F.length("path")).alias("size"), F.when(F.col("verdict") == "block", 1).otherwise(0).alias("first"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("does"))).alias("value"))
    rule_hosts = keyed.select("up").distinct()
    # the rule hosts above a rule host: as many as it has labels at most
    labels = F.split("up", r"\.")
    above = rule_hosts.select(F.col("up").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("up")).join(rule_hosts, "up")

    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    hosts = urls.select("host").distinct().withColumn("key", binary(host_key(F.col("host")))).filter("host <> ''")
    inner = longest_prefixes(hosts.select("key").distinct(), rule_hosts.select(binary(F.col("up")).alias("key"), F.col("up").alias("value")), partitions)
    ups = cut(hosts.join(inner, "key").select("host", F.col("value").alias("inner")).join(above, "inner").select("host", "up"), "ups")
    asked = urls.select("host", "path").distinct().join(ups, "host").select("host", "path", pair(F.col("up"), F.col("path")).alias("key"))
    found = longest_prefixes(asked.select("key").distinct(), rules_.select(pair(F.col("up"), F.col("path")).alias("key"), "value"), partitions)
    best = cut(asked.join(found, "key").groupBy("host", "path").agg(F.max("value").alias("best")), "best")
    judged = urls.join(best, ["host", "path"], "left")
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.does", F.lit(default)).alias("verdict"))


PRODUCTION_RULES: list[Rule] = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def query(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), PRODUCTION_RULES)


ORACLE_SQL = r"""
WITH r(verdict, host, path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id,
  translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT v.page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM v JOIN r ON (v.host = r.host OR ends_with(v.host, '.' || r.host)) AND starts_with(v.path, r.path) GROUP BY v.page_id)
SELECT v.page_id, v.host, v.path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM v LEFT JOIN m USING (page_id)
"""

"""URL filter by a sort-merge range join, with DataFrame functions only.

A host's canonical key is its labels reversed, each followed by U+0001: ``b.example.net`` becomes ``net.example.b.``. A rule's host
covers its subdomains, so it covers the interval of keys that begin with its own, and intervals are nested or disjoint. The ends of
the rules' intervals and the different hosts are sorted together; at each place of the sweep the stack holds the rules whose interval
is open, and a host takes the stack of its place. Of the stack, the longest rule whose path begins the url's path decides.

The sweep is cut at the domain (first two labels of the key) and, inside it, into ``SALTS`` parts of hosts that each sweep the domain's
ends; rules of top-level labels enter each domain as the stack at its start. Hosts are made distinct first, so a host with a third of
all urls is one row there, and a skewed key of the last join only.

Host and path of a null url or one without ``://`` are empty; no rule fits an empty host. A url without a rule is allowed. Of rules of
equal length the alphabetically first wins; a rule given twice counts once, blocking when both verdicts are given. All rules on a host
and its parent domains travel as one array. Repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factorspark.llm.tables import read

SALTS = 16
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed values: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(_url, instr(_url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _CAPITALS, _SMALL), path


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "\u0001"), F.lit("\u0001"))


def _labels(key: Column, n: int) -> Column:
    """The first n labels of a key."""
    return F.concat(F.substring_index(key, "\u0001", n), F.lit("\u0001"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if not rules:
        return spark.sql("SELECT '' AS verdict, '' AS host, '' AS path WHERE false")
    return spark.sql("SELECT * FROM VALUES " + ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rules) + " AS r(verdict, host, path)")


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, labels, stack) at the start and the end of every rule host's interval; the stack is sorted, longest rule first."""
    clean = (rules.select(F.translate("host", _CAPITALS, _SMALL).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where(F.col("host") != "")
             .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))
    own = clean.groupBy("host").agg(F.collect_list(F.struct((-F.length("host") - F.length("path")).alias("order"), F.concat("host", "path").alias("rule"), "path", "verdict")).alias("own"))
    own = own.select(key_of(F.col("host")).alias("key"), "own")
    n = F.size(F.split("key", "\u0001", -1)) - 1
    parts = own.select("key", n.alias("labels"), F.explode(F.sequence(F.lit(1), n)).alias("i"))
    above = parts.withColumn("up", F.expr("concat(substring_index(key, '\u0001', i), '\u0001')")).join(own.withColumnRenamed("key", "up"), "up")
    stacks = above.groupBy("key", "labels").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("stack"),
                                                 F.array_sort(F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own"))))).alias("below"))
    start = stacks.select("key", "labels", "stack")
    end = stacks.select(F.expr("concat(substring(key, 1, length(key) - 1), '\u0002')").alias("key"), "labels", F.col("below").alias("stack"))
    return start.unionByName(end)


def judge(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", salts: int = SALTS, default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row."""
    urls = df.select(F.col(id_col), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    urls = urls.select(id_col, host.alias("host"), path.alias("path"))
    hosts = urls.where(F.col("host") != "").select("host").distinct()
    hosts = hosts.withColumn("key", key_of(F.col("host"))).withColumn("domain", _labels(F.col("key"), 2)).withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(salts)))
    ends = interval_ends(rules)
    parts = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt")
    inside = ends.where((F.col("labels") > 2) | (F.col("labels") == 2) & F.col("key").endswith("\u0001")).select("key", _labels(F.regexp_replace("key", "\u0002$", "\u0001"), 2).alias("domain"), "stack", parts)
    top = ends.where((F.col("labels") == 1) & F.col("key").endswith("\u0001")).select(F.col("key").alias("top"), "stack")
    opening = hosts.select("domain").distinct().withColumn("top", _labels(F.col("domain"), 1)).join(top, "top").select(F.lit("").alias("key"), "domain", "stack", parts)
    none = F.lit(None).cast("string")
    events = (hosts.select("domain", "salt", "key", F.lit(1).alias("kind"), "host", F.lit(None).cast(ends.schema["stack"].dataType).alias("stack"))
              .unionByName(inside.unionByName(opening).select("domain", "salt", "key", F.lit(0).alias("kind"), none.alias("host"), "stack")))
    sweep = Window.partitionBy("domain", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1").select("host", "stack")
    # every url meets its host's one row; a host with very many urls is a skewed side that adaptive execution splits
    first = F.try_element_at(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(1))
    found = urls.join(placed.where(F.size("stack") > 0), "host", "left").withColumn("_hit", first)
    return found.select(id_col, "host", "path", F.col("_hit.rule").alias("rule"), F.coalesce("_hit.verdict", F.lit(default)).alias("verdict"))


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), rule_table(spark))


OP9_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
m AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
      FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT p.page_id, host, path, m.rule, coalesce(m.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""

"""URL filters by a sort-merge range join.

A host reversed label by label, each label followed by a dot, is a key under which
a host and all its subdomains are one interval: [key, key with its last dot made a
slash), as '/' follows '.'. These intervals nest. Each end of an interval is a
boundary that carries the stack of rules active from there on. URLs and boundaries
are sorted together; a sweep hands each URL the stack of the last boundary before
it, and the longest rule on the stack whose path starts the URL's path wins.

The sort is by range over (key, tie-break), so that a host, or even one URL, with a
third of all rows is spread over many tasks; the stack that holds at the start of a
range is carried over from the ranges before it.

Defined results: a null URL, or one without '://', has empty host and path and no
rule. Repeated URLs are judged alike. Equal rules of opposite action: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, stage, table

#: host, path, action
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def url_host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL, both empty where there is no '://'."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    known = F.coalesce(at > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(F.lit("")), F.when(known, path).otherwise(F.lit(""))


def host_key(host: Column) -> Column:
    """example.com becomes com.example. (with the last dot)."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from key on, these rules are active.

    A node is a host that has rules. Its interval opens with its own rules on top of
    those of the hosts around it, and closes back to those.
    """
    r = rules.select(
        host_key(F.col("host")).alias("node"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("action") == "block").alias("blocks"),
            F.concat("host", "path").alias("rule"),
            "path",
            "action",
        ).alias("r"),
    )
    nodes = r.select("node").distinct()
    labels = F.split(F.expr("substring(node, 1, length(node) - 1)"), r"\.")
    around = nodes.select("node", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("outer"))
    stacks = (
        around.join(r.withColumnRenamed("node", "outer"), "outer")
        .groupBy("node")
        .agg(F.collect_list("r").alias("inside"), F.collect_list(F.when(F.col("outer") != F.col("node"), F.col("r"))).alias("outside"))
    )
    closed = F.concat(F.expr("substring(node, 1, length(node) - 1)"), F.lit("/"))
    return stacks.select(F.col("node").alias("key"), F.col("inside").alias("stack")).unionByName(stacks.select(closed.alias("key"), F.col("outside").alias("stack")))


def judge(urls: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """urls (any columns, among them url) with host, path, rule and verdict.

    Clashing columns of urls named like the new ones are replaced.
    """
    spark = urls.sparkSession
    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = url_host_path(F.col("url"))
    rows = urls.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), host.alias("host"), path.alias("path"))
    marks = boundaries(rules)
    empty = F.lit(None)
    points = rows.select(
        host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.xxhash64("row", F.monotonically_increasing_id()).alias("tie"), "row", "host", "path", empty.cast(marks.schema["stack"].dataType).alias("stack")
    ).unionByName(
        marks.select("key", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("tie"), empty.cast(rows.schema["row"].dataType).alias("row"), empty.cast("string").alias("host"), empty.cast("string").alias("path"), "stack")
    )
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that every later use sees the same ranges.
    ranged = stage(points.repartitionByRange(ranges, "key", "kind", "tie").withColumn("part", F.spark_partition_id()), "url-sweep")

    # One row a range: the last boundary in it, carried to the ranges that follow.
    last = ranged.where("kind = 0").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(last, "part", "left")
    carry = parts.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))

    sweep = Window.partitionBy("part").orderBy("key", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    swept = ranged.withColumn("top", F.last("stack", True).over(sweep)).where("kind = 1").join(carry, "part", "left")
    active = F.filter(F.coalesce("top", "carried"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(active, lambda r: F.struct(r["size"], r["host_size"], r["blocks"], r["rule"], r["action"])))
    return swept.withColumn("best", best).select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
         ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT p.page_id, p.host, p.path, r.rhost || r.rpath AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS rn
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE rn = 1
"""

"""Sharding by rendezvous hashing over weighted shards.

Every (key, shard) pair has a score -weight / ln(u), u a hash of the pair in (0, 1);
a record goes to the shard of its highest score. Scores of the old shards don't
change when a shard is added, so a new shard only takes rows for itself, and the
share of each shard follows its weight.

Slots number the rows of a shard without gaps. They are given in two steps, by
hashed bucket within the shard and by rank within the bucket. Buckets hold about BUCKET
rows, whatever the size of the table, and one with far more (rows of one key) is cut into
parts, so no task holds a whole shard or key; the table of bucket sizes is broadcast
while it has fewer than BROADCAST rows.

Defined results: a null key is a key like any other; rows with equal keys share a
shard and have slots of their own, by `tie` and then in any order; a null text has no bytes;
of very long texts only length and checksum are kept; an empty table has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

SHARDS = 40
#: Rows of a shard's bucket in which rows are ranked, about; and buckets that are broadcast at most.
BUCKET, BROADCAST = 20_000, 200_000


def score(key: Column, shard: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, shard), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -weight / F.log(u)


def best_shard(key: Column, weights: list[float]) -> Column:
    """The shard 0.. of a key; ties go to the lower number, weight 0 takes nothing."""
    shards = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights) if w > 0])
    return (-F.array_max(F.transform(shards, lambda x: F.struct(score(key, x["s"], x["w"]), -x["s"])))["col2"]).cast("int")


def assign(df: DataFrame, key: Column, weights: list[float], grown: list[float] | None = None, tie: list[str] = (), rows_a_bucket: int = BUCKET) -> DataFrame:
    """df with shard, slot and, if grown weights are given, grown_shard; clashing columns are replaced.

    tie: columns that order rows of equal keys. df is written once, so it should have no more columns than are wanted.
    """
    own = [c for c in df.columns if c not in ("shard", "slot", "grown_shard")]
    new = [best_shard(key, weights).alias("shard"), *([best_shard(key, grown).alias("grown_shard")] if grown else [])]
    order = F.struct(key.alias("key"), *[F.col(c) for c in tie])
    rows = stage(df.select(F.struct(*own).alias("row"), *new, order.alias("order"), F.xxhash64(key, F.lit("slot"), *tie).alias("h"), F.monotonically_increasing_id().alias("m")), "sharded")
    buckets = max(1, -(-rows.count() // (rows_a_bucket * max(1, sum(w > 0 for w in weights)))))
    rows = rows.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sizes = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # a bucket with far more rows than others has many equal ones, whose order is nothing to keep
    parts = sizes.select("shard", "bucket", F.when(F.col("n") > 4 * rows_a_bucket, F.ceil(F.col("n") / rows_a_bucket)).otherwise(F.lit(1)).alias("parts"))
    parts = stage(parts, "shard-buckets")
    few = (lambda x: F.broadcast(x)) if parts.count() <= BROADCAST else (lambda x: x)
    rows = rows.join(few(parts), ["shard", "bucket"]).withColumn("part", F.pmod(F.xxhash64("m"), F.col("parts"))).drop("parts")
    sizes = rows.groupBy("shard", "bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = few(sizes.select("shard", "bucket", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket", "part").orderBy("order", "m"))
    out = rows.withColumn("rank", rank).join(starts, ["shard", "bucket", "part"])
    return out.select("row.*", "shard", *(["grown_shard"] if grown else []), (F.col("start") + F.col("rank") - 1).alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 40 shards by key, and where they would be with 41."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law")
    )
    out = assign(docs, F.col("doc_id"), [1.0] * SHARDS, [1.0] * (SHARDS + 1), tie=["text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")

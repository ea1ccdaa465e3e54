"""The engine's relations on the driver's tables, in Spark and as SQL for the oracle.

There are no images in those tables: line items stand for detections of frames (their
orders), documents for rendered frames, 64 numbers of an embedding for a patch of 8 x 8.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes

FRAME_W, FRAME_H = 640, 512
CORNERS = boxes.CORNERS


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """frame, ord (a struct that is unique in the frame), box."""
    t = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag")
    x0, y0 = (F.col("l_partkey") * 37 % 600 - 20).cast("double"), (F.col("l_suppkey") * 53 % 460 - 20).cast("double")
    b = boxes.make(x0, y0, x0 + 4 * F.col("l_quantity"), y0 + 2 * F.col("l_quantity"), F.round(1 - F.col("l_discount"), 4), F.col("l_returnflag"))
    order = F.struct(F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))
    return t.select(F.col("l_orderkey").alias("frame"), order.alias("ord"), b.alias("box"))


DET = """det AS (
  SELECT frame, ln, pk, sk, x0, y0, x0 + 4 * q AS x1, y0 + 2 * q AS y1, score, label FROM (
    SELECT l_orderkey AS frame, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk, CAST(l_partkey * 37 % 600 - 20 AS DOUBLE) AS x0,
           CAST(l_suppkey * 53 % 460 - 20 AS DOUBLE) AS y0, l_quantity AS q, round(1 - l_discount, 4) AS score, l_returnflag AS label FROM lineitem)
)"""
#: Boxes that are strong and large enough, ranked in their frame.
CHOSEN = (
    DET
    + """, chosen AS (
  SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, (x1 - x0) * (y1 - y0) DESC, ln, pk, sk) - 1 AS n
  FROM det WHERE score >= 0.92 AND least(x1 - x0, y1 - y0) >= 8
)"""
)
TOP3 = CHOSEN + ", top3 AS (SELECT * FROM chosen WHERE n < 3)"


def box() -> Column:
    return F.col("box")


def ord_columns(df: DataFrame) -> list[Column]:
    return [F.col("ord.ln").alias("ln"), F.col("ord.pk").alias("pk"), F.col("ord.sk").alias("sk")]


def flat(b: Column, prefix: str = "", digits: int = 6) -> list[Column]:
    """The corners as columns x0, y0, x1, y1; rounding takes the sign of zero away."""
    return [(F.round(boxes.part(b, c), digits) + F.lit(0.0)).alias(prefix + n) for c, n in zip(CORNERS, ("x0", "y0", "x1", "y1"))]


def patches(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, px: 64 values in 0..1, rounded to six digits."""
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return e.select("vec_id", F.transform("embedding", lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5)), 6)).alias("px"))


PX = "px AS (SELECT vec_id, list_transform(embedding, lambda x: round(greatest(0.0, least(1.0, x::DOUBLE + 0.5)), 6)) AS px FROM embeddings)"


def sha(px: Column, digits: int = 6) -> Column:
    """A short account of an array: its sum, smallest and largest value."""
    return F.struct(
        F.round(F.aggregate(px, F.lit(0.0), lambda a, x: a + x), digits).alias("total"), F.round(F.array_min(px), digits).alias("low"), F.round(F.array_max(px), digits).alias("high")
    )


def account(px: Column, prefix: str = "", digits: int = 6) -> list[Column]:
    s = sha(px, digits)
    return [(s[c] + F.lit(0.0)).alias(prefix + c) for c in ("total", "low", "high")]


def account_sql(px: str, prefix: str = "", digits: int = 6) -> str:
    return f"round(list_sum({px}), {digits}) AS {prefix}total, round(list_min({px}), {digits}) AS {prefix}low, round(list_max({px}), {digits}) AS {prefix}high"


def uniform_sql(key: str) -> str:
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296::DOUBLE)"

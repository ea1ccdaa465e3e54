"""Sampling, order and batches, all with an explicit place for every row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws
from .index import in_order


def pool_sample(paths: DataFrame, stride: int = 1, limit: int | None = None, seed: int | None = None, shuffle: bool = False) -> DataFrame:
    """(path, frame_ord): every stride-th path in sorted order, then at most `limit` of them, then an order.

    With a seed the limit is a random sample, kept in sorted order, and without one the
    first paths; shuffle orders at random, by seed or 0. Random is by md5 of seed and path.
    """
    out = paths.select("path").distinct()
    if stride > 1:
        out = in_order(out, ["path"], "__i").where(F.col("__i") % stride == 0).drop("__i")
    if limit is not None:
        key = F.col("path") if seed is None else draws.shuffled(seed, F.col("path"))
        out = out.orderBy(key, "path").limit(limit)
    order = [draws.shuffled(seed or 0, "order", F.col("path")), F.col("path")] if shuffle else [F.col("path")]
    return in_order(out, order, "frame_ord")


def exact_sample(spark: SparkSession, n: int, size: int, seed: int) -> DataFrame:
    """(ordinal): numpy's own draw without replacement, made on the driver for pools of a known, small size."""
    picked = np.sort(np.random.default_rng(seed).choice(n, size=min(size, n), replace=False))
    return spark.createDataFrame([(int(i),) for i in picked], "ordinal bigint")


def epoch_order(examples: DataFrame, seed: int, epoch: int) -> DataFrame:
    """examples with pos, their place in an epoch, by md5 of (seed, epoch, idx)."""
    return in_order(examples, [draws.shuffled(seed, epoch, F.col("idx")), F.col("idx")], "pos")


def exact_epoch_order(spark: SparkSession, n: int, seed: int, epoch: int, most: int = 10_000_000) -> DataFrame:
    """(pos, idx): numpy's permutation, drawn on the driver, and so for up to `most` examples; epoch_order() has no such bound."""
    if n > most:
        raise ValueError(f"{n} examples are too many for the driver (at most {most}); use epoch_order()")
    return spark.createDataFrame(pd.DataFrame({"pos": np.arange(n), "idx": draws.epoch_order(n, seed, epoch)}), "pos bigint, idx bigint")


def epochs_order(examples: DataFrame, seed: int, epochs: int) -> DataFrame:
    """(j, pos, epoch, idx): the orders of epoch_order() one after another, by a single sort; j counts on."""
    n = examples.count()
    each = examples.select("idx", F.explode(F.expr(f"sequence(0L, {epochs - 1}L)")).alias("epoch"))
    rows = in_order(each, ["epoch", draws.shuffled(seed, F.col("epoch"), F.col("idx")), F.col("idx")], "j")
    return rows.select("j", F.pmod("j", F.lit(n)).alias("pos"), "epoch", "idx")


def batches(df: DataFrame, size: int, drop_last: bool = False, pos: str = "pos") -> DataFrame:
    """df with batch and slot; drop_last leaves an incomplete last batch out."""
    out = df.withColumn("batch", F.floor(F.col(pos) / size).cast("bigint")).withColumn("slot", (F.col(pos) % size).cast("bigint"))
    if drop_last:
        out = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("batch"))).where(F.col("__n") == size).drop("__n")
    return out


def virtual(j: Column, n: int) -> tuple[Column, Column]:
    """Visit j of an endless stream over n examples: its index and epoch."""
    return F.pmod(j, F.lit(n)).cast("bigint"), F.floor(j / n).cast("bigint")


def wrapped(i: Column, n: int) -> Column:
    """A Python index: negative from the end, else an error."""
    inside = (i >= -n) & (i < n)
    return F.when(inside, F.pmod(i, F.lit(n))).otherwise(F.raise_error(F.concat(F.lit("index out of range: "), i.cast("string"))).cast("bigint"))


def width_band(rows: DataFrame, low: float, high: float, width: str = "width") -> DataFrame:
    """Rows whose width lies in the band; if there are none, the row nearest to its lower end."""
    inside = rows.where(F.col(width).between(low, high))
    nearest = rows.orderBy(F.abs(F.col(width) - low), *rows.columns).limit(1)
    some = inside.select(F.lit(True).alias("__some")).limit(1)  # a row or none
    return inside.unionByName(nearest.join(F.broadcast(some), F.col("__some"), "left_anti"))

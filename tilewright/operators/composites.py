"""Composites: a donor's patch pasted into a host frame, or examples corrupted within their own frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, draws
from ..session import in_small_batches
from .augment import Augmenter, pair_column, patch_column
from .corruptions import capped

PLACEMENTS = ("detection", "lower")


def placed(how: str | Callable, seed, i: Column, host_box: Column, host_w, host_h, donor_w: Column, donor_h: Column, jitter=(0.9, 1.1), band=(0.55, 0.85)) -> Column:
    """The box in the host where the donor goes.

    detection: at the host's box, with its height jittered and the donor's aspect;
    lower: the donor's size jittered, in the lower part of the frame;
    a function: its box, from columns (seed, i, host box, host width and height, donor width and height).
    """
    if callable(how):
        return how(F.lit(seed), i, host_box, host_w, host_h, donor_w, donor_h)
    s = draws.between(*jitter, seed, i, "scale")
    if how == "detection":
        h = boxes.height(host_box) * s
        w, (cx, cy) = h * donor_w / F.greatest(donor_h, F.lit(1.0)), boxes.center(host_box)
    elif how == "lower":
        w, h = donor_w * s, donor_h * s
        cx, cy = draws.between(0.2, 0.8, seed, i, "x") * host_w, draws.between(*band, seed, i, "y") * host_h
    else:
        raise ValueError(f"placement must be one of {PLACEMENTS}")
    return boxes.from_center(cx, cy, w, h)


def pairing(spark: SparkSession, n_hosts: int, n_donors: int, seed: int, length: int | None = None, into: str = "real") -> DataFrame:
    """(i, host_idx, donor_idx): hosts in turn, donors by a draw; with into='self' a donor is its own host."""
    if into not in ("real", "self"):
        raise ValueError("into must be 'real' or 'self'")
    rows = spark.range(n_hosts if length is None else length).withColumnRenamed("id", "i")
    i = F.col("i")
    if into == "self":
        return rows.select("i", F.pmod(i, F.lit(n_donors)).alias("host_idx"), F.pmod(i, F.lit(n_donors)).alias("donor_idx"))
    return rows.select("i", F.pmod(i, F.lit(n_hosts)).alias("host_idx"), draws.pick(F.lit(n_donors), seed, i, "donor").alias("donor_idx"))


def donor_cut(det: Column, width, height, donor_box: str = "paste") -> Column:
    """The whole pixels of a donor that are pasted: its box, with context or without, inside its frame."""
    return boxes.rounded(boxes.clipped(boxes.expanded(det, 0.15) if donor_box == "paste" else det, width, height))


def composites(
    hosts: DataFrame, donors: DataFrame, augmenter: Augmenter | None = None, seed: int = 0, into: str = "real", placement: str | Callable = "detection", donor_box: str = "paste",
    max_rotation_deg: float | None = 2.0, out_size: int = 256, length: int | None = None, min_donor: int = 4,
) -> DataFrame:
    """One row a composite: i, host_idx, donor_idx, box, window, seed, has_target, and the patches.

    hosts, donors: examples with idx, box and an image struct (uint8). Donors with a side
    under min_donor pixels are left out of the result, as nothing can be pasted.
    """
    if donor_box not in ("paste", "detection"):
        raise ValueError("donor_box must be 'paste' or 'detection'")
    spark = hosts.sparkSession
    in_small_batches(spark)
    augmenter = augmenter or Augmenter()
    augmenter = replace(augmenter, ops=capped(augmenter.steps, max_rotation_deg))
    pairs = pairing(spark, hosts.count(), donors.count(), seed, length, into).withColumn("seed", draws.composite_seed(seed, F.col("i")))
    if into == "self":
        rows = pairs.join(donors.withColumnRenamed("idx", "donor_idx"), "donor_idx")
        win = boxes.window(F.col("box"), out_size)
        rows = rows.withColumn("window", win).withColumn("patch", patch_column(F.col("image"), F.col("window"), out_size)).where("patch.data is not null")
        inside = boxes.in_patch(F.col("box"), F.col("window"), boxes.window_scale(F.col("window"), out_size))
        rows = rows.withColumn("pair", pair_column(augmenter, F.col("patch"), inside, F.col("seed")))
        return rows.select("i", "host_idx", "donor_idx", "box", "window", "seed", F.lit(True).alias("has_target"), F.col("pair.doctored").alias("patch"), F.col("pair.clean").alias("host_patch"), F.col("pair.mask").alias("mask"), "pair.params")

    d = donors.select(F.col("idx").alias("donor_idx"), F.col("image").alias("donor_image"), F.col("box").alias("donor_det"))
    d = d.withColumn("donor_cut", donor_cut(F.col("donor_det"), F.col("donor_image.width"), F.col("donor_image.height"), donor_box)).where(boxes.short_side(F.col("donor_cut")) >= min_donor)
    d = d.withColumn("donor_patch", patch_column(F.col("donor_image"), F.col("donor_cut"), 1 << 30)).drop("donor_image", "donor_det", "donor_cut")
    rows = pairs.join(d, "donor_idx").join(hosts.select(F.col("idx").alias("host_idx"), F.col("box").alias("host_box"), F.col("image").alias("host_image")), "host_idx")
    target = placed(placement, seed, F.col("i"), F.col("host_box"), F.col("host_image.width"), F.col("host_image.height"), F.col("donor_patch.width"), F.col("donor_patch.height"))
    rows = rows.withColumn("box", target).withColumn("window", boxes.window(F.col("box"), out_size))
    rows = rows.withColumn("pair", pair_column(augmenter, F.col("host_image"), F.col("box"), F.col("seed"), source=F.col("donor_patch")))
    frame = lambda data, n: F.struct(F.col("pair.height").alias("height"), F.col("pair.width").alias("width"), n.alias("nChannels"), F.col(f"pair.{data}").alias("data"))
    cut_of = lambda data, dtype, n: patch_column(frame(data, n), F.col("window"), out_size, dtype)["data"]
    channels = F.col("pair.nChannels")
    return rows.select(
        "i", "host_idx", "donor_idx", "box", "window", "seed", F.lit(False).alias("has_target"), cut_of("doctored", "uint8", channels).alias("patch"),
        cut_of("clean", "uint8", channels).alias("host_patch"), cut_of("mask", "float32", F.lit(1)).alias("mask"), "pair.params",
    )


def target_of(host_patch: Column, has_target: Column) -> Column:
    return F.when(has_target, host_patch)

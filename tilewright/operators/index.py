"""The example index: which box of which frame is example number i.

Three relations: examples (idx, path, frame_ord, n, box), scanned (path, frame_ord) with
every frame the detector ran on, and meta, a map of strings.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes
from ..session import shared_dir
from . import detections


def in_order(df: DataFrame, order: list[str | Column], name: str = "idx", chunks: int | None = None) -> DataFrame:
    """df with a gapless number from 0 in the given order.

    Rows are cut into key ranges and ranked within them, and each range starts where the
    ones before it end, so no task sorts everything. The ranges are checkpointed in the
    shared folder, as they are used twice and must be the same both times.
    """
    spark = df.sparkSession
    shared_dir(spark)
    chunks = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(chunks, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))  # one row a range
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    out = ranged.withColumn("__rank", rank).join(F.broadcast(starts), "__part")
    return out.withColumn(name, (F.col("__start") + F.col("__rank") - 1).cast("bigint")).drop("__part", "__rank", "__start")


def quartiles(x: Column) -> Column:
    """struct(min, p25, median, p75, max), linear between ranks; null if there are no values."""
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)]))
    return F.when(F.count(x) > 0, F.struct(*[F.get(q, F.lit(i)).alias(n) for i, n in enumerate(("min", "p25", "median", "p75", "max"))]))


def label_counts(examples: DataFrame) -> DataFrame:
    """(label, n, rank): most frequent first, then by first appearance."""
    c = examples.groupBy(F.col("box.label").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    return c.withColumn("rank", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("bigint")).drop("first")


@dataclass
class ExampleIndex:
    examples: DataFrame
    scanned: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    @classmethod
    def build(cls, det: DataFrame, scanned: DataFrame, min_score: float = 0.0, min_side: float = 8.0, max_per_frame: int | None = None, meta: dict | None = None) -> ExampleIndex:
        """From finalized detections of the scanned frames. Frames that could not be read are in neither."""
        chosen = detections.select(det, min_score, min_side, max_per_frame)
        rows = chosen.join(scanned, "path").select("path", "frame_ord", "n", "box")
        said = {"min_score": min_score, "min_side": min_side, "max_per_frame": max_per_frame, **(meta or {})}
        return cls(in_order(rows, ["frame_ord", "n"]), scanned, {k: str(v) for k, v in said.items()})

    def filtered(self, min_score: float = 0.0, min_side: float = 0.0, max_per_frame: int | None = None, predicate: Column | None = None, keep: DataFrame | None = None) -> ExampleIndex:
        """Fewer examples, numbered anew; keep: a relation of the paths to keep, scanned included."""
        rows, scanned = self.examples, self.scanned
        if keep is not None:
            rows, scanned = rows.join(keep, "path", "left_semi"), scanned.join(keep, "path", "left_semi")
        if predicate is not None:
            rows = rows.where(predicate)
        rows = detections.select(rows.withColumnRenamed("n", "ord").drop("idx"), min_score, min_side, max_per_frame)
        return ExampleIndex(in_order(rows.select("path", "frame_ord", "n", "box"), ["frame_ord", "n"]), scanned, self.meta)

    def slice(self, start: int, stop: int) -> ExampleIndex:
        return ExampleIndex(self.examples.where(F.col("idx").between(start, stop - 1)), self.scanned, self.meta)

    def frames(self) -> DataFrame:
        """Paths with an example, in the order of their first one."""
        return self.examples.groupBy("path").agg(F.min("idx").alias("first")).orderBy("first")

    def stats(self) -> DataFrame:
        """One row: counts, rates (0 where nothing was scanned or found), quartiles of longer side and score."""
        b = F.col("box")
        hits = self.examples.agg(
            F.count(F.lit(1)).alias("examples"), F.count_distinct("path").alias("frames_with_boxes"), quartiles(boxes.long_side(b)).alias("side"), quartiles(b["score"]).alias("score")
        )
        both = hits.join(F.broadcast(self.scanned.agg(F.count(F.lit(1)).alias("frames_scanned"))))  # a row each
        rate = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(F.lit(0.0))
        return both.select("examples", "frames_with_boxes", "frames_scanned", rate("frames_with_boxes", "frames_scanned").alias("hit_rate"), rate("examples", "frames_with_boxes").alias("boxes_per_hit"), "side", "score")

    def by_path(self) -> DataFrame:
        """(path, frame_ord, boxes): every scanned frame, an empty list if nothing was found."""
        grouped = self.examples.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "box"))), lambda x: x["box"]).alias("boxes"))
        none = F.expr("cast(array() as array<struct<x_min:double,y_min:double,x_max:double,y_max:double,score:double,label:string>>)")
        return self.scanned.join(grouped, "path", "left").withColumn("boxes", F.coalesce("boxes", none))

    def write(self, path: str) -> None:
        """Three parquet tables under path."""
        spark = self.examples.sparkSession
        self.examples.write.mode("overwrite").parquet(f"{path}/examples")
        self.scanned.write.mode("overwrite").parquet(f"{path}/scanned")
        spark.createDataFrame(list(self.meta.items()), "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ExampleIndex:
        meta = {r.key: r.value for r in spark.read.parquet(f"{path}/meta").collect()}
        return cls(spark.read.parquet(f"{path}/examples"), spark.read.parquet(f"{path}/scanned"), meta | {"source_file": path})

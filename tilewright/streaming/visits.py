"""The endless stream of training visits, and an index that grows with its frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ordering
from ..operators.index import ExampleIndex


def endless(spark: SparkSession, n: int, rows_per_batch: int = 256, partitions: int = 1) -> DataFrame:
    """A stream of (j, idx, epoch): visit j is example j mod n of epoch j div n. Stateless, and replayed alike after a failure."""
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", partitions).load()
    idx, epoch = ordering.virtual(F.col("value"), n)
    return ticks.select(F.col("value").alias("j"), idx.alias("idx"), epoch.alias("epoch"))


def visited(stream: DataFrame, index: ExampleIndex) -> DataFrame:
    """The visits joined with their examples: stream with static table."""
    return stream.join(index.examples, "idx")


def grow(files: DataFrame, detect, path: str, checkpoint: str, **thresholds):
    """Index frames as they arrive in a file stream; a restart goes on where it stopped.

    files: a stream of (path, image); detect: frames -> detections. Each micro-batch is
    written under its number, so one that is repeated replaces itself.
    """

    def add(batch: DataFrame, number: int) -> None:
        scanned = ordering.in_order(batch.select("path").distinct(), ["path"], "frame_ord")
        ExampleIndex.build(detect(batch), scanned, **thresholds).write(f"{path}/batch={number}")

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Metadata tables of rendered scenes: <root>/<split>/metadata/<scene>/*.csv."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lookup import last_of

SIDES = [f"{axis}_{end}_{box}{suffix} double" for box in ("tight", "loose") for suffix in ("", "_lwir") for axis in "xy" for end in ("min", "max")]
#: Columns that are read; a file may have more, and lack some.
SCHEMA = ", ".join(["image_name string", "category string", *SIDES, "is_target_visible double", "is_target_visible_lwir double"])


def read(spark: SparkSession, root: str, split: str = "*", scene: str = "*") -> DataFrame:
    """One row for each (split, scene, image_name), the last in file and row order; no file is a FileNotFoundError."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("header", True).csv(f"{root}/{split}/metadata/{scene}/*.csv")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{root}/{split}/metadata/{scene}") from e
        raise
    wanted = [c.split() for c in SCHEMA.split(", ")]
    cols = [F.expr(f"try_cast({n} as {t})").alias(n) for n, t in wanted if n in raw.columns]
    # rows of one file are numbered as they are read
    rows = raw.select(*cols, F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    parts = F.split("file", "/")
    rows = rows.withColumn("scene", F.element_at(parts, -2)).withColumn("split", F.element_at(parts, -4))
    return last_of(rows, ["split", "scene", "image_name"], [F.col("file"), F.col("row")]).drop("file", "row")

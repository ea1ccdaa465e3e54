"""Boxes and metadata looked up for frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes, paths


def last_of(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row a key: the last in the given order."""
    w = Window.partitionBy(key).orderBy(*[c.desc() for c in order])
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def key_map(records: DataFrame) -> DataFrame:
    """(form, key): every form of every record's key; a form belongs to the first record that has it.

    records: (key, key_ord).
    """
    forms = records.select("key", "key_ord", F.explode(paths.key_forms(F.col("key"))).alias("f"))
    first = Window.partitionBy("f.form").orderBy("key_ord", "f.priority")
    return forms.withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(F.col("f.form").alias("form"), "key")


def find_keys(frames: DataFrame, records: DataFrame, allow_missing: bool = True) -> DataFrame:
    """frames (path) with key: the record found by path, else by name, else by stem; null if there is none.

    Without allow_missing a frame with no record is an error when its row is read.
    """
    asked = frames.withColumn("__f", F.explode(paths.key_forms(F.col("path"))))
    hit = asked.join(key_map(records), F.col("__f.form") == F.col("form"), "left")
    found = hit.groupBy("path").agg(F.min_by("key", F.when(F.col("key").isNotNull(), F.col("__f.priority"))).alias("key"))
    if not allow_missing:
        found = found.withColumn("key", F.coalesce("key", F.raise_error(F.concat(F.lit("no boxes for "), "path"))))
    return frames.join(found, "path")


def visible(flag: Column) -> Column:
    """Falsy flags hide; a missing one does not."""
    return flag.isNull() | F.isnan(flag.cast("double")) | (flag.cast("double") != 0)


def metadata_boxes(frames: DataFrame, meta: DataFrame, box: str = "tight", require_visible: bool = True) -> DataFrame:
    """(path, ord, box): each frame's ground truth by (split, scene, stem), its max corner one pixel out.

    Columns of the `lwir` modality end in _lwir. Frames with no row have no box.
    """
    if box not in ("tight", "loose"):
        raise ValueError("box must be 'tight' or 'loose'")
    keyed = frames.withColumn("__p", paths.render_parts(F.col("path")))
    hit = keyed.join(meta.withColumnRenamed("image_name", "__stem"), (F.col("__p.split") == meta["split"]) & (F.col("__p.scene") == meta["scene"]) & (F.col("__p.stem") == F.col("__stem")))

    def value(name: str) -> Column:
        """The column of the frame's modality; null if the table has none."""
        plain = F.col(name) if name in meta.columns else F.lit(None)
        infrared = F.col(f"{name}_lwir") if f"{name}_lwir" in meta.columns else F.lit(None)
        return F.when(F.col("__p.modality") == "lwir", infrared).otherwise(plain)

    if require_visible:
        hit = hit.where(visible(value("is_target_visible")))
    label = F.coalesce(F.col("category"), F.lit(boxes.DEFAULT_LABEL)) if "category" in meta.columns else F.lit(boxes.DEFAULT_LABEL)
    made = boxes.make(value(f"x_min_{box}"), value(f"y_min_{box}"), value(f"x_max_{box}") + 1, value(f"y_max_{box}") + 1, 1.0, label)
    return hit.select("path", F.lit(0).cast("bigint").alias("ord"), made.alias("box"))

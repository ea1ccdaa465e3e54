"""The life of an example index: built from frames, kept in a file, loaded again under other thresholds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources import boxes_json
from . import index
from .detectors import Detector, FunctionDetector
from .index import ExampleIndex


def from_boxes(records: DataFrame, min_score: float = 0.0, min_side: float = 0.0, max_per_frame: int | None = None, keep: DataFrame | None = None, meta: dict | None = None) -> ExampleIndex:
    """An index from a box file's rows (key, key_ord, ord, box), its thresholds applied anew; every key is a scanned frame.

    keep: a relation of the paths to keep, scanned included.
    """
    scanned = records.select(F.col("key").alias("path"), F.col("key_ord").alias("frame_ord")).distinct()
    found = records.where("box is not null").select(F.col("key").alias("path"), "ord", "box")
    if keep is not None:
        scanned, found = scanned.join(keep, "path", "left_semi"), found.join(keep, "path", "left_semi")
    return ExampleIndex.build(found, scanned, min_score, min_side, max_per_frame, meta)


def build(frames: DataFrame, detector: Detector, on_error: str = "warn", progress: Observation | None = None, meta: dict | None = None, **thresholds) -> tuple[ExampleIndex, DataFrame]:
    """An index of frames (path, frame_ord, image, and error if some couldn't be read), and the failed ones (path, error).

    A frame that can't be read, or at which the detector fails, is in neither of the index's
    relations; with on_error='raise' it is an error instead. progress: an observation that holds the number
    of frames scanned and of pixels read once the index has been read.
    """
    if on_error not in ("warn", "raise"):
        raise ValueError("on_error must be 'warn' or 'raise'")
    error = F.col("error") if "error" in frames.columns else F.lit(None).cast("string")
    seen = frames.withColumn("error", error)
    broken = F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean") if on_error == "raise" else F.lit(False)
    good = seen.where(F.when(F.col("error").isNull(), True).otherwise(broken)).drop("error")
    failures = seen.where("error is not null").select("path", "error")
    if isinstance(detector, FunctionDetector):
        shared_dir(frames.sparkSession)
        tried = detector.tried(good, on_error).checkpoint()  # asked once a frame
        broken = tried.where("error is not null").select("path", "error")
        failures, good = failures.unionByName(broken), good.join(broken.select("path"), "path", "left_anti")
        found = detector.cleaned(detector.boxes_of(tried), good)
    else:
        found = detector.detect(good)
    scanned = good.select("path", "frame_ord")
    if progress is not None:
        pixels = F.col("image.height") * F.col("image.width") if "image" in good.columns else F.lit(0)
        scanned = good.observe(progress, F.count(F.lit(1)).alias("frames"), F.sum(pixels.cast("long")).alias("pixels")).select("path", "frame_ord")
    made = ExampleIndex.build(found, scanned, meta={"detector": type(detector).__name__, **(meta or {})}, **thresholds)
    return made, failures


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's readers find something there."""
    try:
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").take(1)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return False
    return True


def load(spark: SparkSession, path: str, keep: DataFrame | None = None, **thresholds) -> ExampleIndex:
    """An index from its own tables or, by the ending .json, from a box file; filtered and numbered anew. One without examples is an error."""
    if path.endswith(".json"):
        got = from_boxes(boxes_json.read(spark, path), keep=keep, meta=boxes_json.meta(spark, path) | {"source_file": path}, **thresholds)
    else:
        got = ExampleIndex.read(spark, path)
        if keep is not None or any(v for v in thresholds.values()):
            got = got.filtered(keep=keep, **thresholds)
    if not got.examples.take(1):
        raise ValueError(f"{path} holds no example under these thresholds, or of these frames")
    return got


def load_or_build(spark: SparkSession, path: str | None, make: Callable[[], ExampleIndex], force: bool = False, keep: DataFrame | None = None, **thresholds) -> ExampleIndex:
    """The index kept under path; made and written there first if there is none, or by force."""
    if path is None:
        return make()
    if force or not exists(spark, path):
        made = make()
        if path.endswith(".json"):
            boxes_json.write(made.by_path(), path, made.meta)
        else:
            made.write(path)
    return load(spark, path, keep, **thresholds)


def describe(examples: ExampleIndex, **settings) -> dict:
    """An index's numbers and labels, and the settings it is used with."""
    numbers = examples.stats().first().asDict(recursive=True)
    return numbers | {"labels": {r.label: r.n for r in index.label_counts(examples.examples).orderBy("rank").toLocalIterator()}, "meta": dict(examples.meta)} | settings

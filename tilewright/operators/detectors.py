"""Detectors: where boxes come from, chosen by name.

A detector turns frames (path, image) into detections (path, ord, box). Lookups are
joins; a Python model is wrapped as an Arrow-batched UDF that sees one frame at a time.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import BOX, DEFAULT_LABEL, DEFAULT_SCORE
from . import augment, detections, lookup
from .catalogue import Catalogue

BOX_FIELDS = BOX[7:-1].replace(":", " ")


class Detector(ABC):
    """Subclasses give raw(frames); detect() cleans what it returns."""

    def __init__(self, keep_labels=None, rename_labels: dict[str, str] | None = None, min_side: float = 1.0):
        self.keep_labels, self.rename_labels, self.min_side = keep_labels, rename_labels, min_side

    @abstractmethod
    def raw(self, frames: DataFrame) -> DataFrame: ...

    def detect(self, frames: DataFrame) -> DataFrame:
        return self.cleaned(self.raw(frames), frames)

    def cleaned(self, det: DataFrame, frames: DataFrame) -> DataFrame:
        size = None
        if "image" in frames.columns:  # boxes can only be clipped where a frame's size is known
            det = det.join(frames.select("path", F.col("image.width").alias("__w"), F.col("image.height").alias("__h")), "path")
            size = (F.col("__w"), F.col("__h"))
        return detections.finalize(det, self.keep_labels, self.rename_labels, self.min_side, size).select("path", "ord", "box")


def as_box(value) -> dict:
    """A mapping in any spelling, or a sequence of four numbers with score and label after them if wanted."""
    if isinstance(value, Mapping):
        corners = value["bbox"] if "bbox" in value else [value.get(a, value.get(b)) for a, b in (("x_min", "x0"), ("y_min", "y0"), ("x_max", "x1"), ("y_max", "y1"))]
        score, label = value.get("score", value.get("confidence", DEFAULT_SCORE)), value.get("label", value.get("class", DEFAULT_LABEL))
    else:
        corners, rest = list(value)[:4], list(value)[4:]
        score, label = (rest + [DEFAULT_SCORE])[0], (rest[1:] + [DEFAULT_LABEL])[0]
    if len(corners) < 4 or any(c is None for c in corners):
        raise ValueError(f"no box: {value!r}")
    return dict(zip(("x_min", "y_min", "x_max", "y_max"), map(float, corners)), score=float(score), label=str(label))


class FunctionDetector(Detector):
    """fn(pixels, path) or fn(pixels) -> boxes, or None for none; on_error='warn' passes over frames at which it fails."""

    def __init__(self, fn: Callable, takes_path: bool = True, dtype: str = "uint8", on_error: str = "raise", **options):
        super().__init__(**options)
        self.fn, self.takes_path, self.dtype, self.on_error = fn, takes_path, dtype, on_error

    def tried(self, frames: DataFrame, on_error: str) -> DataFrame:
        """(path, boxes, error): what the function says of each frame, or how it failed."""
        fn, takes_path, dtype = self.fn, self.takes_path, self.dtype

        @F.pandas_udf(f"boxes array<{BOX}>, error string")
        def run(images: pd.DataFrame, paths: pd.Series) -> pd.DataFrame:
            said, failed = [], []
            for i, p in zip(images[["data", "height", "width", "nChannels"]].itertuples(index=False, name=None), paths):
                try:
                    px = augment.pixels_of(*i, dtype)
                    said.append([as_box(b) for b in (fn(px, p) if takes_path else fn(px)) or []])
                    failed.append(None)
                except Exception as e:
                    if on_error == "raise":
                        raise
                    said.append(None)
                    failed.append(f"{type(e).__name__}: {e}")
            return pd.DataFrame({"boxes": said, "error": failed})

        return frames.select("path", run("image", "path").alias("r")).select("path", "r.boxes", "r.error")

    def raw(self, frames: DataFrame) -> DataFrame:
        return self.boxes_of(self.tried(frames, self.on_error))

    @staticmethod
    def boxes_of(tried: DataFrame) -> DataFrame:
        return tried.select("path", F.posexplode("boxes").alias("ord", "box"))


class PrecomputedDetector(Detector):
    """Boxes of a file relation (key, key_ord, ord, box), found by path, name or stem."""

    def __init__(self, records: DataFrame, allow_missing: bool = True, **options):
        super().__init__(**options)
        self.records, self.allow_missing = records, allow_missing

    def raw(self, frames: DataFrame) -> DataFrame:
        keys = self.records.select("key", "key_ord").distinct()
        found = lookup.find_keys(frames.select("path"), keys, self.allow_missing)
        return found.join(self.records.where("box is not null"), "key").select("path", "ord", "box")


class MetadataDetector(Detector):
    """Ground truth from a metadata relation."""

    def __init__(self, meta: DataFrame, box: str = "tight", require_visible: bool = True, **options):
        super().__init__(**options)
        self.meta, self.box, self.require_visible = meta, box, require_visible

    def raw(self, frames: DataFrame) -> DataFrame:
        return lookup.metadata_boxes(frames.select("path"), self.meta, self.box, self.require_visible)


class GridDetector(Detector):
    """Raw grid predictions (path, ord, cx, cy, w, h, obj, cls, frame_w, frame_h) of a one-stage model that ran elsewhere."""

    def __init__(self, predictions: DataFrame, names: list[str], kept=None, conf: float = 0.25, nms: float = 0.45, size: int = 416, **options):
        super().__init__(**options)
        self.predictions, self.args = predictions, (names, kept, conf, nms, size)

    def raw(self, frames: DataFrame) -> DataFrame:
        return detections.decode(self.predictions.join(frames.select("path"), "path", "left_semi"), *self.args)


class NullDetector(Detector):
    """Finds nothing, for crops whose boxes are known already."""

    def raw(self, frames: DataFrame) -> DataFrame:
        return frames.select("path", F.lit(0).alias("ord"), F.lit(None).cast(BOX).alias("box")).where(F.lit(False))


DETECTORS = Catalogue("detector", lambda x: isinstance(x, type) and issubclass(x, Detector))
DETECTORS.add("function callable", FunctionDetector, "a Python function over pixels")
DETECTORS.add("precomputed file json", PrecomputedDetector, "boxes read from a file")
DETECTORS.add("metadata gt truth", MetadataDetector, "ground truth of rendered frames")
DETECTORS.add("null none", NullDetector, "nothing")
DETECTORS.add("grid yolov3 yolo", GridDetector, "raw predictions of a one-stage model")


def build(what, **options) -> Detector:
    """A detector from a name (or module:attribute) or class, a function over pixels, or a mapping with a name and options; a detector stays what it is."""
    if isinstance(what, Mapping):
        options = {k: v for k, v in what.items() if k not in ("name", "type")} | options
        what = what.get("name") or what.get("type") or ""
    if isinstance(what, Detector):
        if options:
            raise TypeError(f"{', '.join(options)}: the detector is made already")
        return what
    if isinstance(what, str):
        what = DETECTORS.find(what)
    if DETECTORS.fits(what):
        return what(**options)
    if isinstance(what, type) or not callable(what):
        raise TypeError(f"{what!r} can't be used as a detector")
    return FunctionDetector(what, **options)

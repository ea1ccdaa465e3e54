"""Contract checks as queries: one row for each violation."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from .augment import Augmenter
from .detectors import as_box


def detection_violations(det: DataFrame, frame_w, frame_h, tolerance: float = 1.0) -> DataFrame:
    """(path, ord, rule): boxes that are not finite, degenerate, outside the frame, in 0..1 units, or without a label.

    det: path, ord, box; the frame's size as numbers or columns.
    """
    b = F.col("box")
    w, h = (x if hasattr(x, "cast") else F.lit(float(x)) for x in (frame_w, frame_h))
    fine = boxes.finite(b)
    outside = (b["x_min"] < -tolerance) | (b["y_min"] < -tolerance) | (b["x_max"] > w + tolerance) | (b["y_max"] > h + tolerance)
    rules = {
        "null": b.isNull(),
        "not finite": b.isNotNull() & ~fine,
        "degenerate": fine & ((boxes.width(b) <= 0) | (boxes.height(b) <= 0)),
        "outside": fine & outside,
        "normalised": fine & (F.greatest(*[b[c] for c in boxes.CORNERS]) <= 1.5) & (w > 4) & (h > 4),
        "label": b.isNotNull() & (b["label"].isNull() | (F.trim(b["label"]) == "")),
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda r: r.isNotNull())
    return det.select("path", "ord", F.explode(found).alias("rule"))


def permutation_problem(order: DataFrame, n: int, col: str = "idx") -> DataFrame:
    """One row if the column isn't a permutation of 0..n-1, else none."""
    seen = order.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(col).alias("distinct"), F.min(col).alias("low"), F.max(col).alias("high"))
    good = (F.col("rows") == n) & (F.col("distinct") == n) & (F.col("low") == 0) & (F.col("high") == n - 1)
    return seen.where(~F.coalesce(good, F.lit(n == 0)))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either that the other lacks, with multiplicity; none if equal."""
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def augmenter_problems(augmenter: Augmenter, image: np.ndarray, box, seeds=range(16)) -> list[str]:
    """What an augmenter does wrong on one frame; empty if nothing."""
    said: list[str] = []
    shapes = set()
    fired = 0
    before = image.copy()
    for s in seeds:
        p = augmenter.augment(image, box, seed=s)
        if not np.array_equal(image, before):
            said.append(f"seed {s}: the input itself was changed")
            image[...] = before
        if p.doctored.shape != p.clean.shape or p.mask.shape != p.clean.shape[:2]:
            said.append(f"seed {s}: shapes differ")
            continue
        if p.doctored.dtype != p.clean.dtype:
            said.append(f"seed {s}: types differ")
        if not (0 <= p.mask.min() and p.mask.max() <= 1):
            said.append(f"seed {s}: mask outside 0..1")
        changed = (p.doctored != p.clean).reshape(*p.mask.shape, -1).any(axis=2)
        if (changed & (p.mask == 0)).any():
            said.append(f"seed {s}: pixels outside the mask changed")
        again = augmenter.augment(image, box, seed=s)
        if not (np.array_equal(again.doctored, p.doctored) and again.params == p.params):
            said.append(f"seed {s}: not the same again")
        fired += p.skipped is None and bool(changed.any())
        shapes.add(p.doctored.tobytes())
    if not fired:
        said.append("nothing is ever changed")
    elif len(shapes) == 1 and len(list(seeds)) > 1:
        said.append("every seed gives the same")
    off = augmenter.augment(image, (-80.0, -80.0, -40.0, -40.0), seed=0)
    if not np.array_equal(off.doctored, off.clean):
        said.append("a box outside the frame changed it")
    return said


def detector_problems(fn: Callable, image: np.ndarray, path: str | None = None) -> list[str]:
    """What a detecting function does wrong on one frame: fn(pixels) or, with a path, fn(pixels, path); empty if nothing."""
    said: list[str] = []
    given = image.copy()
    ask = lambda: fn(given) if path is None else fn(given, path)
    try:
        answers = [ask(), ask()]
    except Exception as e:
        return [f"it fails: {type(e).__name__}: {e}"]
    if not np.array_equal(given, image):
        said.append("the frame itself was changed")
    if not all(a is None or isinstance(a, (list, tuple)) for a in answers):
        return [*said, f"it returns a {type(answers[0]).__name__}, no list of boxes"]
    try:
        first, second = ([as_box(b) for b in a or []] for a in answers)
    except (TypeError, ValueError, KeyError) as e:
        return [*said, f"no box: {e}"]
    if repr(first) != repr(second):  # NaN is no difference
        said.append("not the same again")
    high, wide = image.shape[:2]
    for i, b in enumerate(first):
        corners = [b[c] for c in ("x_min", "y_min", "x_max", "y_max")]
        if not np.isfinite([*corners, b["score"]]).all():
            said.append(f"box {i}: not finite")
        elif b["x_max"] <= b["x_min"] or b["y_max"] <= b["y_min"]:
            said.append(f"box {i}: degenerate")
        elif max(corners) <= 1.5 < min(high, wide) / 4:
            said.append(f"box {i}: normalised")
        elif min(corners[:2]) < -1 or corners[2] > wide + 1 or corners[3] > high + 1:
            said.append(f"box {i}: outside")
    return said


def generator_problems(visit: Callable[[int], DataFrame], n: int, epochs: int = 2) -> DataFrame:
    """(rule, epoch): visit(epoch) must give (pos, idx, clean_key, pair_key) as a permutation, clean alike and pairs different between epochs, orders too."""
    first = visit(0)
    spark = first.sparkSession
    out = [permutation_problem(visit(e), n).select(F.lit("order").alias("rule"), F.lit(e).alias("epoch")) for e in range(epochs)]
    for e in range(1, epochs):
        both = first.alias("a").join(visit(e).alias("b"), "idx")
        out.append(both.where("a.clean_key <> b.clean_key").select(F.lit("target changes").alias("rule"), F.lit(e).alias("epoch")).limit(1))
        same = both.agg((F.count(F.lit(1)) == F.sum((F.col("a.pos") == F.col("b.pos")).cast("int"))).alias("same"))
        out.append(same.where("same").where(F.lit(n > 2)).select(F.lit("same order").alias("rule"), F.lit(e).alias("epoch")))
        alike = both.agg((F.count(F.lit(1)) == F.sum((F.col("a.pair_key") == F.col("b.pair_key")).cast("int"))).alias("same"))
        out.append(alike.where("same").select(F.lit("same pairs").alias("rule"), F.lit(e).alias("epoch")))
    again = same_rows(first.select("pos", "idx", "clean_key", "pair_key"), visit(0).select("pos", "idx", "clean_key", "pair_key"))
    out.append(again.select(F.lit("not the same again").alias("rule"), F.lit(0).alias("epoch")).limit(1))
    return reduce(DataFrame.unionByName, out, spark.createDataFrame([], "rule string, epoch int"))

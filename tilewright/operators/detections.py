"""From raw detections to a ranked selection for each frame.

Detections are rows of (path, ord, box); ord is the place of a box in its detector's
answer and settles ties, as relations have no order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import boxes


def finalize(
    det: DataFrame, keep_labels: Iterable[str] | None = None, rename: dict[str, str] | None = None, min_side: float = 1.0, frame_size: tuple | None = None
) -> DataFrame:
    """Cleaned boxes: labels kept by their old name, clipped, thin ones dropped, renamed.

    frame_size: (width, height) as numbers or columns; without it nothing is clipped.
    A box with NaN corners is neither clipped nor thin and stays, for selection to drop.
    """
    if keep_labels is not None:
        det = det.where(F.col("box.label").isin(*keep_labels))
    if frame_size:
        det = det.withColumn("box", boxes.clipped(F.col("box"), *frame_size))
    b = F.col("box")
    det = det.where(~((boxes.width(b) < min_side) | (boxes.height(b) < min_side)))
    if rename:
        names = F.create_map(*[F.lit(x) for kv in rename.items() for x in kv])
        det = det.withColumn("box", boxes.make(*[b[c] for c in boxes.CORNERS], b["score"], F.coalesce(F.element_at(names, b["label"]), b["label"])))
    return det


def strong(min_score: float = 0.0, min_side: float = 0.0) -> Column:
    """score and both sides reach their thresholds; NaN, which Spark takes for the largest number, reaches none."""
    b = F.col("box")
    reaches = lambda x, least: (x >= least) & ~F.isnan(x)
    return reaches(b["score"], min_score) & reaches(boxes.width(b), min_side) & reaches(boxes.height(b), min_side)


def rank(det: DataFrame, by: str | list[str] = "path", ordinal: str = "ord") -> DataFrame:
    """det with n: 0 for a frame's best box, and so on."""
    over = Window.partitionBy(by).orderBy(*boxes.order_columns(F.col("box"), ordinal))
    return det.withColumn("n", (F.row_number().over(over) - 1).cast("bigint"))


def select(det: DataFrame, min_score: float = 0.0, min_side: float = 0.0, max_per_frame: int | None = None, by: str | list[str] = "path", ordinal: str = "ord") -> DataFrame:
    """The boxes of each frame that are strong enough, best first as n = 0, 1, ..; no or zero max_per_frame: all."""
    ranked = rank(det.where(strong(min_score, min_side)), by, ordinal)
    return ranked.where(F.col("n") < max_per_frame) if max_per_frame else ranked


#: Boxes that are compared by themselves from so many of one frame and label on; smaller groups are folded together.
LARGE = 256


def hidden(kept: np.ndarray, others: np.ndarray, threshold: float) -> np.ndarray:
    """Whether a kept box overlaps each other one by more than the threshold. Columns of corners and area; as in boxes.iou, NaN is the largest number."""
    low, high = np.maximum(kept[:2], others[:2]), np.fmin(kept[2:4], others[2:4])
    sides = np.maximum(high - low, 0.0)
    inter = sides[0] * sides[1]
    union = kept[4] + others[4] - inter
    return ~(np.where(union <= 0, 0.0, inter / union) <= threshold)


def fold(b: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes of one group, best first, non-maximum suppression keeps."""
    left, keeps = np.arange(b.shape[1]), np.zeros(b.shape[1], bool)
    while len(left):
        stays, i = np.ones(len(left), bool), 0
        for _ in range(32):  # and then those that are hidden are left out
            keeps[left[i]], stays[i] = True, False
            stays[i + 1 :] &= ~hidden(b[:, i : i + 1], b[:, i + 1 :], threshold)
            after = np.argmax(stays[i:])
            if not stays[i + after]:
                break
            i += after
        left, b = left[stays], b[:, stays]
    return keeps


def survivors(b: np.ndarray, group: np.ndarray, threshold: float) -> np.ndarray:
    """Which boxes are kept of groups that lie together, each best first.

    Small groups are folded in step: in each round the best box left of every group is kept, and hides others of its own.
    """
    keeps = np.zeros(len(group), bool)
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    sizes = np.diff(ends, prepend=0)
    for end, n in zip(ends[sizes >= LARGE], sizes[sizes >= LARGE]):
        keeps[end - n : end] = fold(b[:, end - n : end], threshold)
    left = np.flatnonzero(np.repeat(sizes < LARGE, sizes))
    group, b = group[left], b[:, left]
    while len(left):
        best = np.flatnonzero(np.diff(group, prepend=-1))
        keeps[left[best]] = True
        stays = ~hidden(np.repeat(b[:, best], np.diff(np.append(best, len(left))), axis=1), b, threshold)
        stays[best] = False
        left, group, b = left[stays], group[stays], b[:, stays]
    return keeps


def kept_boxes(threshold: float, ordinal: str):
    """Batches of ranked frames (first: whether a row begins one) to the boxes that are kept, ordinal: their rank."""

    def kept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        frame = np.cumsum(rows["first"].to_numpy())
        rows = rows.drop_columns("first").combine_chunks()
        box = rows["box"].combine_chunks()
        corners = [box.field(c) for c in boxes.CORNERS]
        label = pc.fill_null(box.field("label").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        known = (label >= 0) & ~np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in corners])
        b = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in corners])
        b = np.vstack((b, np.prod(np.maximum(b[2:] - b[:2], 0.0), axis=0)))
        at = np.flatnonzero(known)
        at = at[np.lexsort((label[at], frame[at]))]  # a stable sort: best first in each group
        keeps = ~known  # without a label or a corner a box overlaps nothing
        if len(at):
            group = np.cumsum(np.append(False, (np.diff(frame[at]) != 0) | (np.diff(label[at]) != 0)))
            with np.errstate(all="ignore"):
                keeps[at] = survivors(b[:, at], group, threshold)
        frame = frame[keeps]
        rank = np.arange(len(frame)) - np.searchsorted(frame, frame)
        out = rows.filter(pa.array(keeps)).append_column(ordinal, pa.array(rank, pa.int32()))
        yield from out.to_batches(10_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # of the frame that isn't complete yet
        for batch in batches:
            begins = np.flatnonzero(batch["first"].to_numpy(zero_copy_only=False))
            if len(begins):
                held.append(batch.slice(0, begins[-1]))
                yield from kept(pa.Table.from_batches(held))
                held = []
                batch = batch.slice(begins[-1])
            held.append(batch)
        if held:
            yield from kept(pa.Table.from_batches(held))

    return run


def suppress(det: DataFrame, threshold: float = 0.45, by: str | list[str] = "path", ordinal: str = "ord", carry: Iterable[str] = ()) -> DataFrame:
    """Class-wise non-maximum suppression in each frame; one row a kept box, ord its rank, with the columns of carry.

    The fold is sequential within a frame, as a suppressed box must not suppress others;
    frames are independent. Spark ranks the boxes; the fold compares a kept box with all that
    are left of its label at once, in numpy over Arrow batches.
    """
    keys, b = [by] if isinstance(by, str) else list(by), F.col("box")
    over = Window.partitionBy(*keys).orderBy((-b["score"]).asc(), (-boxes.area(b)).asc(), F.col(ordinal).asc(), b.asc())
    ranked = det.select(*keys, "box", *carry, (F.row_number().over(over) == 1).alias("first"))
    out = ranked.drop("first").withColumn(ordinal, F.lit(0))
    return ranked.mapInArrow(kept_boxes(threshold, ordinal), out.schema).select(*keys, ordinal, "box", *carry)


def decode(pred: DataFrame, names: list[str], kept: Iterable[str] | None = None, conf: float = 0.25, nms: float = 0.45, size: int = 416, by: str | list[str] = "path") -> DataFrame:
    """Grid predictions (cx, cy, w, h, obj, cls) of a letterboxed square to boxes in the frame (frame_w, frame_h).

    Only kept classes compete for the best one; obj x best must exceed conf.
    """
    keys = [by] if isinstance(by, str) else list(by)
    if size % 32 or size <= 32:
        raise ValueError("size must be a multiple of 32 and over 32")
    unknown = set(kept or ()) - set(names)
    if unknown:
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    ids = [i for i, n in enumerate(names) if kept is None or n in set(kept)]
    options = F.array(*[F.struct(F.get("cls", F.lit(i)).alias("p"), F.lit(-i).alias("i"), F.lit(names[i]).alias("name")) for i in ids])
    best = pred.withColumn("best", F.array_max(options)).withColumn("score", F.col("obj") * F.col("best.p")).where(F.col("score") > conf)
    square = boxes.from_center(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.col("score"), F.col("best.name"))
    framed = boxes.undo_letterbox(square, boxes.letterbox(F.col("frame_w"), F.col("frame_h"), size))
    rows = best.select(*keys, F.col("ord"), "frame_w", "frame_h", framed.alias("box"))
    size = ["frame_w", "frame_h"]
    return finalize(suppress(rows, nms, keys, carry=size), frame_size=tuple(map(F.col, size))).drop(*size)


def crops(det: DataFrame, out_size: int = 256, paste_context: float = 0.15, window_context: float = 0.0) -> DataFrame:
    """det with window, paste_box, scale, and both boxes in the patch's coordinates."""
    b, w = F.col("box"), F.col("window")
    out = det.withColumn("window", boxes.window(b, out_size, paste_context, window_context)).withColumn("paste_box", boxes.expanded(b, paste_context))
    out = out.withColumn("scale", boxes.window_scale(w, out_size))
    return out.withColumn("detection_in_patch", boxes.in_patch(b, w, F.col("scale"))).withColumn("paste_in_patch", boxes.in_patch(F.col("paste_box"), w, F.col("scale")))


def agreement(one: DataFrame, many: DataFrame, by: str = "path", px: float = 1.0, score: float = 0.05) -> DataFrame:
    """Where single and batched detection differ: in number, in label, by more than px or score."""
    a, b = one.select(by, "ord", F.col("box").alias("a")), many.select(by, "ord", F.col("box").alias("b"))
    both = a.join(b, [by, "ord"], "full_outer")
    drift = F.greatest(*[F.abs(F.col(f"a.{c}") - F.col(f"b.{c}")) for c in boxes.CORNERS])
    what = (
        F.when(F.col("a").isNull() | F.col("b").isNull(), "count").when(F.col("a.label") != F.col("b.label"), "label")
        .when(drift > px, "drift").when(F.abs(F.col("a.score") - F.col("b.score")) > score, "score")
    )
    return both.withColumn("problem", what).where("problem is not null")

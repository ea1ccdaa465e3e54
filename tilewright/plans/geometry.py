"""Queries over box geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import detections as ops
from .views import DET, FRAME_H, FRAME_W, TOP3, box, detections, flat, ord_columns


def box_geometry(spark, sf):
    d = detections(spark, sf)
    cx, cy = boxes.center(box())
    return d.select(
        "frame", *ord_columns(d), boxes.width(box()).alias("w"), boxes.height(box()).alias("h"), cx.alias("cx"), cy.alias("cy"), boxes.area(box()).alias("area"),
        *flat(boxes.expanded(box(), 0.15), "e_"), *flat(boxes.shifted(box(), 3.5, -2.25), "s_"), *flat(boxes.scaled(box(), 0.5), "z_"),
    )


BOX_GEOMETRY = f"""WITH {DET} SELECT frame, ln, pk, sk, x1 - x0 AS w, y1 - y0 AS h, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (x1 - x0) * (y1 - y0) AS area,
  round(x0 - (x1 - x0) * 0.15::DOUBLE / 2, 6) AS e_x0, round(y0 - (y1 - y0) * 0.15::DOUBLE / 2, 6) AS e_y0,
  round(x1 + (x1 - x0) * 0.15::DOUBLE / 2, 6) AS e_x1, round(y1 + (y1 - y0) * 0.15::DOUBLE / 2, 6) AS e_y1,
  x0 + 3.5 AS s_x0, y0 - 2.25 AS s_y0, x1 + 3.5 AS s_x1, y1 - 2.25 AS s_y1,
  x0 * 0.5 + 0.0::DOUBLE AS z_x0, y0 * 0.5 + 0.0::DOUBLE AS z_y0, x1 * 0.5 + 0.0::DOUBLE AS z_x1, y1 * 0.5 + 0.0::DOUBLE AS z_y1 FROM det"""
BOX_GEOMETRY = BOX_GEOMETRY.replace("+ 3.5", "+ 3.5::DOUBLE").replace("- 2.25", "- 2.25::DOUBLE").replace("* 0.5 ", "* 0.5::DOUBLE ")


def box_clip_round(spark, sf):
    d = detections(spark, sf)
    grown = boxes.expanded(box(), 0.13)
    return d.select("frame", *ord_columns(d), *flat(boxes.clipped(grown, FRAME_W, FRAME_H), "c_"), *flat(boxes.rounded(grown), "r_"), F.get(boxes.as_int(grown), F.lit(2)).alias("slice_x1"))


_G = "x0 - (x1 - x0) * 0.13::DOUBLE / 2 AS a, y0 - (y1 - y0) * 0.13::DOUBLE / 2 AS b, x1 + (x1 - x0) * 0.13::DOUBLE / 2 AS c, y1 + (y1 - y0) * 0.13::DOUBLE / 2 AS d"
BOX_CLIP_ROUND = f"""WITH {DET}, g AS (SELECT frame, ln, pk, sk, {_G} FROM det)
SELECT frame, ln, pk, sk, round(greatest(0.0::DOUBLE, least(a, 640::DOUBLE)), 6) AS c_x0, round(greatest(0.0::DOUBLE, least(b, 512::DOUBLE)), 6) AS c_y0,
  round(greatest(0.0::DOUBLE, least(c, 640::DOUBLE)), 6) AS c_x1, round(greatest(0.0::DOUBLE, least(d, 512::DOUBLE)), 6) AS c_y1,
  floor(a) + 0.0::DOUBLE AS r_x0, floor(b) + 0.0::DOUBLE AS r_y0, ceil(c) + 0.0::DOUBLE AS r_x1, ceil(d) + 0.0::DOUBLE AS r_y1, ceil(c)::BIGINT AS slice_x1 FROM g"""


def box_iou_pairs(spark, sf):
    d = detections(spark, sf)
    a, b = d.select("frame", F.col("ord").alias("oa"), box().alias("a")), d.select("frame", F.col("ord").alias("ob"), box().alias("b"))
    both = a.join(b, "frame").where("oa < ob")
    iou = F.round(boxes.iou(F.col("a"), F.col("b")), 9)
    return both.select("frame", F.col("oa.ln").alias("ln"), F.col("oa.pk").alias("pk"), F.col("oa.sk").alias("sk"), F.col("ob.pk").alias("other_pk"), F.col("ob.sk").alias("other_sk"), iou.alias("iou")).where("iou > 0")


BOX_IOU_PAIRS = f"""WITH {DET}, p AS (
  SELECT a.frame, a.ln, a.pk, a.sk, b.pk AS other_pk, b.sk AS other_sk, (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas,
         greatest(0.0::DOUBLE, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0.0::DOUBLE, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter
  FROM det a JOIN det b ON a.frame = b.frame AND (a.ln, a.pk, a.sk) < (b.ln, b.pk, b.sk))
SELECT frame, ln, pk, sk, other_pk, other_sk, round(inter / (areas - inter), 9) AS iou FROM p WHERE round(inter / (areas - inter), 9) > 0"""


def finalize_boxes(spark, sf):
    d = ops.finalize(detections(spark, sf), ["A", "R"], {"R": "ship"}, 12.0, (FRAME_W, FRAME_H))
    d = ops.rank(d, "frame")
    return d.select("frame", "n", *ord_columns(d), *flat(box()), box()["label"].alias("label"))


_CLIP = "greatest(0.0::DOUBLE, least(x0, 640::DOUBLE)) AS x0, greatest(0.0::DOUBLE, least(y0, 512::DOUBLE)) AS y0, greatest(0.0::DOUBLE, least(x1, 640::DOUBLE)) AS x1, greatest(0.0::DOUBLE, least(y1, 512::DOUBLE)) AS y1"
FINALIZE_BOXES = f"""WITH {DET}, c AS (SELECT frame, ln, pk, sk, score, label, {_CLIP} FROM det WHERE label IN ('A', 'R')),
k AS (SELECT * FROM c WHERE NOT (x1 - x0 < 12 OR y1 - y0 < 12))
SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY score DESC, (x1 - x0) * (y1 - y0) DESC, ln, pk, sk) - 1 AS n, ln, pk, sk, x0, y0, x1, y1,
  CASE WHEN label = 'R' THEN 'ship' ELSE label END AS label FROM k"""


def chosen(spark, sf, top: int | None = None):
    return ops.select(detections(spark, sf), 0.92, 8.0, top, "frame")


def select_topk(spark, sf):
    d = chosen(spark, sf, 3)
    return d.select("frame", "n", *ord_columns(d), *flat(box()), box()["score"].alias("score"))


SELECT_TOPK = f"WITH {TOP3} SELECT frame, n, ln, pk, sk, x0, y0, x1, y1, score FROM top3"


def crop_window(spark, sf):
    """The flagship: for every frame its three best boxes, their training windows and scales."""
    d = ops.crops(chosen(spark, sf, 3), 128)
    return d.select("frame", "n", *flat(F.col("window"), "w_"), *flat(F.col("paste_box"), "p_"), F.round("scale", 12).alias("scale"))


_WIN = """, win AS (
  SELECT *, ceil(greatest(pw, ph, 128::DOUBLE)) AS side FROM (
    SELECT *, (x1 - x0) * 0.15::DOUBLE / 2 AS dx, (y1 - y0) * 0.15::DOUBLE / 2 AS dy,
           (x1 + (x1 - x0) * 0.15::DOUBLE / 2) - (x0 - (x1 - x0) * 0.15::DOUBLE / 2) AS pw, (y1 + (y1 - y0) * 0.15::DOUBLE / 2) - (y0 - (y1 - y0) * 0.15::DOUBLE / 2) AS ph FROM top3)
), placed AS (
  SELECT *, round_even(((x0 - dx) + (x1 + dx)) / 2 - side / 2, 0) + 0.0::DOUBLE AS wx, round_even(((y0 - dy) + (y1 + dy)) / 2 - side / 2, 0) + 0.0::DOUBLE AS wy,
         CASE WHEN side = 128 THEN 1.0::DOUBLE ELSE 128::DOUBLE / side END AS s FROM win)"""
CROP_WINDOW = f"""WITH {TOP3}{_WIN}
SELECT frame, n, wx AS w_x0, wy AS w_y0, wx + side AS w_x1, wy + side AS w_y1, round(x0 - dx, 6) AS p_x0, round(y0 - dy, 6) AS p_y0, round(x1 + dx, 6) AS p_x1, round(y1 + dy, 6) AS p_y1,
  round(s, 12) AS scale FROM placed"""


def patch_coords(spark, sf):
    d = ops.crops(chosen(spark, sf, 3), 128)
    return d.select("frame", "n", *flat(F.col("detection_in_patch"), "d_"), *flat(F.col("paste_in_patch"), "p_"))


PATCH_COORDS = f"""WITH {TOP3}{_WIN}
SELECT frame, n, round((x0 - wx) * s, 6) + 0.0::DOUBLE AS d_x0, round((y0 - wy) * s, 6) + 0.0::DOUBLE AS d_y0, round((x1 - wx) * s, 6) + 0.0::DOUBLE AS d_x1, round((y1 - wy) * s, 6) + 0.0::DOUBLE AS d_y1,
  round((x0 - dx - wx) * s, 6) + 0.0::DOUBLE AS p_x0, round((y0 - dy - wy) * s, 6) + 0.0::DOUBLE AS p_y0, round((x1 + dx - wx) * s, 6) + 0.0::DOUBLE AS p_x1, round((y1 + dy - wy) * s, 6) + 0.0::DOUBLE AS p_y1 FROM placed"""


def roi_zoom(spark, sf):
    d = chosen(spark, sf, 3)
    return d.select("frame", "n", *flat(boxes.roi(box(), FRAME_W, FRAME_H), "r_"), *flat(boxes.zoom(box(), FRAME_W, FRAME_H), "z_"))


_Z = lambda e, hi: f"round(greatest(0.0::DOUBLE, least({e}, {hi}::DOUBLE)), 6)"
ROI_ZOOM = f"""WITH {TOP3}, m AS (SELECT *, ceil(0.5::DOUBLE * greatest(x1 - x0, y1 - y0)) + 16 AS pad, greatest(x1 - x0, y1 - y0) * 0.45::DOUBLE AS z FROM top3)
SELECT frame, n, {_Z("floor(x0) - pad", 640)} AS r_x0, {_Z("floor(y0) - pad", 512)} AS r_y0, {_Z("ceil(x1) + pad", 640)} AS r_x1, {_Z("ceil(y1) + pad", 512)} AS r_y1,
  {_Z("x0 - z", 640)} AS z_x0, {_Z("y0 - z", 512)} AS z_y0, {_Z("x1 + z", 640)} AS z_x1, {_Z("y1 + z", 512)} AS z_y1 FROM m"""


def letterbox_roundtrip(spark, sf):
    """Boxes of frames of many shapes, into a letterboxed square and back."""
    d = detections(spark, sf)
    w, h = (F.col("frame") % 700 + 100).cast("double"), (F.col("ord.pk") % 500 + 80).cast("double")
    g = boxes.letterbox(w, h, 416)
    into = boxes.each_corner(box(), lambda x: x * F.col("g.sx") + F.col("g.left"), lambda y: y * F.col("g.sy") + F.col("g.top"))
    d = d.withColumn("g", g).withColumn("sq", into)
    back = boxes.undo_letterbox(F.col("sq"), F.col("g"))
    return d.select("frame", *ord_columns(d), F.round("g.sx", 9).alias("sx"), F.round("g.sy", 9).alias("sy"), "g.left", "g.top", *flat(F.col("sq"), "q_"), *flat(back, "b_"))


LETTERBOX = f"""WITH {DET}, s AS (SELECT *, (frame % 700 + 100)::DOUBLE AS w, (pk % 500 + 80)::DOUBLE AS h FROM det),
f AS (SELECT *, least(416::DOUBLE / w, 416::DOUBLE / h) AS fit FROM s), nn AS (SELECT *, greatest(floor(w * fit), 1::DOUBLE) AS nw, greatest(floor(h * fit), 1::DOUBLE) AS nh FROM f),
g AS (SELECT *, nw / w AS sx, nh / h AS sy, floor((416 - nw) / 2) AS "left", floor((416 - nh) / 2) AS top FROM nn),
q AS (SELECT *, x0 * sx + "left" AS a, y0 * sy + top AS b, x1 * sx + "left" AS c, y1 * sy + top AS d FROM g)
SELECT frame, ln, pk, sk, round(sx, 9) AS sx, round(sy, 9) AS sy, "left", top, round(a, 6) + 0.0::DOUBLE AS q_x0, round(b, 6) + 0.0::DOUBLE AS q_y0, round(c, 6) + 0.0::DOUBLE AS q_x1, round(d, 6) + 0.0::DOUBLE AS q_y1,
  round((a - "left") / sx, 6) + 0.0::DOUBLE AS b_x0, round((b - top) / sy, 6) + 0.0::DOUBLE AS b_y0, round((c - "left") / sx, 6) + 0.0::DOUBLE AS b_x1, round((d - top) / sy, 6) + 0.0::DOUBLE AS b_y1 FROM q"""


def nms_fold(spark, sf):
    d = ops.suppress(detections(spark, sf).withColumn("frame", F.col("frame") % 3000), 0.3, "frame")
    return d.select("frame", F.col("ord").cast("bigint").alias("rank"), *flat(box()), box()["score"].alias("score"), box()["label"].alias("label"))


NMS_FOLD = f"""WITH {DET}, lists AS (
  SELECT frame % 3000 AS frame, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': score, 'label': label}} ORDER BY score DESC, (x1 - x0) * (y1 - y0) DESC, ln, pk, sk) AS b FROM det GROUP BY frame % 3000
), kept AS (
  SELECT frame, list_reduce(list_transform(b, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: k.label = e[1].label AND
    greatest(0.0::DOUBLE, least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0)) * greatest(0.0::DOUBLE, least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0)) /
    ((k.x1 - k.x0) * (k.y1 - k.y0) + (e[1].x1 - e[1].x0) * (e[1].y1 - e[1].y0) - greatest(0.0::DOUBLE, least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0)) * greatest(0.0::DOUBLE, least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0))) > 0.3)) > 0
    THEN acc ELSE list_concat(acc, e) END) AS b FROM lists
)
SELECT frame, (i - 1)::BIGINT AS rank, b[i].x0 AS x0, b[i].y0 AS y0, b[i].x1 AS x1, b[i].y1 AS y1, b[i].score AS score, b[i].label AS label
FROM (SELECT frame, b, unnest(range(1, len(b) + 1)) AS i FROM kept)"""


def raw_predictions(spark, sf):
    d = detections(spark, sf)
    cx, cy = boxes.center(box())
    p = lambda k: ((F.col("ord.pk") * k + F.col("ord.sk")) % 100).cast("double") / 100
    return d.select(
        (F.col("frame") % 3000).alias("frame"), "ord", (cx * 0.65).alias("cx"), (cy * 0.65 + 41).alias("cy"), (boxes.width(box()) * 0.65).alias("w"), (boxes.height(box()) * 0.65).alias("h"),
        box()["score"].alias("obj"), F.array(p(3), p(7), p(11)).alias("cls"), F.lit(640.0).alias("frame_w"), F.lit(512.0).alias("frame_h"),
    )


def decode_predictions(spark, sf):
    d = ops.decode(raw_predictions(spark, sf), ["boat", "buoy", "bird"], ["boat", "bird"], 0.5, 0.45, 416, "frame")
    return d.select("frame", *flat(box(), digits=5), F.round(box()["score"], 6).alias("score"), box()["label"].alias("label"))


DECODE = f"""WITH {DET}, raw AS (
  SELECT frame % 3000 AS frame, ln, pk, sk, (x0 + x1) / 2 * 0.65::DOUBLE AS cx, (y0 + y1) / 2 * 0.65::DOUBLE + 41 AS cy, (x1 - x0) * 0.65::DOUBLE AS w, (y1 - y0) * 0.65::DOUBLE AS h,
         score AS obj, ((pk * 3 + sk) % 100)::DOUBLE / 100 AS p0, ((pk * 11 + sk) % 100)::DOUBLE / 100 AS p2 FROM det
), best AS (
  SELECT *, obj * greatest(p0, p2) AS sc, CASE WHEN p0 >= p2 THEN 'boat' ELSE 'bird' END AS label FROM raw
), geo AS (SELECT least(416::DOUBLE / 640, 416::DOUBLE / 512) AS fit), g AS (
  SELECT floor(640 * fit) / 640 AS sx, floor(512 * fit) / 512 AS sy, floor((416 - floor(640 * fit)) / 2) AS l, floor((416 - floor(512 * fit)) / 2) AS t FROM geo
), fr AS (
  SELECT frame, ln, pk, sk, sc, label, (cx - w / 2 - l) / sx AS x0, (cy - h / 2 - t) / sy AS y0, (cx + w / 2 - l) / sx AS x1, (cy + h / 2 - t) / sy AS y1 FROM best CROSS JOIN g WHERE sc > 0.5
), lists AS (
  SELECT frame, list({{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'score': sc, 'label': label}} ORDER BY sc DESC, (x1 - x0) * (y1 - y0) DESC, ln, pk, sk) AS b FROM fr GROUP BY frame
), kept AS (
  SELECT frame, list_reduce(list_transform(b, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda k: k.label = e[1].label AND
    greatest(0.0::DOUBLE, least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0)) * greatest(0.0::DOUBLE, least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0)) /
    ((k.x1 - k.x0) * (k.y1 - k.y0) + (e[1].x1 - e[1].x0) * (e[1].y1 - e[1].y0) - greatest(0.0::DOUBLE, least(k.x1, e[1].x1) - greatest(k.x0, e[1].x0)) * greatest(0.0::DOUBLE, least(k.y1, e[1].y1) - greatest(k.y0, e[1].y0))) > 0.45)) > 0
    THEN acc ELSE list_concat(acc, e) END) AS b FROM lists
), one AS (SELECT frame, unnest(b) AS e FROM kept), c AS (
  SELECT frame, greatest(0.0::DOUBLE, least(e.x0, 640::DOUBLE)) AS x0, greatest(0.0::DOUBLE, least(e.y0, 512::DOUBLE)) AS y0, greatest(0.0::DOUBLE, least(e.x1, 640::DOUBLE)) AS x1,
         greatest(0.0::DOUBLE, least(e.y1, 512::DOUBLE)) AS y1, e.score AS score, e.label AS label FROM one)
SELECT frame, round(x0, 5) + 0.0::DOUBLE AS x0, round(y0, 5) + 0.0::DOUBLE AS y0, round(x1, 5) + 0.0::DOUBLE AS x1, round(y1, 5) + 0.0::DOUBLE AS y1, round(score, 6) AS score, label FROM c WHERE NOT (x1 - x0 < 1 OR y1 - y0 < 1)"""


def single_batch_agreement(spark, sf):
    one = detections(spark, sf)
    moved = boxes.shifted(box(), F.when(F.col("ord.pk") % 17 == 0, F.lit(2.0)).otherwise(F.lit(0.25)), 0)
    relabelled = boxes.make(*[moved[c] for c in boxes.CORNERS], moved["score"], F.when(F.col("ord.sk") % 13 == 0, F.lit("x")).otherwise(moved["label"]))
    many = one.where(F.col("ord.pk") % 29 != 0).withColumn("box", relabelled)
    out = ops.agreement(one, many, "frame")
    return out.select("frame", F.col("ord.ln").alias("ln"), F.col("ord.pk").alias("pk"), F.col("ord.sk").alias("sk"), "problem")


AGREEMENT = f"""WITH {DET} SELECT frame, ln, pk, sk, CASE WHEN pk % 29 = 0 THEN 'count' WHEN sk % 13 = 0 THEN 'label' ELSE 'drift' END AS problem
FROM det WHERE pk % 29 = 0 OR sk % 13 = 0 OR pk % 17 = 0"""

QUERIES = {
    "crop_window": (crop_window, CROP_WINDOW),
    "box_geometry": (box_geometry, BOX_GEOMETRY),
    "box_clip_round": (box_clip_round, BOX_CLIP_ROUND),
    "box_iou_pairs": (box_iou_pairs, BOX_IOU_PAIRS),
    "finalize_boxes": (finalize_boxes, FINALIZE_BOXES),
    "select_topk": (select_topk, SELECT_TOPK),
    "patch_coords": (patch_coords, PATCH_COORDS),
    "roi_zoom": (roi_zoom, ROI_ZOOM),
    "letterbox_roundtrip": (letterbox_roundtrip, LETTERBOX),
    "nms_fold": (nms_fold, NMS_FOLD),
    "decode_predictions": (decode_predictions, DECODE),
    "single_batch_agreement": (single_batch_agreement, AGREEMENT),
}

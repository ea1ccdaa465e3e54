"""Queries over sampling, lookups, box files, drafts of pairs and their pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import boxes, draws, paths, pixels
from ..operators import composites, corruptions, lifecycle, ordering, rasters
from ..operators.augment import Augmenter, draft_column, pair_column
from ..operators.detectors import FunctionDetector
from ..session import shared_dir
from ..sources import boxes_json, images
from .geometry import chosen
from .imaging import synthetic_frames
from .indexing import FRAMES_SQL, IDX, example_index, render_frames
from .views import DET, FRAME_H, FRAME_W, PX, TOP3, account, account_sql, box, detections, flat, patches, table, uniform_sql

# -- order and sampling ------------------------------------------------------------------


def first_frames(spark, sf):
    """The first sixty of the sorted frames: a limit without a seed."""
    return ordering.pool_sample(render_frames(spark, sf).select("path"), limit=60)


FIRST = f"WITH {FRAMES_SQL} SELECT path, row_number() OVER (ORDER BY path) - 1 AS frame_ord FROM (SELECT DISTINCT path FROM fr ORDER BY path LIMIT 60)"


def shuffled_frames(spark, sf):
    return ordering.pool_sample(render_frames(spark, sf).select("path"), seed=4, shuffle=True)


SHUFFLED = f"WITH {FRAMES_SQL} SELECT path, row_number() OVER (ORDER BY md5('4:order:' || path), path) - 1 AS frame_ord FROM (SELECT DISTINCT path FROM fr)"


def wrapped_index(spark, sf):
    """Python's indices of 777 examples, negative ones from the end."""
    i = (F.col("event_id") % 1554 - 777).alias("i")
    return table(spark, sf, "events").select("event_id", i).select("event_id", "i", ordering.wrapped(F.col("i"), 777).alias("at"))


WRAPPED = "SELECT event_id, event_id % 1554 - 777 AS i, ((event_id % 1554 - 777) % 777 + 777) % 777 AS at FROM events"


def spread_indices(spark, sf):
    """Up to seven indices spread over as many examples as a part has size."""
    return table(spark, sf, "part").select("p_partkey", F.array_join(draws.spread_column(F.col("p_size"), 7).cast("array<string>"), ",").alias("at"))


SPREAD = "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(range(0, 7), lambda i: round_even(i * (p_size - 1) / 6.0::DOUBLE, 0)::BIGINT))), ',') AS at FROM part"


def stream_of_epochs(spark, sf):
    """Three epochs' orders one after another."""
    return ordering.epochs_order(example_index(spark, sf).examples, 5, 3)


STREAM = f"""WITH {IDX}, e AS (SELECT idx, epoch FROM ex CROSS JOIN (SELECT unnest(range(0, 3)) AS epoch)),
o AS (SELECT idx, epoch, row_number() OVER (PARTITION BY epoch ORDER BY md5('5:' || epoch || ':' || idx), idx) - 1 AS pos FROM e)
SELECT epoch * (SELECT count(*) FROM ex) + pos AS j, pos, epoch, idx FROM o"""


def pairing_real(spark, sf):
    """Hosts in turn, donors by a draw."""
    hosts, donors = table(spark, sf, "customer").count(), table(spark, sf, "part").count()
    return composites.pairing(spark, hosts, donors, 3, 2 * hosts + 5)


PAIRING_REAL = f"""WITH n AS (SELECT (SELECT count(*) FROM customer) AS h, (SELECT count(*) FROM part) AS d), r AS (SELECT unnest(range(0, 2 * h + 5)) AS i, h, d FROM n)
SELECT i, i % h AS host_idx, floor({uniform_sql("'3:' || i || ':donor'")} * d)::BIGINT AS donor_idx FROM r"""


def pairing_self(spark, sf):
    """Every donor in its own frame."""
    return composites.pairing(spark, 0, table(spark, sf, "part").count(), 3, 3000, into="self")


PAIRING_SELF = "SELECT i, i % (SELECT count(*) FROM part) AS host_idx, i % (SELECT count(*) FROM part) AS donor_idx FROM (SELECT unnest(range(0, 3000)) AS i)"


# -- names and box files -----------------------------------------------------------------


def name_forms(spark, sf):
    """Names as they are compared, and keys that are no frames."""
    d = table(spark, sf, "documents")
    name = F.concat(F.lit("  "), F.upper(F.coalesce("source", F.lit(""))), F.lit(" "))
    return d.select("doc_id", paths.normalised(name).alias("name"), paths.is_reserved(F.concat(F.when(F.col("doc_id") % 3 == 0, "__").otherwise("_"), F.col("source"))).alias("reserved"))


NAMES = "SELECT doc_id, lower(trim(coalesce(source, ''))) AS name, starts_with(CASE WHEN doc_id % 3 = 0 THEN '__' ELSE '_' END || source, '__') AS reserved FROM documents"


def resolved_paths(spark, sf):
    """Paths written in a roundabout way, and what they come to."""
    n = F.col("doc_id").cast("string")
    d = table(spark, sf, "documents")
    return d.select("doc_id", paths.resolved(F.concat(F.when(F.col("doc_id") % 2 == 0, "file:///").otherwise("/"), F.lit("pool/./a//b"), n, F.lit("/../../"), n, F.lit("/x/../f.png"))).alias("path"))


RESOLVED = "SELECT doc_id, '/pool/' || doc_id || '/f.png' AS path FROM documents"


def box_json_round_trip(spark, sf):
    """Boxes as JSON and back, in every other row in another spelling."""
    d = detections(spark, sf).withColumn("odd", F.col("ord.pk") % 2 == 1)
    plain = F.to_json(box())
    other = F.to_json(F.struct(F.array(*[box()[c] for c in boxes.CORNERS]).alias("bbox"), box()["score"].alias("confidence"), box()["label"].alias("class")))
    back = F.get(F.from_json(F.concat(F.lit("["), F.when(F.col("odd"), other).otherwise(plain), F.lit("]")), boxes_json.LOOSE), F.lit(0))
    out = d.withColumn("box", boxes.from_loose(back))
    return out.select("frame", F.col("ord.ln").alias("ln"), F.col("ord.pk").alias("pk"), F.col("ord.sk").alias("sk"), *flat(box()), F.round(box()["score"], 4).alias("score"), box()["label"].alias("label"))


BOX_JSON = f"WITH {DET} SELECT frame, ln, pk, sk, round(x0, 6) + 0.0 AS x0, round(y0, 6) + 0.0 AS y0, round(x1, 6) + 0.0 AS x1, round(y1, 6) + 0.0 AS y1, round(score, 4) AS score, label FROM det"


def _json_lines(spark, sf):
    rows = boxes_json.lines(example_index(spark, sf).by_path().withColumn("path", F.col("path").cast("string")))
    return rows.orderBy("ord").select(F.concat(F.lit('"'), "key", F.lit('": '), "value", F.lit(",")).alias("value"))


def json_index(spark, sf):
    """An index read back from its box file's lines, thresholds applied anew."""
    i = lifecycle.from_boxes(boxes_json.read_lines(_json_lines(spark, sf)), min_score=0.95, max_per_frame=2)
    return i.examples.select("idx", F.col("path").cast("bigint").alias("frame"), "n", *flat(box()))


_AGAIN = f"{IDX}, ag AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY n) - 1 AS m FROM ex WHERE score >= 0.95)"
JSON_INDEX = f"WITH {_AGAIN} SELECT row_number() OVER (ORDER BY frame, m) - 1 AS idx, frame, m AS n, x0, y0, x1, y1 FROM ag WHERE m < 2"


def index_life_cycle(spark, sf):
    """Examples and frames of an index as it is built, found again, found under other thresholds, and of a part of its frames."""
    path = f"{shared_dir(spark).rstrip('/')}/tilewright/life-cycle-{spark.sparkContext.applicationId}-{np.random.default_rng().integers(1 << 60)}"
    never = lambda: (_ for _ in ()).throw(AssertionError("built again"))
    some = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("path"))
    states = {
        "built": lifecycle.load_or_build(spark, path, lambda: example_index(spark, sf)),
        "found": lifecycle.load_or_build(spark, path, never),
        "stricter": lifecycle.load_or_build(spark, path, never, min_score=0.95, max_per_frame=2),
        "some frames": lifecycle.load_or_build(spark, path, never, keep=some),
    }
    out = None
    for name, i in states.items():
        row = i.examples.agg(F.count(F.lit(1)).alias("examples"), F.max("idx").alias("last")).join(F.broadcast(i.scanned.agg(F.count(F.lit(1)).alias("frames")))).withColumn("state", F.lit(name))  # a row each
        out = row if out is None else out.unionByName(row)
    return out


LIFE = f"""WITH {_AGAIN} SELECT 'built' AS state, count(*) AS examples, count(*) - 1 AS last, (SELECT count(*) FROM orders) AS frames FROM ex
UNION ALL SELECT 'found', count(*), count(*) - 1, (SELECT count(*) FROM orders) FROM ex
UNION ALL SELECT 'stricter', count(*), count(*) - 1, (SELECT count(*) FROM orders) FROM ag WHERE m < 2
UNION ALL SELECT 'some frames', count(*), count(*) - 1, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0) FROM ex WHERE frame % 3 = 0"""


# -- drafts and pairs --------------------------------------------------------------------

STILL = {"ops": [], "context": 0.16, "offset_frac": 0.0}  # no draws at all


def rect_of_box(spark, sf):
    """The rectangle of each best box, cut at its frame, and why some stay clean."""
    d = chosen(spark, sf, 1).select("frame", box())
    r = d.withColumn("d", draft_column(Augmenter(**STILL), box(), F.lit(FRAME_W), F.lit(FRAME_H // 4), F.col("frame")))
    return r.select("frame", *[(F.round(F.get("d.rect", F.lit(i)), 6) + F.lit(0.0)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "d.skipped")


_RECT = "least({w}, greatest(0, {a} {s} ({b} - {c}) * 0.08))"
RECT = f"""WITH {TOP3}, r AS (SELECT frame, {_RECT.format(w=FRAME_W, a="x0", s="-", b="x1", c="x0")} AS a, {_RECT.format(w=FRAME_H // 4, a="y0", s="-", b="y1", c="y0")} AS b,
  {_RECT.format(w=FRAME_W, a="x1", s="+", b="x1", c="x0")} AS c, {_RECT.format(w=FRAME_H // 4, a="y1", s="+", b="y1", c="y0")} AS d FROM top3 WHERE n < 1)
SELECT frame, round(a, 6) + 0.0 AS x0, round(b, 6) + 0.0 AS y0, round(c, 6) + 0.0 AS x1, round(d, 6) + 0.0 AS y1, CASE WHEN least(c - a, d - b) < 2 THEN 'degenerate rect' END AS skipped FROM r"""


def donor_patches(spark, sf):
    """What is cut of each donor, where it is large enough to be pasted."""
    d = chosen(spark, sf, 3).select("frame", "n", composites.donor_cut(box(), F.lit(FRAME_W), F.lit(FRAME_H // 4)).alias("box"))
    return d.where(boxes.short_side(box()) >= 4).select("frame", "n", *flat(box()))


_CUT = "least({w}, greatest(0, {a} {s} ({b} - {c}) * 0.15 / 2))"
DONORS = f"""WITH {TOP3}, c AS (SELECT frame, n, floor({_CUT.format(w=FRAME_W, a="x0", s="-", b="x1", c="x0")}) AS x0, floor({_CUT.format(w=FRAME_H // 4, a="y0", s="-", b="y1", c="y0")}) AS y0,
  ceil({_CUT.format(w=FRAME_W, a="x1", s="+", b="x1", c="x0")}) AS x1, ceil({_CUT.format(w=FRAME_H // 4, a="y1", s="+", b="y1", c="y0")}) AS y1 FROM top3)
SELECT frame, n, x0 + 0.0 AS x0, y0 + 0.0 AS y0, x1 + 0.0 AS x1, y1 + 0.0 AS y1 FROM c WHERE least(x1 - x0, y1 - y0) >= 4"""


def pair_without_ops(spark, sf):
    """Nothing changes, and the mask is the rectangle's whole pixels."""
    f = synthetic_frames(spark, sf)
    p = f.withColumn("pair", pair_column(Augmenter(**STILL), F.col("image"), box(), F.col("vec_id"), fields=("doctored", "mask", "skipped")))
    mask = F.col("pair.mask").cast("string")  # its bytes as they are
    rest = F.replace(mask, F.unhex(F.lit("0000803F")).cast("string"), F.lit(""))  # without the floats 1.0
    ones = ((F.octet_length(mask) - F.octet_length(rest)) / 4).cast("bigint")
    return p.select("vec_id", (F.col("pair.doctored") == F.col("image.data")).alias("same"), ones.alias("mask_px"), "pair.skipped")


NOTHING = "SELECT vec_id, true AS same, ((ceil(74 + vec_id % 40 + 3.52) - floor(30 + vec_id % 40 - 3.52)) * (ceil(62 + 2.56) - floor(30 - 2.56)))::BIGINT AS mask_px, NULL::VARCHAR AS skipped FROM embeddings"


def pasted_patch(spark, sf):
    """An even patch pasted into a frame: its value inside, the frame's own outside."""
    value = (F.col("vec_id") % 200 + 30).cast("int")
    patch = F.struct(F.lit(9).alias("height"), F.lit(14).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.repeat(F.lpad(F.hex(value), 2, "0"), 9 * 14)).alias("data"))
    f = synthetic_frames(spark, sf).withColumn("patch", patch)
    p = f.withColumn("pair", pair_column(Augmenter(**STILL), F.col("image"), box(), F.col("vec_id"), source=F.col("patch"), fields=("doctored",)))
    byte = lambda data, y, x: F.conv(F.hex(F.substring(data, F.lit(y * 128 + x + 1), F.lit(1))), 16, 10).cast("bigint")
    top = lambda data: F.md5(F.substring(data, F.lit(1), F.lit(27 * 128)))
    return p.select("vec_id", byte(F.col("pair.doctored"), 46, 72).alias("inside"), (top(F.col("pair.doctored")) == top(F.col("image.data"))).alias("outside_same"))


PASTED = "SELECT vec_id, vec_id % 200 + 30 AS inside, true AS outside_same FROM embeddings"


def failing_detector(spark, sf):
    """Frames at which a detector fails are told, and end nothing."""

    def moody(px, path):
        if int(path) % 7 == 0:
            raise ValueError(f"no mood for {path}")
        return [[10, 10, 40, 30, 0.5]]

    frames = synthetic_frames(spark, sf).select(F.col("vec_id").cast("string").alias("path"), F.col("vec_id").alias("frame_ord"), "image")
    made, failed = lifecycle.build(frames, FunctionDetector(moody))
    good = made.examples.select("path", F.lit(None).cast("string").alias("error"), "idx")
    return good.unionByName(failed.withColumn("idx", F.lit(-1).cast("bigint")))


FAILING = """SELECT vec_id::VARCHAR AS path, NULL::VARCHAR AS error, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings WHERE vec_id % 7 != 0
UNION ALL SELECT vec_id::VARCHAR, 'ValueError: no mood for ' || vec_id, -1 FROM embeddings WHERE vec_id % 7 = 0"""


# -- pixels ------------------------------------------------------------------------------


def _square(spark, sf, work):
    """patches() with out: work(8 x 8 pixels, vec_id) of each."""

    @F.pandas_udf("array<double>")
    def run(px: pd.Series, ids: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(work(np.array(p).reshape(8, 8), int(i)), np.float64).ravel() for p, i in zip(px, ids)])

    return patches(spark, sf).select("vec_id", run("px", "vec_id").alias("out"))


def _by_index(y: str, x: str) -> str:
    """A picture of the same size whose pixel (y, x) comes from another place, as SQL; i counts from 0."""
    return f"list_transform(range(0, 64), lambda i: px[({y}) * 8 + ({x}) + 1])"


_MIRROR = lambda v: f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > 7 THEN 14 - ({v}) ELSE {v} END)"


def area_shrink(spark, sf):
    """Half as large, by area."""
    return _square(spark, sf, lambda p, i: rasters.shrink(p, 4)).select("vec_id", *account(F.col("out"), digits=8))


SHRINK = f"""WITH {PX}, o AS (SELECT vec_id, list_transform(range(0, 16), lambda i: (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2] + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4) AS o FROM px)
SELECT vec_id, {account_sql("o", digits=8)} FROM o"""


def padded_window(spark, sf):
    """Windows that leave their frame, mirrored at its edge."""
    return _square(spark, sf, lambda p, i: rasters.cut(p, i % 5 - 2, i % 7 - 3, i % 5 + 6, i % 7 + 5)).select("vec_id", *account(F.col("out")), F.round(F.get("out", F.lit(9)), 6).alias("at_9"))


_WINDOW = _by_index(_MIRROR("(i // 8 + vec_id % 7 - 3)"), _MIRROR("(i % 8 + vec_id % 5 - 2)"))
PADDED = f"WITH {PX}, o AS (SELECT vec_id, {_WINDOW} AS o FROM px) SELECT vec_id, {account_sql('o')}, round(o[10], 6) AS at_9 FROM o"


def warp_by_whole_pixels(spark, sf):
    """Content moved by whole pixels, mirrored where nothing came from."""

    def moved(p, i):
        return rasters.warp(p, corruptions.affine(aside=(i % 5 - 2, i % 7 - 3)), (8, 8)).astype(np.float64)

    return _square(spark, sf, moved).select("vec_id", *account(F.col("out"), digits=4), F.round(F.get("out", F.lit(9)), 4).alias("at_9"))


_MOVED = _by_index(_MIRROR("(i // 8 - (vec_id % 7 - 3))"), _MIRROR("(i % 8 - (vec_id % 5 - 2))"))
MOVED = f"WITH {PX}, o AS (SELECT vec_id, list_transform({_MOVED}, lambda x: x::FLOAT::DOUBLE) AS o FROM px) SELECT vec_id, {account_sql('o', digits=4)}, round(o[10], 4) AS at_9 FROM o"


def blurred(spark, sf):
    """A Gaussian blur, mirrored at the edge."""
    return _square(spark, sf, lambda p, i: corruptions.gaussian(p, 0.8)).select("vec_id", *account(F.col("out"), digits=4), F.round(F.get("out", F.lit(9)), 4).alias("at_9"))


_TAPS = np.exp(-(np.arange(-2, 3) ** 2) / (2 * 0.8 * 0.8))
_TAPS = (_TAPS / _TAPS.sum()).astype(np.float32)


def _blur_sql() -> str:
    terms = [f"{float(a) * float(b)!r}::DOUBLE * px[{_MIRROR(f'(i // 8 + {y})')} * 8 + {_MIRROR(f'(i % 8 + {x})')} + 1]" for y, a in enumerate(_TAPS, -2) for x, b in enumerate(_TAPS, -2)]
    return f"list_transform(range(0, 64), lambda i: {' + '.join(terms)})"


BLURRED = f"WITH {PX}, o AS (SELECT vec_id, {_blur_sql()} AS o FROM px) SELECT vec_id, {account_sql('o', digits=4)}, round(o[10], 4) AS at_9 FROM o"


def png_round_trip(spark, sf):
    """Pictures written as PNG and decoded."""
    return _square(spark, sf, lambda p, i: images.decode(images.encode_png(rasters.from_float01(p.astype(np.float64), np.uint8)))).select("vec_id", *account(F.col("out")), F.get("out", F.lit(9)).alias("at_9"))


PNG = f"WITH {PX}, o AS (SELECT vec_id, list_transform(px, lambda x: round_even(x * 255, 0)) AS o FROM px) SELECT vec_id, {account_sql('o')}, o[10] AS at_9 FROM o"


def luma_of_rgb(spark, sf):
    """Gray of the picture, its mirror image and its negative as three channels."""

    def gray(p, i):
        u8 = rasters.from_float01(p.astype(np.float64), np.uint8)
        return rasters.luma(np.stack([u8, u8[:, ::-1], 255 - u8], axis=2))

    return _square(spark, sf, gray).select("vec_id", *account(F.col("out")))


LUMA = f"""WITH {PX}, u AS (SELECT vec_id, list_transform(px, lambda x: round_even(x * 255, 0)::BIGINT) AS u FROM px),
o AS (SELECT vec_id, list_transform(range(0, 64), lambda i: ((u[i + 1] * 19595 + u[(i // 8) * 8 + 8 - i % 8] * 38470 + (255 - u[i + 1]) * 7471 + 32768) >> 16)::DOUBLE) AS o FROM u)
SELECT vec_id, {account_sql("o")} FROM o"""


def channels_to_gray(spark, sf):
    """A patch of three channels taken into a gray picture: their mean."""

    def mean(p, i):
        return rasters.like_channels(np.stack([p, p / 2, np.zeros_like(p)], axis=2), p)

    return _square(spark, sf, mean).select("vec_id", *account(F.col("out"), digits=8))


GRAY = f"WITH {PX}, o AS (SELECT vec_id, list_transform(px, lambda x: (x + x / 2) / 3) AS o FROM px) SELECT vec_id, {account_sql('o', digits=8)} FROM o"


def flat_patches(spark, sf):
    """Every third patch has next to no contrast."""
    px = F.transform("px", lambda x: F.when(F.col("vec_id") % 3 == 0, x / 1000).otherwise(x))
    return patches(spark, sf).select("vec_id", pixels.is_flat(px).alias("flat"))


FLAT = f"WITH {PX} SELECT vec_id, list_stddev_pop(list_transform(px, lambda x: CASE WHEN vec_id % 3 = 0 THEN x / 1000 ELSE x END)) < 1e-3 AS flat FROM px"


QUERIES = {
    "first_frames": (first_frames, FIRST),
    "shuffled_frames": (shuffled_frames, SHUFFLED),
    "wrapped_index": (wrapped_index, WRAPPED),
    "spread_indices": (spread_indices, SPREAD),
    "stream_of_epochs": (stream_of_epochs, STREAM),
    "pairing_real": (pairing_real, PAIRING_REAL),
    "pairing_self": (pairing_self, PAIRING_SELF),
    "name_forms": (name_forms, NAMES),
    "resolved_paths": (resolved_paths, RESOLVED),
    "box_json_round_trip": (box_json_round_trip, BOX_JSON),
    "json_index": (json_index, JSON_INDEX),
    "index_life_cycle": (index_life_cycle, LIFE),
    "rect_of_box": (rect_of_box, RECT),
    "donor_patches": (donor_patches, DONORS),
    "pair_without_ops": (pair_without_ops, NOTHING),
    "pasted_patch": (pasted_patch, PASTED),
    "failing_detector": (failing_detector, FAILING),
    "area_shrink": (area_shrink, SHRINK),
    "padded_window": (padded_window, PADDED),
    "warp_by_whole_pixels": (warp_by_whole_pixels, MOVED),
    "blurred": (blurred, BLURRED),
    "png_round_trip": (png_round_trip, PNG),
    "luma_of_rgb": (luma_of_rgb, LUMA),
    "channels_to_gray": (channels_to_gray, GRAY),
    "flat_patches": (flat_patches, FLAT),
}

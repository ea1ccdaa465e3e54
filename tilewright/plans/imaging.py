"""Queries over pixels, maps and seeded generation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from ..functions import boxes, draws, pixels
from ..operators import rasters
from ..operators.augment import Augmenter, pair_column, parts
from ..operators.composites import placed
from ..session import in_small_batches
from .geometry import chosen
from .views import FRAME_H, FRAME_W, PX, TOP3, account, account_sql, box, flat, patches, table, uniform_sql


def px():
    return F.col("px")


def float01_roundtrip(spark, sf):
    p = patches(spark, sf).withColumn("u8", pixels.from_float01(px(), "uint8")).withColumn("u16", pixels.from_float01(px(), "uint16"))
    back = pixels.to_float01(F.col("u8"), "uint8")
    return p.select("vec_id", *account(F.col("u8"), "u8_"), *account(F.col("u16"), "u16_"), F.round(F.array_max(pixels.difference(back, px())), 6).alias("drift"))


FLOAT01 = f"""WITH {PX}, u AS (SELECT vec_id, px, list_transform(px, lambda x: round_even(x * 255, 0)) AS u8, list_transform(px, lambda x: round_even(x * 65535, 0)) AS u16 FROM px)
SELECT vec_id, {account_sql("u8", "u8_")}, {account_sql("u16", "u16_")}, round(list_max(list_transform(range(1, len(px) + 1), lambda i: abs(u8[i] / 255 - px[i]))), 6) AS drift FROM u"""


def uint8_stretch(spark, sf):
    p = patches(spark, sf).withColumn("s", pixels.stretched_uint8(F.transform(px(), lambda x: x * 1000)))
    rgb = pixels.gray_to_rgb(F.col("s"))
    return p.select("vec_id", F.aggregate("s", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_max("s").alias("high"), F.size(rgb).alias("values"), F.get(rgb, F.lit(100)).alias("at_100"))


STRETCH8 = f"""WITH {PX}, k AS (SELECT vec_id, list_transform(px, lambda x: x * 1000) AS p FROM px), l AS (SELECT vec_id, p, list_min(p) AS lo, list_max(p) AS hi FROM k),
s AS (SELECT vec_id, list_transform(p, lambda x: CASE WHEN hi <= lo THEN 0 ELSE floor((x - lo) / (hi - lo) * 255)::INTEGER END) AS s FROM l)
SELECT vec_id, list_sum(s)::BIGINT AS total, list_max(s) AS high, (len(s) * 3)::INTEGER AS "values", s[34] AS at_100 FROM s"""


def photometric_chain(spark, sf):
    """Gain, level and gamma with drawn magnitudes, clipped at the end."""
    i = F.col("vec_id")
    p = patches(spark, sf).withColumn("g", draws.between(0.85, 1.18, 7, i, "gain")).withColumn("d", draws.between(-0.05, 0.05, 7, i, "level")).withColumn("y", draws.between(0.85, 1.2, 7, i, "gamma"))
    out = pixels.clipped(pixels.gamma(pixels.level(pixels.gain(px(), F.col("g")), F.col("d")), F.col("y")))
    return p.withColumn("out", out).select("vec_id", *account(F.col("out")), F.round("g", 9).alias("gain"), F.round("d", 9).alias("level"), F.round("y", 9).alias("gamma"))


def _draw(lo: float, hi: float, what: str, seed: int = 7, i: str = "vec_id") -> str:
    key = f"'{seed}:' || {i} || ':{what}'"
    return f"({lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * {uniform_sql(key)})"


PHOTOMETRIC = f"""WITH {PX}, m AS (SELECT vec_id, px, {_draw(0.85, 1.18, "gain")} AS g, {_draw(-0.05, 0.05, "level")} AS d, {_draw(0.85, 1.2, "gamma")} AS y FROM px),
o AS (SELECT vec_id, g, d, y, list_transform(px, lambda x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, pow(greatest(0.0::DOUBLE, least(1.0::DOUBLE, x * g + d)), y)))) AS o FROM m)
SELECT vec_id, {account_sql("o")}, round(g, 9) AS gain, round(d, 9) AS level, round(y, 9) AS gamma FROM o"""


def matrix_compose(spark, sf):
    """Shift, then rotation, then rescaling about a box's center, as one map applied to a corner."""
    d = chosen(spark, sf, 1)
    i, (cx, cy) = F.col("frame"), boxes.center(box())
    m = pixels.shift_map(draws.between(-8, 8, 7, i, "dx"), draws.between(-8, 8, 7, i, "dy"))
    d = d.withColumn("m", m).withColumn("r", pixels.rotate_map(draws.between(-6, 6, 7, i, "deg"), cx, cy)).withColumn("s", pixels.rescale_map(draws.between(0.92, 1.08, 7, i, "s"), draws.between(0.92, 1.08, 7, i, "s"), cx, cy))
    d = d.withColumn("all", pixels.after(F.col("s"), pixels.after(F.col("r"), F.col("m"))))
    a = lambda n: F.col(f"all.{n}")
    x, y = box()["x_min"], box()["y_min"]
    return d.select("frame", *[(F.round(a(n), 6) + F.lit(0.0)).alias(n) for n in "abcdef"], (F.round(a("a") * x + a("b") * y + a("c"), 4) + F.lit(0.0)).alias("x"), (F.round(a("d") * x + a("e") * y + a("f"), 4) + F.lit(0.0)).alias("y"))


MATRIX = f"""WITH {TOP3}, p AS (SELECT frame, x0, y0, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, {_draw(-8, 8, "dx", i="frame")} AS dx, {_draw(-8, 8, "dy", i="frame")} AS dy, radians({_draw(-6, 6, "deg", i="frame")}) AS t, {_draw(0.92, 1.08, "s", i="frame")} AS s FROM top3 WHERE n < 1),
c AS (SELECT *, s * cos(t) AS a, -s * sin(t) AS b, s * sin(t) AS d, s * cos(t) AS e, cx - (cos(t) * cx - sin(t) * cy) AS rc, cy - (sin(t) * cx + cos(t) * cy) AS rf FROM p),
m AS (SELECT *, s * (cos(t) * dx - sin(t) * dy + rc) + cx - s * cx AS c, s * (sin(t) * dx + cos(t) * dy + rf) + cy - s * cy AS f FROM c)
SELECT frame, round(a, 6) + 0.0::DOUBLE AS a, round(b, 6) + 0.0::DOUBLE AS b, round(c, 6) + 0.0::DOUBLE AS c, round(d, 6) + 0.0::DOUBLE AS d, round(e, 6) + 0.0::DOUBLE AS e, round(f, 6) + 0.0::DOUBLE AS f,
  round(a * x0 + b * y0 + c, 4) + 0.0::DOUBLE AS x, round(d * x0 + e * y0 + f, 4) + 0.0::DOUBLE AS y FROM m"""


def rect_of(i, base: int = 8):
    """A whole-pixel rectangle of an 8 x 8 patch, by its id."""
    return F.array(i % 4, i % 3, i % 4 + 2 + i % 3, i % 3 + 2 + i % 4)


_RECT = "vec_id % 4 AS rx0, vec_id % 3 AS ry0, vec_id % 4 + 2 + vec_id % 3 AS rx1, vec_id % 3 + 2 + vec_id % 4 AS ry1"
_MASK = "list_transform(range(64), lambda i: CASE WHEN i % 8 >= rx0 AND i % 8 < rx1 AND i // 8 >= ry0 AND i // 8 < ry1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"


def masked(spark, sf):
    return patches(spark, sf).withColumn("mask", pixels.hard_mask(rect_of(F.col("vec_id")), 8, 8))


def alpha_blend(spark, sf):
    """The patch with its own brighter copy inside a rectangle; outside nothing changes."""
    p = masked(spark, sf).withColumn("out", pixels.blend(px(), pixels.level(px(), F.lit(0.25)), F.col("mask"))).withColumn("diff", pixels.difference(F.col("out"), px()))
    outside = F.aggregate(F.zip_with("diff", "mask", lambda d, m: d * (1 - m)), F.lit(0.0), lambda a, x: a + x)
    return p.select("vec_id", *account(F.col("out")), F.round(F.array_max("diff"), 6).alias("change"), outside.alias("outside"))


BLEND = f"""WITH {PX}, r AS (SELECT vec_id, px, {_RECT} FROM px), m AS (SELECT vec_id, px, {_MASK} AS m FROM r),
o AS (SELECT vec_id, px, list_transform(range(1, 65), lambda i: px[i] * (1 - m[i]) + greatest(0.0::DOUBLE, least(1.0::DOUBLE, px[i] + 0.25)) * m[i]) AS o FROM m)
SELECT vec_id, {account_sql("o")}, round(list_max(list_transform(range(1, 65), lambda i: abs(o[i] - px[i]))), 6) AS change, 0.0::DOUBLE AS outside FROM o"""


def mask_bbox(spark, sf):
    p = masked(spark, sf)
    b = pixels.mask_bounds(F.col("mask"), 8)
    return p.select("vec_id", *[F.get(b, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], F.round(pixels.mask_share(F.col("mask")), 6).alias("share"))


MASK_BBOX = """SELECT vec_id, vec_id % 4 AS x0, vec_id % 3 AS y0, least(8, vec_id % 4 + 2 + vec_id % 3) AS x1, least(8, vec_id % 3 + 2 + vec_id % 4) AS y1,
  round((least(8, vec_id % 4 + 2 + vec_id % 3) - vec_id % 4) * (least(8, vec_id % 3 + 2 + vec_id % 4) - vec_id % 3)::DOUBLE / 64, 6) AS share FROM embeddings"""


def stretch_percentile(spark, sf):
    p = patches(spark, sf).withColumn("s", pixels.stretched(px()))
    return p.select("vec_id", *account(F.col("s")))


STRETCH = f"""WITH {PX}, q AS (SELECT vec_id, quantile_cont(x, 0.01) AS lo, quantile_cont(x, 0.995) AS hi FROM (SELECT vec_id, unnest(px) AS x FROM px) GROUP BY vec_id),
s AS (SELECT px.vec_id, list_transform(px, lambda x: CASE WHEN hi > lo THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x - lo) / (hi - lo))) ELSE 0.0::DOUBLE END) AS s FROM px JOIN q ON px.vec_id = q.vec_id)
SELECT vec_id, {account_sql("s")} FROM s"""


def level_match_stats(spark, sf):
    """A patch matched to its square inside a rectangle."""
    p = masked(spark, sf).withColumn("host", F.transform(px(), lambda x: x * x)).withColumn("m", pixels.level_match(px(), F.col("host"), F.col("mask")))
    return p.select("vec_id", F.round("m.gain", 6).alias("gain"), F.round("m.bias", 6).alias("bias"), F.round(pixels.deviation(px()), 6).alias("deviation"), pixels.is_flat(px()).alias("flat"))


LEVEL_MATCH = f"""WITH {PX}, r AS (SELECT vec_id, px, {_RECT} FROM px), m AS (SELECT vec_id, px, {_MASK} AS m FROM r), e AS (SELECT vec_id, unnest(px) AS x, unnest(m) AS a FROM m),
s AS (SELECT vec_id, count(*) FILTER (a > 0.5) AS n, avg(x) FILTER (a > 0.5) AS dm, stddev_pop(x) FILTER (a > 0.5) AS ds, avg(x * x) FILTER (a > 0.5) AS hm, stddev_pop(x * x) FILTER (a > 0.5) AS hs, stddev_pop(x) AS dev FROM e GROUP BY vec_id),
g AS (SELECT *, CASE WHEN n < 8 OR ds <= 1e-3 THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, least(5.0::DOUBLE, hs / ds)) END AS gain FROM s)
SELECT vec_id, round(gain, 6) AS gain, CASE WHEN n < 8 THEN 0.0::DOUBLE ELSE round(hm - gain * dm, 6) END AS bias, round(dev, 6) AS deviation, dev < 1e-3 AS flat FROM g"""


def tensor_planes(spark, sf):
    """Four interleaved channels of 16 pixels to planes about zero."""
    p = patches(spark, sf).withColumn("u8", pixels.from_float01(px(), "uint8")).withColumn("t", pixels.normalised(pixels.to_chw(F.col("u8"), 4), "uint8"))
    return p.select("vec_id", *account(F.slice("t", 1, 16), "first_"), *account(F.slice("t", 49, 16), "last_"))


_PLANE = lambda c: f"list_transform(range(16), lambda i: round_even(px[i * 4 + {c + 1}] * 255, 0) / 127.5::DOUBLE - 1)"
PLANES = f"WITH {PX}, t AS (SELECT vec_id, {_PLANE(0)} AS a, {_PLANE(3)} AS b FROM px) SELECT vec_id, {account_sql('a', 'first_')}, {account_sql('b', 'last_')} FROM t"


def _placement(spark, sf, how: str):
    d = chosen(spark, sf, 1)
    donor_w, donor_h = (F.col("frame") % 90 + 10).cast("double"), (F.col("frame") % 40 + 10).cast("double")
    return d.select("frame", *flat(placed(how, 9, F.col("frame"), box(), FRAME_W, FRAME_H, donor_w, donor_h), digits=5))


def placement_detection(spark, sf):
    return _placement(spark, sf, "detection")


def placement_lower(spark, sf):
    return _placement(spark, sf, "lower")


_DONOR = f"SELECT *, (frame % 90 + 10)::DOUBLE AS dw, (frame % 40 + 10)::DOUBLE AS dh, {_draw(0.9, 1.1, 'scale', 9, 'frame')} AS s FROM top3 WHERE n < 1"
_CORNERS = "round(cx - w / 2, 5) + 0.0::DOUBLE AS x0, round(cy - h / 2, 5) + 0.0::DOUBLE AS y0, round(cx + w / 2, 5) + 0.0::DOUBLE AS x1, round(cy + h / 2, 5) + 0.0::DOUBLE AS y1"
PLACE_DETECTION = f"WITH {TOP3}, d AS ({_DONOR}), p AS (SELECT frame, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy, (y1 - y0) * s AS h, (y1 - y0) * s * dw / greatest(dh, 1) AS w FROM d) SELECT frame, {_CORNERS} FROM p"
PLACE_LOWER = f"WITH {TOP3}, d AS ({_DONOR}), p AS (SELECT frame, {_draw(0.2, 0.8, 'x', 9, 'frame')} * 640 AS cx, {_draw(0.55, 0.85, 'y', 9, 'frame')} * 512 AS cy, dh * s AS h, dw * s AS w FROM d) SELECT frame, {_CORNERS} FROM p"


def params_flatten(spark, sf):
    """Numbers of nested parameters as one row each: event properties as op parameters."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "map<string,double>").alias("p"))
    return e.select("event_id", F.explode("p").alias("k", "v"), "event_type").select("event_id", F.concat_ws("/", "event_type", "k").alias("key"), F.round("v", 6).alias("value")).where("value is not null")


PARAMS = "SELECT event_id, event_type || '/' || k AS key, round(v, 6) AS value FROM (SELECT event_id, event_type, unnest(json_keys(props)) AS k, unnest(list_transform(json_keys(props), lambda x: (props->>x)::DOUBLE)) AS v FROM events) WHERE v IS NOT NULL"


def repeated_op_names(spark, sf):
    """An op that a user's events repeat is numbered: view, view#2, ..."""
    from pyspark.sql import Window

    e = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return e.select("user_id", "event_id", F.when(n == 1, F.col("event_type")).otherwise(F.concat_ws("#", "event_type", n)).alias("key"))


REPEATED = """SELECT user_id, event_id, CASE WHEN n = 1 THEN event_type ELSE event_type || '#' || n END AS key
FROM (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events)"""


def seed_sequence(spark, sf):
    """Seeds of the examples in two epochs, and of composites."""
    ex = table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"))
    return ex.select("idx", draws.example_seed(1, 0, F.col("idx")).alias("seed_0"), draws.example_seed(1, 1, F.col("idx")).alias("seed_1"), draws.composite_seed(1, F.col("idx")).alias("composite"))


def _seeds_sql() -> str:
    """The first word of numpy's SeedSequence for (1, 0, k), (1, 1, k) and (1, COMPOSITE_STREAM, k), k below 2^32, step by step in 32-bit arithmetic."""
    cut = lambda x: f"(({x}) & 4294967295)"
    fold = lambda x: f"xor({x}, {x} >> 16)"
    steps, columns, name = ["SELECT o_orderkey AS idx, o_orderkey::UBIGINT AS k FROM orders"], ["idx", "k"], 0

    def let(expression: str) -> str:
        nonlocal name
        name += 1
        steps.append(f"SELECT *, {expression} AS v{name} FROM ({steps.pop()})")
        return f"v{name}"

    out = []
    for stream in ("0", "1", str(draws.COMPOSITE_STREAM)):
        factor = 0x43B0D7E5

        def stirred(x: str) -> str:
            nonlocal factor
            low = f"xor({x}::UBIGINT, {factor}::UBIGINT)"
            factor = factor * 0x931E8875 & 0xFFFFFFFF
            return let(fold(let(cut(f"{let(low)} * {factor}::UBIGINT"))))

        def mixed(x: str, y: str) -> str:
            return let(fold(let(cut(f"{let(cut(f'{x} * 3389127133::UBIGINT'))} + 4294967296::UBIGINT - {let(cut(f'{y} * 1232336661::UBIGINT'))}"))))

        pool = [stirred(w) for w in ("1", stream, "k", "0")]
        for i in range(4):
            for j in range(4):
                if i != j:
                    pool[j] = mixed(pool[j], stirred(pool[i]))
        first = let(f"xor({pool[0]}, {0x8B51F9DD}::UBIGINT)")
        out.append(let(fold(let(cut(f"{first} * {0x8B51F9DD * 0x58F38DED & 0xFFFFFFFF}::UBIGINT")))))
    names = ("seed_0", "seed_1", "composite")
    return f"SELECT idx, {', '.join(f'{v}::BIGINT AS {n}' for v, n in zip(out, names))} FROM ({steps.pop()})"


SEEDS = _seeds_sql()


# -- not expressible in SQL: numpy's generators ------------------------------------------


def synthetic_frames(spark, sf, **drawn):
    """Frames made up from the embeddings' ids: vec_id, image, box; and columns drawn from the ids, beneath the images, which would wait for a draw in thousands."""
    in_small_batches(spark)  # the session given, which need not be the active one

    @F.pandas_udf("height int, width int, nChannels int, data binary")
    def frame(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for ids in batches:
            made = ((96, 128, 1, rasters.synthetic_frame(96, 128, int(i)).tobytes()) for i in ids)
            for part in parts(made, lambda r: len(r[3])):
                yield pd.DataFrame(part, columns=["height", "width", "nChannels", "data"])

    e = table(spark, sf, "embeddings").select("vec_id")
    at = (F.col("vec_id") % 40).cast("double")
    return e.select("vec_id", *[c.alias(n) for n, c in drawn.items()], frame("vec_id").alias("image"), boxes.make(30 + at, F.lit(30.0), 74 + at, F.lit(62.0)).alias("box"))


def augment_pairs(spark, sf):
    """The whole recipe, with what must hold of each pair."""
    f = synthetic_frames(spark, sf, seed=draws.example_seed(3, 0, F.col("vec_id")))
    p = f.withColumn("pair", pair_column(Augmenter(), F.col("image"), F.col("box"), F.col("seed"), fields=("clean", "doctored", "params")))
    return p.select("vec_id", "seed", F.md5("pair.clean").alias("clean"), F.md5("pair.doctored").alias("doctored"), "pair.params", (F.md5("pair.clean") == F.md5("image.data")).alias("clean_is_input"))


def blur_noise_stripe(spark, sf):
    """Only the ops that need neighbours or noise."""
    ops = {"blur": {"sigma": (0.5, 1.2), "p": 1.0}, "noise": {}, "stripe": {"p": 1.0, "axis": "both"}}
    f = synthetic_frames(spark, sf, seed=draws.example_seed(4, 0, F.col("vec_id")))
    p = f.withColumn("pair", pair_column(Augmenter(ops), F.col("image"), F.col("box"), F.col("seed"), fields=("doctored", "params")))
    return p.select("vec_id", F.md5("pair.doctored").alias("doctored"), "pair.params")


QUERIES = {
    "float01_roundtrip": (float01_roundtrip, FLOAT01),
    "uint8_stretch": (uint8_stretch, STRETCH8),
    "photometric_chain": (photometric_chain, PHOTOMETRIC),
    "matrix_compose": (matrix_compose, MATRIX),
    "alpha_blend": (alpha_blend, BLEND),
    "mask_bbox": (mask_bbox, MASK_BBOX),
    "stretch_percentile": (stretch_percentile, STRETCH),
    "level_match_stats": (level_match_stats, LEVEL_MATCH),
    "tensor_planes": (tensor_planes, PLANES),
    "placement_detection": (placement_detection, PLACE_DETECTION),
    "placement_lower": (placement_lower, PLACE_LOWER),
    "params_flatten": (params_flatten, PARAMS),
    "repeated_op_names": (repeated_op_names, REPEATED),
    "seed_sequence": (seed_sequence, SEEDS),
    "augment_pairs": (augment_pairs, None),
    "blur_noise_stripe": (blur_noise_stripe, None),
}

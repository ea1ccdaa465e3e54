import json
import math

import pytest
from pyspark.sql import functions as F

from tilewright.functions import boxes, draws, paths, pixels
from tilewright.schema import BOX


def one(spark, *cols, **boxes_):
    """The value of expressions over named boxes."""
    df = spark.createDataFrame([tuple(boxes_.values())], ", ".join(f"{n} {BOX}" for n in boxes_)) if boxes_ else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def corners(r):
    return tuple(r)[:4]


def test_geometry(spark):
    b = F.col("b")
    r = one(spark, boxes.area(b), boxes.expanded(b, 0.2), boxes.clipped(b, 15, 12), boxes.rounded(b), boxes.as_int(b), boxes.shifted(b, -1, 2), boxes.scaled(b, 2), b=(0.5, 1.5, 10.5, 21.5, 0.7, "x"))
    assert r.c0 == 200 and corners(r.c1) == (-0.5, -0.5, 11.5, 23.5) and corners(r.c2) == (0.5, 1.5, 10.5, 12)
    assert corners(r.c3) == (0, 1, 11, 22) and r.c4 == [0, 1, 11, 22] and corners(r.c5) == (-0.5, 3.5, 9.5, 23.5) and corners(r.c6) == (1, 3, 21, 43)
    assert (r.c1.score, r.c1.label) == (0.7, "x")


def test_inverted_and_nan_boxes(spark):
    b, n = F.col("b"), F.col("n")
    r = one(spark, boxes.area(b), boxes.iou(b, b), boxes.clipped(n, 10, 10), boxes.finite(n), boxes.finite(b), b=(5.0, 5.0, 1.0, 9.0, 1.0, "x"), n=(math.nan, 0.0, 5.0, 5.0, 1.0, "x"))
    assert r.c0 == 0 and r.c1 == 0 and math.isnan(r.c2.x_min) and not r.c3 and r.c4


def test_iou(spark):
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    r = one(spark, boxes.iou(a, b), boxes.iou(a, a), boxes.iou(a, c), a=(0.0, 0.0, 2.0, 2.0, 1.0, "x"), b=(1.0, 1.0, 3.0, 3.0, 1.0, "x"), c=(9.0, 9.0, 10.0, 10.0, 1.0, "x"))
    assert r.c0 == pytest.approx(1 / 7) and r.c1 == 1 and r.c2 == 0


@pytest.mark.parametrize(("box", "x0", "side"), [((139, 124, 183, 140), 33, 256), ((10, 10, 310, 230), -12, 345), ((0, 0, 1, 1), -128, 256), ((1, 0, 2, 1), -126, 256)])
def test_windows_round_half_to_even(spark, box, x0, side):
    b, w = F.col("b"), boxes.window(F.col("b"))
    r = one(spark, w, boxes.window_scale(w), boxes.in_patch(b, w, boxes.window_scale(w)), b=(*map(float, box), 1.0, "x"))
    assert (r.c0.x_min, r.c0.x_max - r.c0.x_min) == (x0, side)
    assert r.c1 == (1.0 if side == 256 else 256 / side)
    assert r.c2.x_min == pytest.approx((box[0] - x0) * r.c1)


def test_spellings_of_boxes(spark):
    from tilewright.sources.boxes_json import LOOSE

    text = json.dumps([{"x_min": 1, "y_min": 2, "x_max": 3, "y_max": 4}, {"bbox": [1, 2, 3, 4], "confidence": 0.5, "class": "boat"}, {"x0": 1, "y0": 2, "x1": 3, "y1": 4, "score": 0.25, "label": "l"}])
    df = spark.createDataFrame([(text,)], "t string").select(F.explode(F.from_json("t", LOOSE)).alias("d"))
    got = [tuple(r.b) for r in df.select(boxes.from_loose(F.col("d")).alias("b")).collect()]
    assert got == [(1, 2, 3, 4, 1.0, "ship"), (1, 2, 3, 4, 0.5, "boat"), (1, 2, 3, 4, 0.25, "l")]


def test_arrays_as_boxes(spark):
    assert tuple(one(spark, boxes.from_array(F.array(*map(F.lit, (1.0, 2.0, 3.0, 4.0, 0.5))))).c0) == (1, 2, 3, 4, 0.5, "ship")
    with pytest.raises(Exception, match="four numbers"):
        one(spark, boxes.from_array(F.array(F.lit(1.0))))


def test_paths(spark):
    df = spark.createDataFrame([("/a/images/b/images/s1/lwir/f.0.PNG",), (".hidden",), ("/x/images/y.png",), ("f.tar.gz",)], "p string")
    p = F.col("p")
    got = df.select(paths.stem(p).alias("s"), paths.suffix(p).alias("x"), paths.is_image(p).alias("i"), paths.render_parts(p).alias("r")).collect()
    assert [(r.s, r.x, r.i) for r in got] == [("f.0", ".PNG", True), (".hidden", "", False), ("y", ".png", True), ("f.tar", ".gz", False)]
    assert tuple(got[0].r) == ("b", "s1", "lwir", "f.0") and got[1].r is None and got[2].r is None


def test_seeds_do_not_depend_on_partitions(spark):
    ids = spark.range(200).withColumnRenamed("id", "i")
    a = {r.i: r.s for r in ids.repartition(7).select("i", draws.example_seed(3, 1, F.col("i")).alias("s")).collect()}
    assert a == {i: draws.seed_words(3, 1, i) for i in range(200)}
    assert draws.spread(10, 4) == [0, 3, 6, 9] and draws.spread(2, 5) == [0, 1] and draws.spread(0, 3) == []


def test_pixel_round_trip(spark):
    px = F.array(*[F.lit(float(v)) for v in (0, 1, 127, 254, 255)])
    r = one(spark, pixels.from_float01(pixels.to_float01(px, "uint8"), "uint8"), pixels.mask_bounds(F.array(*[F.lit(0.0)] * 4), 2), pixels.stretched_uint8(F.array(F.lit(3.0), F.lit(3.0))))
    assert r.c0 == [0, 1, 127, 254, 255] and r.c1 == [0, 0, 0, 0] and r.c2 == [0, 0]

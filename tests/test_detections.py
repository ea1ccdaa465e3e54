import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import checks, detections, detectors, index, lookup, ordering
from tilewright.operators.index import ExampleIndex
from tilewright.schema import BOX


def frame(spark, rows, schema=f"path string, ord long, box {BOX}"):
    return spark.createDataFrame(rows, schema)


def det(path, o, x0, y0, x1, y1, score=1.0, label="ship"):
    return path, o, (float(x0), float(y0), float(x1), float(y1), float(score), label)


NAN = float("nan")


def test_finalize_keeps_clips_drops_and_renames_in_this_order(spark):
    rows = [det("a", 0, -10, -10, 5, 5, 0.3, "boat"), det("a", 1, 3, 3, 3.4, 9, 0.9, "boat"), det("a", 2, 0, 0, 9, 9, 0.8, "car"), det("a", 3, 2, 2, 8, 8, 0.5, "boat"), det("a", 4, -9, -9, 0.5, 5, 0.7, "boat")]
    out = detections.finalize(frame(spark, rows), ["boat"], {"boat": "ship"}, 1.0, (20, 20)).orderBy(F.desc("box.score")).collect()
    assert [(r.box.score, r.box.label) for r in out] == [(0.5, "ship"), (0.3, "ship")]
    assert tuple(out[1].box)[:4] == (0, 0, 5, 5)


def test_selection_ranks_stably_and_drops_nan(spark):
    rows = [det("a", i, 0, 0, 10, 10, 0.5) for i in range(4)] + [det("a", 4, 0, 0, 12, 10, 0.5), det("a", 5, NAN, 0, 9, 9, 0.9), det("a", 6, 0, 0, 7, 99, 0.9), det("b", 0, 0, 0, 10, 10, NAN)]
    got = detections.select(frame(spark, rows), 0.5, 8.0).orderBy("n").collect()
    assert [r.ord for r in got] == [4, 0, 1, 2, 3]
    assert detections.select(frame(spark, rows), 0.5, 8.0, 2).count() == 2 and detections.select(frame(spark, rows), 0.5, 8.0, 0).count() == 5


def test_suppressed_boxes_suppress_nothing(spark):
    rows = [det("a", 0, 0, 0, 10, 10, 0.9), det("a", 1, 4, 0, 14, 10, 0.8), det("a", 2, 8, 0, 18, 10, 0.7), det("a", 3, 0, 0, 10, 10, 0.6, "other")]
    got = detections.suppress(frame(spark, rows), 0.3).orderBy("ord").collect()
    assert [r.box.score for r in got] == [0.9, 0.7, 0.6]


def overlap(a, b):
    w, h = (max(0.0, min(a[i + 2], b[i + 2]) - max(a[i], b[i])) for i in (0, 1))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return w * h / (area(a) + area(b) - w * h)


def test_frames_of_all_sizes_are_suppressed_as_one_by_one(spark):
    """Frames that fill many batches and many frames in a batch, with labels of many boxes and of few, and without a row that holds a frame."""
    rng = np.random.default_rng(6)
    rows, want = [], set()
    for path, n in [("large", 1200), (None, 30), ("one", 1)] + [(f"f{i}", 1 + i % 9) for i in range(40)]:
        x, y, q = rng.integers(0, 60, n), rng.integers(0, 60, n), rng.integers(1, 20, n)
        own = [det(path, int(o), a, b, a + 2 * c, b + c, s / 8, lb) for o, a, b, c, s, lb in zip(rng.permutation(n), x, y, q, rng.integers(0, 9, n), rng.choice(["p", "p", "p", "q"], n))]
        if path == "one":
            own += [(path, o, (0.0, 0.0, 9.0, 9.0, 0.1, None)) for o in (7, 8)]  # unlabelled ones hide nothing
        kept = []
        for r in sorted(own, key=lambda r: (-r[2][4], -(r[2][2] - r[2][0]) * (r[2][3] - r[2][1]), r[1])):
            if r[2][5] is None or not any(k[2][5] == r[2][5] and overlap(k[2], r[2]) > 0.3 for k in kept):
                kept.append(r)
        want |= {(path, i, r[2]) for i, r in enumerate(kept)}
        rows += own
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = detections.suppress(frame(spark, rows), 0.3)
        assert got.columns == ["path", "ord", "box"] and sorted(((r.path, r.ord, tuple(r.box)) for r in got.collect()), key=repr) == sorted(want, key=repr)
        assert "collect_list" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_not_a_number_is_the_largest_overlap(spark):
    rows = [det("a", 0, NAN, 0, 9, 9, 0.9), det("a", 1, 50, 50, 60, 60, 0.8), det("a", 2, 3, 3, 3, 3, 0.7, "flat"), det("a", 3, 3, 3, 3, 3, 0.6, "flat")]
    assert [r.box.score for r in detections.suppress(frame(spark, rows), 0.3).orderBy("ord").collect()] == [0.9, 0.7, 0.6]
    assert detections.suppress(frame(spark, []), 0.3).collect() == []


def test_predictions_are_decoded_in_one_pass(spark):
    """Boxes carry their frame's size: no second pass finds it, and a frame without a name keeps its boxes."""
    raw = [(p, o, 100.0 + 90 * o, 208.0, 50.0, 40.0, 0.9, [0.9, 0.2], 640.0, 512.0) for p in ("a", None) for o in range(3)]
    df = spark.createDataFrame(raw, "path string, ord long, cx double, cy double, w double, h double, obj double, cls array<double>, frame_w double, frame_h double")
    got = detections.decode(df, ["boat", "bird"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == ["path", "ord", "box"] and sorted(((r.path, r.ord) for r in got.collect()), key=repr) == sorted(((p, o) for p in ("a", None) for o in range(3)), key=repr)


def scanned(spark, n):
    return spark.createDataFrame([(f"f{i}", i) for i in range(n)], "path string, frame_ord long")


def test_index_round_trip_and_stats(spark, tmp_path):
    rows = [det("f2", 0, 0, 0, 10, 20, 0.4), det("f2", 1, 0, 0, 30, 10, 0.9, "boat"), det("f0", 0, 5, 5, 20, 20, 0.8), det("f1", 0, 0, 0, 3, 3)]
    i = ExampleIndex.build(frame(spark, rows), scanned(spark, 4), meta={"by": "test"})
    got = [(r.idx, r.path, r.n) for r in i.examples.orderBy("idx").collect()]
    assert got == [(0, "f0", 0), (1, "f2", 0), (2, "f2", 1)]
    s = i.stats().first()
    assert (s.examples, s.frames_with_boxes, s.frames_scanned, s.hit_rate, s.boxes_per_hit) == (3, 2, 4, 0.5, 1.5)
    assert tuple(s.side) == (15, 17.5, 20, 25, 30)
    assert [(r.label, r.n) for r in index.label_counts(i.examples).orderBy("rank").collect()] == [("ship", 2), ("boat", 1)]
    i.write(str(tmp_path / "i"))
    back = ExampleIndex.read(spark, str(tmp_path / "i"))
    assert checks.same_rows(back.examples, i.examples).count() == 0 and back.meta["by"] == "test"
    assert [(r.path, len(r.boxes)) for r in back.by_path().orderBy("frame_ord").collect()] == [("f0", 1), ("f1", 0), ("f2", 2), ("f3", 0)]
    few = back.filtered(min_score=0.5, max_per_frame=1, predicate=F.col("path") != "f0")
    assert [(r.idx, r.path, r.n, r.box.label) for r in few.examples.collect()] == [(0, "f2", 0, "boat")]
    assert few.scanned.count() == 4
    kept = back.filtered(keep=spark.createDataFrame([("f0",)], "path string"))
    assert kept.scanned.count() == kept.examples.count() == 1


def test_empty_index(spark):
    i = ExampleIndex.build(frame(spark, []), scanned(spark, 0))
    s = i.stats().first()
    assert (s.examples, s.hit_rate, s.boxes_per_hit, s.side) == (0, 0.0, 0.0, None)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_partitions_never_change_numbers(spark, parts):
    rows = [det(f"f{i % 50}", i, 0, 0, 10 + i % 7, 10, (i % 10) / 10) for i in range(300)]
    i = ExampleIndex.build(frame(spark, rows).repartition(parts), scanned(spark, 50))
    a = i.examples
    b = index.in_order(a.drop("idx"), ["frame_ord", "n"], chunks=parts).select(*a.columns)
    assert checks.same_rows(a, b).count() == 0
    assert [r.idx for r in ordering.epoch_order(a, 1, 2).orderBy("pos").limit(5).collect()] == [r.idx for r in ordering.epoch_order(a.repartition(parts + 1), 1, 2).orderBy("pos").limit(5).collect()]


def test_orders_and_batches(spark):
    ex = spark.range(10).withColumnRenamed("id", "idx")
    o = ordering.epoch_order(ex, 0, 0)
    assert checks.permutation_problem(o, 10).count() == 0 and checks.permutation_problem(o.where("idx > 0"), 10).count() == 1
    assert ordering.batches(o, 4).select("batch").distinct().count() == 3 and ordering.batches(o, 4, True).count() == 8
    exact = ordering.exact_epoch_order(spark, 10, 3, 1)
    assert checks.permutation_problem(exact, 10).count() == 0
    assert ordering.exact_sample(spark, 100, 7, 1).count() == 7
    r = spark.createDataFrame([(-1,), (3,)], "i long")
    assert [x.w for x in r.select(ordering.wrapped(F.col("i"), 5).alias("w")).collect()] == [4, 3]
    with pytest.raises(Exception, match="out of range"):
        r.select(ordering.wrapped(F.col("i"), 3)).collect()


def test_keys_prefer_path_then_name_then_stem(spark):
    rec = spark.createDataFrame([("/p/a.png", 0), ("b.png", 1), ("c", 2), ("a.png", 3)], "key string, key_ord long")
    frames = spark.createDataFrame([("/p/a.png",), ("/q/a.png",), ("/q/b.png",), ("/q/c.jpg",), ("/q/d.png",)], "path string")
    got = {r.path: r.key for r in lookup.find_keys(frames, rec).collect()}
    assert got == {"/p/a.png": "/p/a.png", "/q/a.png": "/p/a.png", "/q/b.png": "b.png", "/q/c.jpg": "c", "/q/d.png": None}
    with pytest.raises(Exception, match="no boxes for"):
        lookup.find_keys(frames, rec, allow_missing=False).collect()


def test_detectors_by_name():
    names = detectors.DETECTORS
    assert names.find(" GT ") is detectors.MetadataDetector and set(names.notes()) >= {"function", "precomputed", "metadata", "grid"}
    names.add("late later", "collections:OrderedDict")
    for bad, error in (("late", TypeError), ("LATER", TypeError), ("nothing", KeyError), (dict, TypeError), (3, TypeError), ({"min_side": 2}, KeyError)):
        with pytest.raises(error):
            detectors.build(bad)
    with pytest.raises(ValueError):
        names.add("grid", dict)
    d = detectors.build({"name": "function", "fn": len, "min_side": 3})
    assert detectors.build(d) is d and d.min_side == 3
    with pytest.raises(TypeError):
        detectors.build(d, min_side=2)
    assert detectors.as_box([1, 2, 3, 4, 0.5, "l"])["label"] == "l"
    with pytest.raises(ValueError):
        detectors.as_box([1, 2, 3])


def test_violations(spark):
    rows = [det("a", 0, 0, 0, 0.5, 0.5), det("a", 1, 5, 5, 2, 9), det("a", 2, NAN, 0, 5, 5), det("a", 3, 0, 0, 900, 9), det("a", 4, 2, 2, 9, 9, 1, " "), det("a", 5, 2, 2, 9, 9), ("a", 6, None)]
    got = sorted((r.ord, r.rule) for r in checks.detection_violations(frame(spark, rows), 640, 480).collect())
    assert got == [(0, "normalised"), (1, "degenerate"), (2, "not finite"), (3, "outside"), (4, "label"), (6, "null")]

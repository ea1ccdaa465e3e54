import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tilewright import cli
from tilewright.functions import boxes, draws, paths
from tilewright.operators import checks, composites, detectors, generate, lifecycle, ordering, rasters
from tilewright.operators.generate import PairSource
from tilewright.operators.index import ExampleIndex
from tilewright.schema import BOX
from tilewright.sources import boxes_json, images, pools


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("frames")
    for i in range(4):
        (d / f"f{i}.png").write_bytes(images.encode_png(rasters.synthetic_frame(64, 96, i)))
    (d / "bad.png").write_bytes(b"not a png")
    return d


FIND = """
def find(px, path):
    if path.endswith("f2.png"):
        raise RuntimeError("no answer")
    return [[5, 5, 30 + int(path[-5]), 25, 0.5 + int(path[-5]) / 10], {"bbox": [40, 30, 60, 50], "score": 0.9}]
"""
exec(FIND, made := {"__name__": "__main__"})
find = made["find"]


def frames_of(spark, folder, **options):
    got = images.frames(spark, f"{folder}/*.png", **options)
    return got.join(ordering.pool_sample(got.select("path")), "path")


def test_failures_end_nothing_unless_asked(spark, folder):
    progress = Observation("index")
    made, failed = lifecycle.build(frames_of(spark, folder), detectors.FunctionDetector(find), progress=progress)
    assert {r.path.rsplit("/", 1)[-1]: r.error.split(":")[0] for r in failed.collect()} == {"bad.png": "ValueError", "f2.png": "RuntimeError"}
    assert sorted({r.path[-6:] for r in made.scanned.collect()}) == ["f0.png", "f1.png", "f3.png"] and made.examples.count() == 6
    assert progress.get == {"frames": 3, "pixels": 3 * 64 * 96} and made.meta["detector"] == "FunctionDetector"
    with pytest.raises(Exception, match="bad.png"):
        lifecycle.build(frames_of(spark, folder), detectors.FunctionDetector(lambda px, path: []), on_error="raise")[0].scanned.collect()
    with pytest.raises(Exception, match="can be decoded here"):
        images.frames(spark, f"{folder}/*.png", on_error="raise").select("image").collect()
    with pytest.raises(Exception, match="no answer"):
        detectors.FunctionDetector(find).detect(images.frames(spark, f"{folder}/f*.png")).collect()
    for bad in (lambda: lifecycle.build(frames_of(spark, folder), detectors.FunctionDetector(find), on_error="x"), lambda: images.frames(spark, str(folder), on_error="x")):
        with pytest.raises(ValueError):
            bad()


@pytest.mark.parametrize("ending", ["", ".json"])
def test_an_index_is_built_once(spark, folder, tmp_path, ending):
    calls = []

    def make():
        calls.append(1)
        return lifecycle.build(frames_of(spark, folder), detectors.FunctionDetector(find))[0]

    path = str(tmp_path / f"index{ending}")
    first = lifecycle.load_or_build(spark, path, make)
    assert first.examples.count() == 6 and first.scanned.count() == 3
    strict = lifecycle.load_or_build(spark, path, make, min_score=0.7)
    assert [(r.idx, r.n) for r in strict.examples.orderBy("idx").collect()] == [(0, 0), (1, 0), (2, 0), (3, 1)] and len(calls) == 1
    keep = first.scanned.where("path like '%f1.png'").select("path")
    part = lifecycle.load(spark, path, keep)
    assert part.scanned.count() == 1 and part.examples.count() == 2
    said = lifecycle.describe(first, seed=3)
    assert (said["examples"], said["frames_scanned"], said["labels"], said["seed"]) == (6, 3, {"ship": 6}, 3)
    lifecycle.load_or_build(spark, path, make, force=True)
    assert len(calls) == 2 and lifecycle.load_or_build(spark, None, make).examples.count() == 6 and len(calls) == 3
    with pytest.raises(ValueError, match="no example"):
        lifecycle.load(spark, path, min_score=2.0)


def test_box_files_by_lines(spark, folder, tmp_path):
    made, _ = lifecycle.build(frames_of(spark, folder), detectors.FunctionDetector(find))
    path = str(tmp_path / "b.json")
    boxes_json.write(made.by_path(), path, {"by": "me"})
    whole, lines = boxes_json.read(spark, path), boxes_json.read_lines(spark.read.text(path))
    same = [d.select("key", "ord", "box") for d in (whole, lines)]
    assert checks.same_rows(*same).count() == 0 and whole.count() == 6
    order = lambda d: [r.key for r in d.select("key", "key_ord").distinct().orderBy("key_ord").collect()]
    assert order(whole) == order(lines)


def source(spark, n=3):
    rows = [(f"f{i}", i, (240, 320, 1, rasters.synthetic_frame(seed=i).tobytes())) for i in range(n)]
    f = spark.createDataFrame(rows, "path string, frame_ord long, image struct<height:int,width:int,nChannels:int,data:binary>")
    det = [(f"f{i}", o, (*b, s, "ship")) for i in range(n) for o, (b, s) in enumerate([((139.0, 124.0, 183.0, 140.0), 0.9), ((40.0, 150.0, 78.0, 166.0), 0.6)])]
    index = ExampleIndex.build(spark.createDataFrame(det, f"path string, ord long, box {BOX}"), f.select("path", "frame_ord"))
    return PairSource(index, f.select("path", "image"), seed=5)


def test_batches_for_training(spark):
    s = source(spark)
    got = list(generate.loader(s, 4, repeats=2, drop_last=False))
    assert [len(b["idx"]) for b in got] == [4, 4, 4] and got[0]["clean"].shape == (4, 1, 256, 256) and got[0]["mask"].dtype == np.float32
    seen = [(int(e), int(i)) for b in got for e, i in zip(b["epoch"], b["idx"])]
    assert sorted(seen) == [(e, i) for e in range(2) for i in range(6)] and [e for e, _ in seen] == [0] * 6 + [1] * 6
    assert all(int(x) == draws.seed_words(5, e, i) for b in got for x, e, i in zip(b["seed"], b["epoch"], b["idx"]))
    assert len(list(generate.loader(s, 4, drop_last=True))) == 1
    plain, centred = next(generate.loader(s, 2, shuffle=False)), next(generate.loader(s, 2, shuffle=False, normalize=True))
    assert plain["idx"].tolist() == [0, 1] and np.allclose(centred["clean"], plain["clean"] * 2 - 1)
    rows = {r.idx: r for r in s.pairs(epoch=0).collect()}
    assert np.allclose(plain["doctored"][0].ravel() * 255, np.frombuffer(rows[0].pair.doctored, np.uint8), atol=1e-4)
    said = s.stats()
    assert said["examples"] == 6 and said["steps"][0] == "shift" and said["out_size"] == 256


def test_orders_of_many_epochs_are_those_of_each(spark):
    s = source(spark)
    run = ordering.epochs_order(s.index.examples, 5, 3)
    for e in range(3):
        want = {r.idx: r.pos for r in ordering.epoch_order(s.index.examples, 5, e).collect()}
        assert {r.idx: r.pos for r in run.where(f"epoch = {e}").collect()} == want
    with pytest.raises(ValueError):
        ordering.exact_epoch_order(spark, 11, 1, 1, most=10)


def test_a_placement_of_the_callers_own(spark):
    s = source(spark, 2)
    ex = s.index.examples.join(s.frames, "path").select("idx", "box", "image")
    there = lambda seed, i, box, w, h, dw, dh: boxes.from_center(w / 2, h / 2 + i, dw, dh)
    got = composites.composites(ex, ex, placement=there, length=3).orderBy("i").collect()
    assert [((r.box.y_min + r.box.y_max) / 2, (r.box.x_min + r.box.x_max) / 2) for r in got] == [(120 + i, 160) for i in range(3)]


def test_paths_come_to_what_they_name(spark):
    cases = {"/a/b.png": "/a/b.png", "file:///a/./b//c.png": "/a/b/c.png", "file:/a/../b": "/b", "/../x": "/x", "a/../../b": "../b", "x": "x", "/": "/"}
    df = spark.createDataFrame([(k,) for k in cases], "path string")
    assert {r.path: r.r for r in df.select("path", paths.resolved(F.col("path")).alias("r")).collect()} == cases
    from tilewright.operators import lookup

    rec = spark.createDataFrame([("/p/x/../a.jpg", 0), ("/other/b.png", 1)], "key string, key_ord long")
    got = lookup.find_keys(spark.createDataFrame([("/p/./a.jpg",), ("/p/c.png",)], "path string"), rec)
    assert {r.path: r.key for r in got.collect()} == {"/p/./a.jpg": "/p/x/../a.jpg", "/p/c.png": None}


def test_spread_columns(spark):
    df = spark.range(30).withColumnRenamed("id", "n")
    for k in (1, 4, 7):
        assert {r.n: r.s for r in df.select("n", draws.spread_column(F.col("n"), k).alias("s")).collect()} == {n: draws.spread(n, k) for n in range(30)}


def test_pools_from_settings(folder):
    made = pools.configure({"Here": {"patterns": ["{top}/f*.png"], "detector": "metadata", "note": "n"}, "there": {"patterns": ["/x"]}, "all of it": {"union": ["here", "there"]}}, {"top": str(folder)})
    assert [p.name for p in made] == ["Here", "there", "all of it"] and pools.expand("HERE") == [f"{folder}/f*.png"] and len(pools.expand("all of it")) == 2
    with pytest.raises(KeyError):
        pools.configure({"z": {"patterns": ["{nowhere}/x"]}})


def test_detecting_functions_are_checked():
    px = rasters.synthetic_frame(48, 64)

    def spoil(p):
        p[0, 0] += 1
        return []

    calls = []
    cases = [
        (lambda p: [[1, 1, 20, 20]], []), (lambda p: None, []), (spoil, ["the frame itself was changed"]), (lambda p: 5, ["it returns a int, no list of boxes"]), (lambda p: [[1, 2]], ["no box"]),
        (lambda p: 1 / 0, ["it fails: ZeroDivisionError"]), (lambda p: [[0, 0, 0.5, 0.5]], ["box 0: normalised"]), (lambda p: [[9, 9, 2, 12]], ["box 0: degenerate"]), (lambda p: [[0, 0, 900, 20]], ["box 0: outside"]),
        (lambda p: [[float("nan"), 0, 9, 9]], ["box 0: not finite"]), (lambda p: calls.append(1) or [[0, 0, 9 + len(calls), 9]], ["not the same again"]),
    ]
    for fn, want in cases:
        said = checks.detector_problems(fn, px)
        assert len(said) == len(want) and all(s.startswith(w) for s, w in zip(said, want)), (said, want)


def test_edited_inputs_are_told():
    from tilewright.operators.augment import Augmenter

    class Careless(Augmenter):
        def augment(self, image, box, source=None, seed=None):
            image[0, 0] ^= 1
            return super().augment(image, box, source, seed)

    px = rasters.synthetic_frame()
    assert any("the input itself" in s for s in checks.augmenter_problems(Careless(), px, (139.0, 124.0, 183.0, 140.0)))
    assert checks.augmenter_problems(Augmenter(), px, (139.0, 124.0, 183.0, 140.0)) == []


def test_commands(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "pools.json").write_text(json.dumps({"mine": {"patterns": ["{top}/f[013].png"], "detector": "fn:ship_finder:find"}}))
    (tmp_path / "ship_finder.py").write_text(FIND)
    spark.sparkContext.addPyFile(str(tmp_path / "ship_finder.py"))
    first = ["--pools", str(tmp_path / "pools.json"), "--root", f"top={folder}"]
    assert cli.main([*first, "list"]) == 0 and "mine" in capsys.readouterr().out
    monkeypatch.setattr("sys.path", [str(tmp_path), *__import__("sys").path])
    assert cli.main([*first, "index", "mine", str(tmp_path / "ix.json")]) == 0
    assert cli.main(["stats", str(tmp_path / "ix.json")]) == 0 and json.loads(capsys.readouterr().out)["examples"] == 6
    assert cli.main([*first, "index", "mine", str(tmp_path / "ix.json"), "--min-score", "0.7"]) == 0
    assert cli.main(["dump", str(tmp_path / "ix.json"), str(tmp_path / "o.json"), "--limit", "2"]) == 0
    assert len(json.loads((tmp_path / "o.json").read_text())) == 3
    assert cli.main(["check", str(tmp_path / "ix.json"), "96", "64"]) == 0
    capsys.readouterr()
    assert cli.main(["check", str(tmp_path / "ix.json"), "10", "10"]) == 1 and capsys.readouterr().out.endswith("6 problems\n")
    assert cli.main([*first, "generate", str(tmp_path / "ix.json"), "mine"]) in (0, 1)


def test_nothing_found_and_many_at_once(spark):
    from tilewright.operators.augment import Augmenter

    frames = spark.createDataFrame([("a",), ("b",)], "path string")
    assert detectors.build("null").detect(frames).count() == 0
    px = [rasters.synthetic_frame(seed=i) for i in range(3)]
    ship = (139.0, 124.0, 183.0, 140.0)
    many = Augmenter().augment_all(px, [ship] * 3, seed=7)
    assert [p.seed for p in many] == [7, 8, 9] and all(np.array_equal(p.doctored, Augmenter().augment(x, ship, seed=7 + i).doctored) for i, (p, x) in enumerate(zip(many, px)))
    assert [p.seed for p in Augmenter().augment_all(px, [ship] * 3)] == [None] * 3

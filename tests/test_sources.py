import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright import cli
from tilewright.operators import detectors, rasters
from tilewright.operators.index import ExampleIndex
from tilewright.sources import boxes_json, images, metadata_csv, pools
from tilewright.streaming import visits


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Frames of several kinds, one of them broken, in nested folders with names beyond ASCII."""
    d = tmp_path_factory.mktemp("frames") / "光学"
    (d / "sub").mkdir(parents=True)
    for i in range(3):
        (d / f"f{i}.png").write_bytes(images.encode_png(rasters.synthetic_frame(24, 32, i)))
    rgb = np.zeros((4, 5, 3), np.uint8)
    rgb[..., 0] = 255
    (d / "sub" / "red.PNG").write_bytes(images.encode_png(rgb))
    (d / "sub" / "g.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    (d / "sub" / "bad.png").write_bytes(b"not a png")
    (d / "notes.txt").write_text("x")
    return d


def test_frames_are_decoded_and_broken_ones_told(spark, folder):
    got = images.frames(spark, str(folder)).where("path like '%.p%' or path like '%.P%'")
    good, failed = images.split_errors(got)
    assert good.count() == 5 and [r.path.rsplit("/", 1)[-1] for r in failed.collect()] == ["bad.png"]
    by = {r.path.rsplit("/", 1)[-1]: r.image for r in good.collect()}
    assert bytes(by["f1.png"].data) == rasters.synthetic_frame(24, 32, 1).tobytes()
    assert set(bytes(by["red.PNG"].data)) == {76} and (by["g.pgm"].height, by["g.pgm"].width) == (2, 3)
    colour = images.frames(spark, str(folder / "sub" / "red.PNG"), gray=False).first().image
    assert colour.nChannels == 3 and bytes(colour.data)[:3] == b"\xff\0\0"
    assert images.spark_frames(spark, str(folder / "f0.png")).first().image.nChannels == 1


def test_png_filters():
    import struct
    import zlib

    px = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    rows, above = [], np.zeros(21, int)
    for y, rule in enumerate((0, 1, 2, 3, 4)):
        line, left = px[y].ravel().astype(int), np.concatenate(([0, 0, 0], px[y].ravel()[:-3].astype(int)))
        corner = np.concatenate(([0, 0, 0], above[:-3]))
        p = left + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = (0, left, above, (left + above) // 2, near)[rule]
        rows.append(bytes([rule]) + ((line - guess) & 255).astype(np.uint8).tobytes())
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")
    assert np.array_equal(images.png(data), px)


def test_pools(spark, folder):
    pools.register(pools.Pool("First", (f"{folder}/*.png",), detector="metadata"))
    pools.register(pools.Pool("second", (f"{folder}/sub/*", f"{folder}/f0.png")))
    pools.union("both", "first", "second")
    names = lambda spec: sorted(r.path.rsplit("/", 1)[-1] for r in pools.scan(spark, spec).collect())
    assert names(" FIRST ") == ["f0.png", "f1.png", "f2.png"]
    assert names("both") == ["bad.png", "f0.png", "f1.png", "f2.png", "g.pgm", "red.PNG"] == names(["first", str(folder / "sub")])
    assert pools.suggested_detector("first") == "metadata" and pools.suggested_detector("second") == "grid"
    assert pools.source_name(["a", "b"]) == "2 paths"
    with pytest.raises(FileNotFoundError):
        pools.scan(spark, str(folder / "none.png"))
    with pytest.raises(TypeError):
        pools.expand(5)
    with pytest.raises(KeyError):
        pools.get("nothing")


BOXES = {"__meta__": {"by": "me"}, "/p/f0.png": [{"x_min": 1, "y_min": 2, "x_max": 13, "y_max": 14, "score": 0.5}, {"bbox": [3, 3, 20, 20], "confidence": 0.75, "class": "boat"}], "f1": [], "/p/f2.png": [{"x0": 0, "y0": 0, "x1": 9, "y1": 9}]}


def test_box_files_round_trip(spark, tmp_path):
    f = tmp_path / "boxes.json"
    f.write_text(json.dumps(BOXES))
    rows = boxes_json.read(spark, str(f)).orderBy("key_ord", "ord").collect()
    assert [(r.key, r.ord, r.box and r.box.label) for r in rows] == [("/p/f0.png", 0, "ship"), ("/p/f0.png", 1, "boat"), ("f1", 0, None), ("/p/f2.png", 0, "ship")]
    assert boxes_json.meta(spark, str(f)) == {"by": "me"}
    frames = spark.createDataFrame([(f"/q/f{i}.png", i) for i in range(4)], "path string, frame_ord long")
    det = detectors.build("precomputed", records=boxes_json.read(spark, str(f))).detect(frames)
    index = ExampleIndex.build(det, frames, meta={"k": 1})
    out = tmp_path / "out.json"
    boxes_json.write(index.by_path(), str(out), index.meta, "stem")
    again = json.loads(out.read_text())
    assert list(again) == ["__meta__", "f0", "f1", "f2", "f3"] and [b["label"] for b in again["f0"]] == ["boat", "ship"] and again["f1"] == []
    back = detectors.build("precomputed", records=boxes_json.read(spark, str(out))).detect(frames)
    assert sorted(map(str, back.select("path", "box").collect())) == sorted(map(str, det.select("path", "box").collect()))
    bad = tmp_path / "bad.json"
    bad.write_text("[1, 2]")
    with pytest.raises(Exception, match="object"):
        boxes_json.read(spark, str(bad)).collect()


def test_metadata_tables(spark, tmp_path):
    d = tmp_path / "full" / "metadata" / "s1"
    d.mkdir(parents=True)
    head = "image_name,category,x_min_tight,y_min_tight,x_max_tight,y_max_tight,x_min_tight_lwir,y_min_tight_lwir,x_max_tight_lwir,y_max_tight_lwir,is_target_visible,is_target_visible_lwir,extra\n"
    (d / "a.csv").write_text(head + "001,cargo,1,2,10,20,3,4,11,21,1,0,x\n002,cargo,1,2,10,20,3,4,11,21,0,1,x\n003,old,0,0,1,1,0,0,1,1,1,1,x\n")
    (d / "b.csv").write_text(head + "003,new,5,5,9,9,6,6,9,9,1,1,x\n004,,5,5,9,9,6,6,9,9,,nan,x\n")
    meta = metadata_csv.read(spark, str(tmp_path), "full")
    assert meta.count() == 4
    frames = spark.createDataFrame([(f"/r/full/images/s1/{m}/{i:03}.png",) for m in ("vis", "lwir") for i in range(1, 6)], "path string")
    got = {tuple(r.path.split("/")[-2:]): (r.box.x_min, r.box.x_max, r.box.label) for r in detectors.build("metadata", meta=meta).detect(frames).collect()}
    assert got == {("vis", "001.png"): (1, 11, "cargo"), ("lwir", "002.png"): (3, 12, "cargo"), ("vis", "003.png"): (5, 10, "new"), ("lwir", "003.png"): (6, 10, "new"), ("vis", "004.png"): (5, 10, "ship"), ("lwir", "004.png"): (6, 10, "ship")}
    with pytest.raises(ValueError):
        detectors.build("metadata", meta=meta, box="wide").detect(frames)
    with pytest.raises(FileNotFoundError):
        metadata_csv.read(spark, str(tmp_path), "nothing")


def test_python_detectors(spark, folder):
    good, _ = images.split_errors(images.frames(spark, f"{folder}/f*.png"))
    seen = lambda px, path: [{"bbox": [-5, 0, 10, px.shape[0] + 9], "score": 0.5}, [0, 0, 0.5, 9]] if path.endswith("f1.png") else None
    got = detectors.build(seen, rename_labels={"ship": "hull"}).detect(good).collect()
    assert [(r.path[-6:], tuple(r.box)) for r in got] == [("f1.png", (0, 0, 10, 24, 0.5, "hull"))]


def test_stream_of_visits(spark):
    ex = spark.createDataFrame([(i, f"f{i}") for i in range(7)], "idx long, path string")
    index = ExampleIndex(ex, ex.select("path"))
    q = visits.visited(visits.endless(spark, 7, 10), index).writeStream.format("memory").queryName("visits_test").trigger(processingTime="0 seconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and (q.lastProgress is None or spark.table("visits_test").count() < 21):
            time.sleep(0.5)
    finally:
        q.stop()
    seen = spark.table("visits_test").where("epoch < 2")
    assert seen.count() == 14 and seen.groupBy("epoch", "idx").count().where("count != 1").count() == 0


def test_an_index_grows(spark, folder, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "path string, n int"
    spark.createDataFrame([("a", 1), ("b", 0)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    box = F.expr("named_struct('x_min',0D,'y_min',0D,'x_max',20D,'y_max',20D,'score',1D,'label','ship')")
    detect = lambda batch: batch.where("n > 0").select("path", F.lit(0).cast("bigint").alias("ord"), box.alias("box"))
    go = lambda: visits.grow(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), detect, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination(60)
    go()
    spark.createDataFrame([("c", 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go()
    assert sorted(r.path for r in spark.read.parquet(f"{tmp_path}/ix/*/examples").collect()) == ["a", "c"]
    assert spark.read.parquet(f"{tmp_path}/ix/*/scanned").count() == 3


def test_command_line(spark, folder, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "b.json").write_text(json.dumps({"f0": [[0]], "f1": []}).replace("[[0]]", '[{"bbox": [1, 1, 20, 20]}]'))
    assert cli.main(["list"]) == 0 and "grid" in capsys.readouterr().out
    assert cli.main(["index", str(folder), str(tmp_path / "ix"), "--boxes", str(tmp_path / "b.json")]) == 0
    assert cli.main(["stats", str(tmp_path / "ix")]) == 0 and json.loads(capsys.readouterr().out)["examples"] == 1
    assert cli.main(["check", str(tmp_path / "ix"), "32", "24"]) == 0 and cli.main(["check", str(tmp_path / "ix"), "9", "9"]) == 1
    assert cli.main(["dump", str(tmp_path / "ix"), str(tmp_path / "o.json"), "--form", "name"]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["f0.png"][0]["x_max"] == 20
    assert cli.main(["augment", "--seeds", "3"]) == 0 and cli.main(["augment", "--set", "gain={'factor': 1.0}"]) == 1
    assert cli.setting("a=(1, 2)") == ("a", (1, 2)) and cli.setting("a=b") == ("a", "b")

import hashlib
import itertools
import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import boxes, draws
from tilewright.operators import checks, composites, corruptions, rasters
from tilewright.operators.augment import Augmenter, pair_column, parts, patch_column, pixels_of
from tilewright.operators.generate import PairSource, training_rows
from tilewright.operators.index import ExampleIndex
from tilewright.plans import imaging, pairs
from tilewright.schema import BOX
from tilewright.session import PART_BYTES

FRAME = rasters.synthetic_frame()
SHIP = (139.0, 124.0, 183.0, 140.0)
#: By seed: what is drawn, and the md5 of the pixels.
DRAWN = """{"0": {"params": {"context": [0.16369616873214543, 0.12697867137638705], "offset": [-1.6157731957445949, -0.6188446265234828], "feather_px": 0.0, "geometric": {"shift": {"dx": 1.7351234112990417, "dy": 2.2861471523982635}, "rotate": {"deg": 1.2796293092061584}, "rescale": {"sx": 1.03671944975744, "sy": 1.03671944975744}}, "photometric": {"gain": {"factor": 1.0293962471835896}, "level": {"delta": 0.04350724237877683}, "blur": {"sigma": 1.0288851319050831}, "noise": {"sigma": 0.0011754951356912524}, "stripe": {"sigma": 0.00658804040476994, "axis": "row"}}}, "pixels": "57b322c2ba55b16a0beb34b0469fed2f"},
"1": {"params": {"context": [0.1511821624700257, 0.19504636963259353], "offset": [-1.2525581632268892, 0.5742712923356722], "feather_px": 0.0, "geometric": {"shift": {"dx": -1.0503230708586175, "dy": -0.42797800391831053}, "rotate": {"deg": 3.9324311258453015}, "rescale": {"sx": 0.9854718618190659, "sy": 0.9854718618190659}}, "photometric": {"gain": {"factor": 1.0313659169321097}, "level": {"delta": -0.047244088675693165}, "blur": {"sigma": 0.3956780597989106}, "noise": {"sigma": 0.027595004619994153}, "stripe": {"sigma": 0.013190476783230043, "axis": "row"}}}, "pixels": "68caa5542ec6cfb3a08caf2d1919ce8f"},
"5": {"params": {"context": [0.18050029237453802, 0.18079407897364938], "offset": [0.05394597486833974, -0.2741742334871788], "feather_px": 0.0, "geometric": {"shift": {"dx": -2.527775436990097, "dy": -0.6609225963614205}, "rotate": {"deg": -1.0983215349600162}, "rescale": {"sx": 0.9272440310243912, "sy": 0.9272440310243912}}, "photometric": {"gain": {"factor": 0.8660900445399654}, "level": {"delta": 0.04991761150650714}, "gamma": {"gamma": 0.9320785705844383}, "blur": {"sigma": 1.1690234319111064}, "noise": {"sigma": 0.03141871628379921}, "stripe": {"sigma": 0.0030384204590105423, "axis": "row"}}}, "pixels": "eef2efa19e1ffe642ca36b0f9f92c35d"}}"""


def changed(p):
    return (p.doctored != p.clean).reshape(*p.mask.shape, -1).any(axis=2)


@pytest.mark.parametrize("image", [FRAME, FRAME.astype(np.float32) / 255, np.repeat(FRAME[..., None], 3, axis=2), FRAME.astype(np.uint16) * 257], ids=["uint8", "float32", "rgb", "uint16"])
def test_outside_the_mask_nothing_changes(image):
    a = Augmenter()
    for seed in range(12):
        p = a.augment(image, SHIP, seed=seed)
        assert p.doctored.dtype == image.dtype and p.doctored.shape == image.shape
        assert not (changed(p) & (p.mask == 0)).any() and changed(p).any()
    assert checks.augmenter_problems(a, image, SHIP) == []


def test_broken_augmenters_are_told():
    class Leaky(Augmenter):
        def augment(self, image, box, source=None, seed=None):
            p = super().augment(image, box, source, seed)
            p.doctored[0, 0] += 1
            return p

    class Idle(Augmenter):
        def augment(self, image, box, source=None, seed=None):
            p = super().augment(image, box, source, seed)
            p.doctored = p.clean.copy()
            return p

    assert any("outside the mask" in s for s in checks.augmenter_problems(Leaky(), FRAME, SHIP))
    assert checks.augmenter_problems(Idle(), FRAME, SHIP) == ["nothing is ever changed"]


def test_no_op_is_a_round_trip():
    for image in (FRAME, FRAME.astype(np.uint16) * 257):
        p = Augmenter(ops=[]).augment(image, SHIP, seed=1)
        assert np.array_equal(p.doctored, image)
    p = Augmenter(ops={"rotate": {"max_deg": 0.0}, "gain": {"factor": 1.0}}).augment(FRAME, SHIP, seed=1)
    assert np.array_equal(p.doctored, FRAME)


def test_rectangle_bounds():
    a = Augmenter()
    w, h = 44.0, 16.0
    for seed in range(64):
        rect, drawn = a.rect_for(SHIP, np.random.default_rng(seed))
        assert 1.10 * w <= rect[2] - rect[0] <= 1.20 * w + 1e-9 and 1.10 * h <= rect[3] - rect[1] <= 1.20 * h + 1e-9
        assert abs((rect[0] + rect[2]) / 2 - 161) <= 0.04 * w + 1e-9 and abs((rect[1] + rect[3]) / 2 - 132) <= 0.04 * h + 1e-9


def test_shift_moves_forward():
    ramp = np.tile(np.linspace(0, 1, 320, dtype=np.float32), (240, 1))

    five = replace(corruptions.KINDS.find("shift"), draws={"dx": lambda *_: 5.0, "dy": lambda *_: 0.0})
    p = Augmenter(ops=[five]).augment(ramp, SHIP, seed=0)
    inside = p.mask > 0
    assert np.allclose((p.doctored - p.clean)[inside], -5 / 319, atol=1e-5)


@pytest.mark.parametrize("box", [(0, 0, 20, 16), (300, 220, 340, 260), (-12, -12, 14, 10)])
def test_boxes_at_the_edge(box):
    p = Augmenter().augment(FRAME, tuple(map(float, box)), seed=3)
    assert p.skipped is None and not (changed(p) & (p.mask == 0)).any()


def test_skipped_pairs():
    off = Augmenter().augment(FRAME, (-80.0, -80.0, -40.0, -40.0), seed=0)
    assert off.skipped == "degenerate rect" and np.array_equal(off.doctored, FRAME)
    clean = Augmenter(p_clean=1.0).augment(FRAME, SHIP, seed=0)
    assert clean.skipped == "p_clean" and np.array_equal(clean.doctored, FRAME) and clean.mask.any()


def test_foreign_patches():
    for value in (255, 128, 10):
        donor = np.full((40, 90), value, np.uint8)
        p = Augmenter(ops=[]).augment(FRAME, SHIP, donor, seed=2)
        core = p.mask > 0.999
        assert core.any() and np.abs(p.doctored[core].astype(int) - value).max() <= 1
    rgb = np.full((40, 90, 3), 200, np.uint8)
    assert np.abs(Augmenter(ops=[]).augment(FRAME, SHIP, rgb, seed=2).doctored[132, 161].astype(int) - 200) <= 1
    wide = np.repeat(FRAME[..., None], 3, axis=2)
    assert Augmenter(ops=[]).augment(wide, SHIP, np.full((40, 90), 200, np.uint8), seed=2).doctored.shape == wide.shape
    with pytest.raises(ValueError):
        Augmenter().augment(wide, SHIP, np.zeros((9, 9, 4), np.uint8), seed=0)


def test_feather_and_levels():
    p = Augmenter(ops=[], feather_px=2.0).augment(FRAME, SHIP, seed=1)
    assert ((p.mask > 0) & (p.mask < 1)).any()
    rng = np.random.default_rng(0)
    donor = (rng.random((40, 90)) * 255).astype(np.uint8)
    q = Augmenter(ops=[], match_levels=True).augment(FRAME, SHIP, donor, seed=1)
    inside = q.mask > 0.999
    assert abs(float(q.doctored[inside].mean()) - float(FRAME[q.mask > 0.5].mean())) < 12


@pytest.mark.parametrize(("what", "names"), [
    (None, corruptions.DEFAULT),
    ({"blur": None, "shift": {"max_px": 4}, "noise": False, "FPN": {}}, ("shift", "stripe")),
    (["offset", {"name": "zoom", "p": 0.5}, corruptions.KINDS.find("gain")], ("shift", "rescale", "gain")),
    (corruptions.step("blur"), ("blur",)),
    ("Bias", ("level",)),
])
def test_recipes(what, names):
    assert tuple(s.name for s in corruptions.recipe(what)) == names


@pytest.mark.parametrize(("what", "error"), [("nothing", KeyError), (5, TypeError), ({"gain": {"size": 3}}, TypeError), ([dict], KeyError), ("json:loads", TypeError), ([{"p": 1}], KeyError)])
def test_bad_recipes(what, error):
    with pytest.raises(error):
        corruptions.recipe(what)


def test_a_recipe_of_the_callers_own(monkeypatch):
    """A kind by its module's name; options over a step's own; a name keeps its meaning; rotations are capped."""
    inverted = corruptions.Kind("inverted", corruptions.TONES, {"p": 1.0}, {}, lambda px, d, rng: 1 - px)
    monkeypatch.setattr(corruptions, "inverted", inverted, raising=False)
    p = Augmenter(ops="tilewright.operators.corruptions:inverted").augment(FRAME, SHIP, seed=0)
    assert np.abs(p.doctored[p.mask > 0].astype(int) + FRAME[p.mask > 0] - 255).max() <= 1
    assert corruptions.step(corruptions.step("gain", p=0.5), factor=2.0).options == {"factor": 2.0, "p": 0.5}
    with pytest.raises(ValueError):
        corruptions.KINDS.add("shift", inverted)
    with pytest.raises(TypeError):
        replace(inverted, family="other")
    steps = corruptions.recipe()
    assert corruptions.capped(steps, None) == corruptions.capped(steps, 9) == steps
    assert [s.options["max_deg"] for s in (corruptions.capped(steps, 2)[1], steps[1])] == [2, 6]


def test_draws_of_a_seed_are_fixed():
    """The numbers that seeds gave from the first version on."""
    want = json.loads(DRAWN)
    for seed, params in want.items():
        p = Augmenter(ops=[*corruptions.DEFAULT, {"name": "stripe", "axis": "both", "p": 1.0}]).augment(FRAME, SHIP, seed=int(seed))
        assert json.loads(json.dumps(p.params)) == params["params"] and hashlib.md5(p.doctored.tobytes()).hexdigest() == params["pixels"]


def test_seeds_are_those_of_numpy():
    rows = [(0, 0, 0), (5, 1, 7), (1, draws.COMPOSITE_STREAM, 3), (2**40 + 3, 2, 2**33), (7, 2**32 - 1, 2**32), (2**63 - 1, 2**62, 2**61)]
    assert draws._entropy(list(zip(*rows))).tolist() == [draws.seed_words(*r) for r in rows]


def test_repeated_ops_are_numbered():
    p = Augmenter(ops=["gain", "gain", "gain"]).augment(FRAME, SHIP, seed=0)
    assert list(p.params["photometric"]) == ["gain", "gain#2", "gain#3"]
    assert set(p.record()) == {"photometric/gain/factor", "photometric/gain#2/factor", "photometric/gain#3/factor", "rect_frac"}


def test_rasters():
    px = np.arange(48, dtype=np.uint8).reshape(6, 8)
    assert np.array_equal(rasters.cut(px, 2, 1, 5, 4), px[1:4, 2:5])
    assert np.array_equal(rasters.cut(px, -2, -2, 4, 4), np.pad(px, ((2, 0), (2, 0)), mode="reflect")[:6, :6])
    assert (rasters.cut(px, 7, 0, 12, 6) == px[:, 7:8]).all()
    with pytest.raises(ValueError):
        rasters.cut(px, 20, 20, 30, 30)
    assert np.array_equal(rasters.warp(px.astype(np.float32), np.eye(3), (6, 8)), px)
    assert rasters.shrink(np.full((345, 345), 77, np.uint8), 256).tolist() == np.full((256, 256), 77).tolist()
    assert rasters.shrink(np.arange(16, dtype=np.float64).reshape(4, 4), 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert rasters.uint8_rgb(np.array([[0.0, 0.5], [0.75, 1.0]])).tolist() == [[[0] * 3, [127] * 3], [[191] * 3, [255] * 3]]
    assert rasters.uint8_rgb(np.full((2, 2), 9, np.uint16)).max() == 0


def source(spark, frames=4):
    rows = [(f"f{i}", i, (240, 320, 1, rasters.synthetic_frame(seed=i).tobytes())) for i in range(frames)]
    f = spark.createDataFrame(rows, "path string, frame_ord long, image struct<height:int,width:int,nChannels:int,data:binary>")
    det = [(f"f{i}", o, (*b, s, "ship")) for i in range(frames) for o, (b, s) in enumerate([(SHIP, 0.9), ((40.0, 150.0, 78.0, 166.0), 0.6)])]
    index = ExampleIndex.build(spark.createDataFrame(det, f"path string, ord long, box {BOX}"), f.select("path", "frame_ord"))
    return PairSource(index, f.select("path", "image"), seed=5)


def keys(pairs, pos=True):
    return pairs.select(*(["pos"] if pos else []), "idx", F.md5("pair.clean").alias("clean_key"), F.md5("pair.doctored").alias("pair_key"))


def test_pairs_are_functions_of_seed_epoch_and_index(spark):
    s = source(spark)
    assert len(s) == 8
    assert checks.generator_problems(lambda e: keys(s.epoch(e)), 8).count() == 0
    whole = {r.idx: r.pair_key for r in keys(s.pairs(epoch=1), False).collect()}
    part = PairSource(s.index.slice(2, 5), s.frames, seed=5)
    assert {r.idx: r.pair_key for r in keys(part.pairs(epoch=1), False).collect()} == {i: whole[i] for i in (2, 3, 4)}
    run = s.stream(2)
    assert [r.j for r in run.select("j").orderBy("j").collect()] == list(range(16))
    assert {r.idx: r.pair_key for r in keys(run.where("epoch = 1"), False).collect()} == whole


def test_a_wobbly_target_is_told(spark):
    s = source(spark, 3)
    wobbly = lambda e: keys(s.epoch(e)).withColumn("clean_key", F.concat("clean_key", F.lit(str(e))))
    assert [r.rule for r in checks.generator_problems(wobbly, 6).collect()] == ["target changes"]


def test_pair_column_is_the_augmenter(spark):
    s = source(spark, 1)
    r = s.pairs(epoch=0).where("idx = 0").first()
    px = pixels_of(r.patch.data, r.patch.height, r.patch.width, 1, "uint8")
    inside = tuple(v - o for v, o in zip(SHIP, (r.window.x_min, r.window.y_min) * 2))
    want = Augmenter().augment(px, inside, seed=draws.seed_words(5, 0, 0))
    assert bytes(r.pair.doctored) == want.doctored.tobytes() and json.loads(r.pair.params) == json.loads(json.dumps(want.params))
    t = training_rows(s.pairs(epoch=0), with_params=True).where("idx = 0").first()
    assert len(t.clean) == 256 * 256 and t.clean[:3] == pytest.approx([v / 255 for v in px.ravel()[:3]]) and t.params


def test_windows_outside_their_frame_give_no_patch(spark):
    s = source(spark, 1)
    w = boxes.make(9000.0, 9000.0, 9256.0, 9256.0)
    assert s.frames.select(patch_column(F.col("image"), w)["data"].alias("d")).first().d is None


@pytest.mark.parametrize(("into", "placement"), [("real", "detection"), ("real", "lower"), ("self", "detection")])
def test_composites(spark, into, placement):
    s = source(spark, 2)
    ex = s.index.examples.join(s.frames, "path").select("idx", "box", "image")
    got = composites.composites(ex, ex, seed=1, into=into, placement=placement, length=5).orderBy("i").collect()
    assert [r.i for r in got] == list(range(5)) and all(r.has_target == (into == "self") for r in got)
    for r in got:
        patch, host, mask = (np.frombuffer(r[c], t).reshape(256, 256) for c, t in (("patch", np.uint8), ("host_patch", np.uint8), ("mask", np.float32)))
        assert not ((patch != host) & (mask == 0)).any() and (patch != host).any()
        assert r.seed == draws.seed_words(1, 0xC0FFEE, r.i) and r.host_idx == r.i % 4
    again = composites.composites(ex.repartition(3), ex, seed=1, into=into, placement=placement, length=5).orderBy("i").collect()
    assert [bytes(r.patch) for r in again] == [bytes(r.patch) for r in got]


def test_bad_options(spark):
    s = source(spark, 1)
    ex = s.index.examples.join(s.frames, "path").select("idx", "box", "image")
    for bad in ({"into": "other"}, {"placement": "other"}, {"donor_box": "other"}):
        with pytest.raises(ValueError):
            composites.composites(ex, ex, **bad)


def most_held(spark, pasted: bool = False, ops=()) -> int:
    """The most rendered pairs that a worker holds at a time."""

    class Counted(Augmenter):
        def render(self, image, draft, source=None):
            import gc

            made = super().render(image, draft, source)
            made.params["held"] = sum(type(x).__name__ == "Pair" for x in gc.get_objects())
            return made

    px = F.struct(F.lit(96).alias("height"), F.lit(128).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.repeat(F.lit("0A"), 96 * 128)).alias("data"))
    rows = spark.range(0, 120, 1, 1).withColumn("image", px).withColumn("box", boxes.make(*map(F.lit, (30.0, 30.0, 74.0, 62.0))))
    pair = pair_column(Counted(ops=ops if ops is None else list(ops)), F.col("image"), F.col("box"), F.col("id"), source=F.col("image") if pasted else None)
    got = rows.withColumn("pair", pair).select("id", "pair.seed", "pair.params").collect()
    assert sorted((r.id, r.seed) for r in got) == [(i, i) for i in range(120)]
    return max(json.loads(r.params)["held"] for r in got)


def test_pairs_of_a_batch_are_not_all_held(spark):
    assert most_held(spark) < 5


def test_pictures_go_to_python_in_small_batches(spark, sf):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    pairs.pair_without_ops(spark, sf)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(PART_BYTES)


@pytest.mark.parametrize("query", ["pair_without_ops", "pasted_patch"])
def test_pictures_go_in_small_batches_in_the_session_given(spark, sf, query):
    other = spark.newSession()
    getattr(pairs, query)(other, sf)
    assert other.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(PART_BYTES)


def test_fields_of_a_pair_that_are_asked_for_alone_come_back(spark):
    px = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), F.unhex(F.repeat(F.lit("0A"), 64)).alias("data"))
    rows = spark.range(3).withColumn("image", px).withColumn("box", boxes.make(*map(F.lit, (2.0, 2.0, 6.0, 6.0))))
    whole, some = (rows.withColumn("pair", pair_column(Augmenter(), F.col("image"), F.col("box"), F.col("id"), fields=f)) for f in (None, ("skipped", "mask", "seed")))
    assert some.select("pair.*").columns == ["skipped", "mask", "seed"] and len(whole.select("pair.*").columns) == 11
    assert some.select("id", "pair.*").collect() == whole.select("id", "pair.skipped", "pair.mask", "pair.seed").collect()
    with pytest.raises(ValueError):
        pair_column(Augmenter(), F.col("image"), F.col("box"), F.col("id"), fields=("masks",))


def test_pasted_pairs_are_not_all_held(spark):
    assert most_held(spark, pasted=True) < 5


def test_pairs_of_the_whole_recipe_are_not_all_held(spark):
    assert most_held(spark, ops=None) < 5


def asked_for(monkeypatch, module, query: str, spark, sf) -> tuple | None:
    """The fields of a pair that a query has handed back; None: all."""
    asked, whole = [], module.pair_column
    monkeypatch.setattr(module, "pair_column", lambda *a, fields=None, **b: asked.append(fields) or whole(*a, fields=fields, **b))
    getattr(module, query)(spark, sf)
    return asked[0]


def test_pasted_pairs_come_back_without_their_masks(spark, sf, monkeypatch):
    assert asked_for(monkeypatch, pairs, "pasted_patch", spark, sf) == ("doctored",)


def seeds_come_first(df, picture: str) -> bool:
    """Whether no pictures are made beneath the draw of the seeds, by the plan, in which what is beneath a line is further to the right."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    deep = [max(x.find("+- "), x.find(":- ")) for x in lines]
    (drawn,) = [i for i, x in enumerate(lines) if "ArrowEvalPython [" in x and "_seed(" in x]
    beneath = itertools.takewhile(lambda i: deep[i] > deep[drawn], range(drawn + 1, len(lines)))
    return any(picture in x for x in lines) and not any(picture in lines[i] for i in beneath)


@pytest.mark.parametrize("query", ["augment_pairs", "blur_noise_stripe"])
def test_no_pictures_wait_for_seeds(spark, sf, query):
    assert seeds_come_first(getattr(imaging, query)(spark, sf), "frame(")


def test_no_patches_wait_for_seeds(spark):
    s = source(spark, 2)
    assert seeds_come_first(s.pairs(s.index.examples.select("idx", F.lit(1).cast("bigint").alias("epoch"))), "patch(")


def test_parts_are_of_bounded_size():
    sizes = [1 << 20] * 20 + [64 << 20] + [1] * 5
    made = list(parts(iter(sizes), int))
    assert sum(made, []) == sizes and [len(p) for p in made] == [8, 8, 5, 5] and list(parts([], len)) == []

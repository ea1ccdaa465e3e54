"""Training pairs of an example index: random access, epochs, endless visits."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, draws
from ..session import in_small_batches
from . import lifecycle, ordering, rasters
from .augment import Augmenter, pair_column, patch_column, pixels_of
from .index import ExampleIndex


@dataclass
class PairSource:
    """Pairs are functions of (seed, epoch, idx): neither partitions nor workers nor caches change them."""

    index: ExampleIndex
    frames: DataFrame
    augmenter: Augmenter = field(default_factory=Augmenter)
    seed: int = 0
    out_size: int = 256

    def __post_init__(self):
        self._n: int | None = None

    def __len__(self) -> int:
        if self._n is None:
            self._n = self.index.examples.count()
        return self._n

    def crops(self) -> DataFrame:
        """(idx, path, box, window, scale, patch): the same in every epoch. Each frame is read where its examples meet."""
        b = F.col("box")
        rows = self.index.examples.join(self.frames.select("path", "image"), "path").withColumn("window", boxes.window(b, self.out_size))
        rows = rows.withColumn("patch", patch_column(F.col("image"), F.col("window"), self.out_size)).where("patch.data is not null")
        return rows.select("idx", "path", "box", "window", boxes.window_scale(F.col("window"), self.out_size).alias("scale"), "patch")

    def pairs(self, visits: DataFrame | None = None, epoch: int = 0) -> DataFrame:
        """Pairs of the visits (idx, epoch and other columns); without them of the whole index in one epoch."""
        in_small_batches(self.frames.sparkSession)
        crops = self.crops()
        seeded = lambda rows: rows.withColumn("seed", draws.example_seed(self.seed, F.col("epoch"), F.col("idx")))
        # visits get their seeds before they meet the patches, which would wait for the draw in thousands
        rows = seeded(crops.withColumn("epoch", F.lit(epoch).cast("bigint"))) if visits is None else seeded(visits).join(crops, "idx")
        inside = boxes.in_patch(F.col("box"), F.col("window"), F.col("scale"))
        return rows.withColumn("pair", pair_column(self.augmenter, F.col("patch"), inside, F.col("seed")))

    def epoch(self, number: int) -> DataFrame:
        """Pairs with pos, their place in the epoch's order; examples whose window is off their frame keep their number but give no pair."""
        order = ordering.epoch_order(self.index.examples.select("idx"), self.seed, number)
        return self.pairs(order.withColumn("epoch", F.lit(number).cast("bigint")))

    def stream(self, epochs: int) -> DataFrame:
        """A finite run of whole epochs, j its place in the run."""
        return self.pairs(ordering.epochs_order(self.index.examples, self.seed, epochs))

    def stats(self) -> dict:
        """The index's numbers, and how pairs are made of it."""
        return lifecycle.describe(self.index, seed=self.seed, out_size=self.out_size, steps=[s.name for s in self.augmenter.steps])


def planes(px: np.ndarray, normalize: bool) -> np.ndarray:
    """Channels first, in 0..1, or from -1 to 1."""
    x = rasters.float01(np.moveaxis(np.atleast_3d(px), 2, 0))
    return x * np.float32(2) - np.float32(1) if normalize else x


def training_rows(pairs: DataFrame, normalize: bool = False, with_params: bool = False) -> DataFrame:
    """(idx, epoch, seed, height, width, channels, clean, doctored, mask): arrays of floats in channel planes, in 0..1 or about zero, and pos, j if pairs has them."""

    @F.pandas_udf("clean array<float>, doctored array<float>, mask array<float>")
    def tensors(made: pd.DataFrame) -> pd.DataFrame:
        out = {"clean": [], "doctored": [], "mask": []}
        for clean, doctored, mask, *shape, kind in made[["clean", "doctored", "mask", "height", "width", "nChannels", "dtype"]].itertuples(index=False, name=None):
            for name, data in (("clean", clean), ("doctored", doctored)):
                out[name].append(planes(pixels_of(data, *shape, kind), normalize).ravel())
            out["mask"].append(np.frombuffer(mask, np.float32))
        return pd.DataFrame(out)

    p, place = F.col("pair"), [c for c in ("j", "pos") if c in pairs.columns]
    extra = [p["params"].alias("params")] if with_params else []
    rows = pairs.select(*place, "idx", "epoch", "seed", p["height"].alias("height"), p["width"].alias("width"), p["nChannels"].alias("channels"), tensors(p).alias("t"), *extra)
    return rows.select("*", "t.*").drop("t")


def loader(source: PairSource, batch_size: int = 32, repeats: int = 1, shuffle: bool = True, normalize: bool = False, drop_last: bool = True) -> Iterator[dict[str, np.ndarray]]:
    """Batches of `repeats` epochs as stacked arrays (clean, doctored, mask) and their idx, epoch and seed.

    Partitions are fetched one after another, in order, so the driver holds one at a time;
    trainers that read in parallel take training_rows() instead.
    """
    if shuffle:
        visits = ordering.epochs_order(source.index.examples, source.seed, repeats)
    else:
        n = len(source)
        at, epoch = ordering.virtual(F.col("id"), n)
        visits = source.frames.sparkSession.range(n * repeats).select(F.col("id").alias("j"), at.alias("idx"), epoch.alias("epoch"))
    held: list = []

    def stacked() -> dict[str, np.ndarray]:
        shape = [(r.channels, r.height, r.width) for r in held]
        out = {c: np.stack([np.asarray(r[c], np.float32).reshape(s) for r, s in zip(held, shape)]) for c in ("clean", "doctored")}
        out["mask"] = np.stack([np.asarray(r.mask, np.float32).reshape(1, *s[1:]) for r, s in zip(held, shape)])
        return out | {c: np.array([r[c] for r in held], np.int64) for c in ("idx", "epoch", "seed")}

    for row in training_rows(source.pairs(visits), normalize).orderBy("j").toLocalIterator():
        held.append(row)
        if len(held) == batch_size:
            yield stacked()
            held.clear()
    if held and not drop_last:
        yield stacked()

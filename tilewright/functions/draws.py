"""Reproducible draws: functions of (seed, epoch, index), never of partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Marks the stream of epoch orders and that of composites off from the examples' own. Fixed values.
ORDER_STREAM = 0xFFFFFFFF
COMPOSITE_STREAM = 0xC0FFEE


def key(*parts) -> Column:
    return F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def uniform(*parts) -> Column:
    """A number in [0, 1) from 32 bits of the md5 of the parts; any engine with md5 can repeat it."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def between(low, high, *parts) -> Column:
    return F.lit(float(low)) + (F.lit(float(high)) - F.lit(float(low))) * uniform(*parts)


def pick(n: Column, *parts) -> Column:
    """A whole number below n."""
    return F.floor(uniform(*parts) * n).cast("bigint")


def shuffled(*parts) -> Column:
    """A sort key that orders rows at random but reproducibly."""
    return F.md5(key(*parts))


def seed_words(*entropy: int) -> int:
    return int(np.random.SeedSequence([int(x) for x in entropy]).generate_state(1)[0])


def _entropy(numbers: list[np.ndarray]) -> np.ndarray:
    """The first 32 bits that numpy's SeedSequence gives for each row of whole numbers from 0 on, all rows at once.

    The constants are fixed values of that published generator. Each number adds as many 32-bit words as it needs.
    """
    u4 = np.uint32
    numbers = [np.asarray(x, np.uint64) for x in numbers]
    out = np.empty(len(numbers[0]), np.int64)
    wide = np.stack([x >> np.uint64(32) > 0 for x in numbers])
    for shape in np.unique(wide, axis=1).T:
        rows = np.flatnonzero((wide.T == shape).all(axis=1))
        words = [w.astype(u4) for x, two in zip(numbers, shape) for w in ((x[rows] & np.uint64(0xFFFFFFFF), x[rows] >> np.uint64(32)) if two else (x[rows],))]
        words += [np.zeros(len(rows), u4)] * (4 - len(words))
        factor = 0x43B0D7E5

        def stirred(x: np.ndarray) -> np.ndarray:
            nonlocal factor
            x = x ^ u4(factor)
            factor = factor * 0x931E8875 & 0xFFFFFFFF
            x = x * u4(factor)
            return x ^ (x >> u4(16))

        def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            z = x * u4(0xCA01F9DD) - y * u4(0x4973F715)
            return z ^ (z >> u4(16))

        with np.errstate(over="ignore"):
            pool = [stirred(w) for w in words[:4]]
            for i in range(4):
                for j in range(4):
                    if i != j:
                        pool[j] = mixed(pool[j], stirred(pool[i]))
            for w in words[4:]:
                pool = [mixed(p, stirred(w)) for p in pool]
            first = (pool[0] ^ u4(0x8B51F9DD)) * u4(0x8B51F9DD * 0x58F38DED & 0xFFFFFFFF)
            out[rows] = first ^ (first >> u4(16))
    return out


@F.pandas_udf(LongType())
def _seed(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series(_entropy([a, b, c]))


def example_seed(seed, epoch, index: Column) -> Column:
    """The generator seed of one example in one epoch; the size of the index has no part in it."""
    lift = lambda x: x if isinstance(x, Column) else F.lit(int(x))
    return _seed(lift(seed), lift(epoch), index)


def composite_seed(seed, index: Column) -> Column:
    return example_seed(seed, COMPOSITE_STREAM, index)


def epoch_order(n: int, seed: int, epoch: int) -> np.ndarray:
    """The permutation of an epoch, drawn by numpy on the driver."""
    return np.random.default_rng([seed, epoch, ORDER_STREAM]).permutation(n)


def spread_column(n: Column, k: int) -> Column:
    """array<bigint>: spread() for a column of sizes."""
    places = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.rint(i * (n - 1) / max(k - 1, 1)).cast("bigint"))
    return F.when((n > 0) & F.lit(k > 0), F.array_distinct(places)).otherwise(F.array().cast("array<bigint>"))


def spread(n: int, k: int) -> list[int]:
    """Up to k different indices spread over 0..n-1, rounded half to even."""
    return list(dict.fromkeys(round(i * (n - 1) / max(k - 1, 1)) for i in range(k))) if n else []

"""Pixel arithmetic as expressions over array<double>, row-major, and affine maps as structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_OF = {"uint8": 255.0, "uint16": 65535.0}


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def to_float01(px: Column, dtype: str) -> Column:
    """By the full range of the type, not of the image; floats are left as they are."""
    return F.transform(px, lambda x: x / F.lit(MAX_OF[dtype])) if dtype in MAX_OF else px


def from_float01(px: Column, dtype: str) -> Column:
    if dtype not in MAX_OF:
        return px
    top = F.lit(MAX_OF[dtype])
    return F.transform(px, lambda x: F.greatest(F.lit(0.0), F.least(top, F.rint(x * top))) + F.lit(0.0))


def stretched_uint8(px: Column) -> Column:
    """0..255 between the image's own limits, cut to whole numbers; a flat image is 0."""
    lo, hi = F.array_min(px), F.array_max(px)
    return F.transform(px, lambda x: F.when(hi <= lo, F.lit(0)).otherwise(F.floor((x - lo) / (hi - lo) * 255)).cast("int"))


def gray_to_rgb(px: Column) -> Column:
    return F.flatten(F.transform(px, lambda x: F.array(x, x, x)))


def to_chw(px: Column, channels: int) -> Column:
    """Interleaved channels to planes."""
    n = (F.size(px) / channels).cast("int")
    plane = lambda c: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(px, i * channels + c))
    return F.when(n > 0, F.flatten(F.array(*[plane(c) for c in range(channels)]))).otherwise(px)


def normalised(px: Column, dtype: str) -> Column:
    """About zero, from -1 to 1."""
    half = MAX_OF.get(dtype, 1.0) / 2
    return F.transform(px, lambda x: x / F.lit(half) - 1) if dtype in MAX_OF else F.transform(px, lambda x: x * 2 - 1)


def gain(px: Column, factor) -> Column:
    return F.transform(px, lambda x: x * factor)


def level(px: Column, delta) -> Column:
    return F.transform(px, lambda x: x + delta)


def gamma(px: Column, g) -> Column:
    return F.transform(px, lambda x: F.pow(clamp01(x), g))


def clipped(px: Column) -> Column:
    return F.transform(px, clamp01)


def difference(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def blend(sub: Column, donor: Column, alpha: Column) -> Column:
    """sub outside, donor (within 0..1) inside."""
    both = F.arrays_zip(sub.alias("s"), donor.alias("d"), alpha.alias("a"))
    return F.transform(both, lambda p: p["s"] * (1 - p["a"]) + clamp01(p["d"]) * p["a"])


def hard_mask(rect_int: Column, width: int, height: int) -> Column:
    """1.0 inside a whole-pixel rectangle [x0, y0, x1, y1), else 0.0."""
    x0, y0, x1, y1 = (F.get(rect_int, F.lit(i)) for i in range(4))

    def at(i: Column) -> Column:
        x, y = i % width, F.floor(i / width)
        return F.when((x >= x0) & (x < x1) & (y >= y0) & (y < y1), F.lit(1.0)).otherwise(F.lit(0.0))

    return F.transform(F.sequence(F.lit(0), F.lit(width * height - 1)), at)


def mask_bounds(mask: Column, width: int) -> Column:
    """array<bigint> [x0, y0, x1, y1) around the places over one half; zeros if there are none."""
    on = F.filter(F.transform(mask, lambda v, i: F.when(v > 0.5, i)), lambda i: i.isNotNull())
    xs, ys = F.transform(on, lambda i: i % width), F.transform(on, lambda i: F.floor(i / width).cast("int"))
    ends = (F.array_min(xs), F.array_min(ys), F.array_max(xs) + 1, F.array_max(ys) + 1)
    return F.array(*[F.coalesce(e.cast("bigint"), F.lit(0)) for e in ends])


def mask_share(mask: Column) -> Column:
    return F.size(F.filter(mask, lambda v: v > 0.5)) / F.size(mask)


def mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x) / F.size(px)


def deviation(px: Column) -> Column:
    """Population standard deviation."""
    m = mean(px)
    return F.sqrt(F.aggregate(px, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(px))


def is_flat(px: Column) -> Column:
    return deviation(px) < 1e-3


def quantile(px: Column, q: float) -> Column:
    """Linear between the two nearest ranks."""
    s, at = F.array_sort(px), (F.size(px) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(px) - 1))
    return a + (b - a) * (at - low)


def stretched(px: Column, low: float = 1.0, high: float = 99.5, ref: Column | None = None) -> Column:
    """0..1 between two percentiles of ref (the image itself by default); flat images are 0."""
    ref = px if ref is None else ref
    limits = F.struct(quantile(ref, low / 100).alias("lo"), quantile(ref, high / 100).alias("hi"))
    return F.transform(F.array(limits), lambda l: F.transform(px, lambda x: F.when(l["hi"] > l["lo"], clamp01((x - l["lo"]) / (l["hi"] - l["lo"]))).otherwise(F.lit(0.0))))[0]


def level_match(donor: Column, host: Column, alpha: Column) -> Column:
    """struct(gain, bias) that gives the donor the host's mean and deviation where alpha is over one half.

    The gain lies within 0.2..5, and is 1 where the donor is flat; fewer than 8 pixels change nothing.
    """
    inside = lambda px: F.transform(F.filter(F.arrays_zip(px.alias("p"), alpha.alias("a")), lambda z: z["a"] > 0.5), lambda z: z["p"])
    d, h = inside(donor), inside(host)
    g = F.when(deviation(d) > 1e-3, F.greatest(F.lit(0.2), F.least(F.lit(5.0), deviation(h) / deviation(d)))).otherwise(F.lit(1.0))
    enough = F.size(d) >= 8
    return F.struct(F.when(enough, g).otherwise(F.lit(1.0)).alias("gain"), F.when(enough, mean(h) - g * mean(d)).otherwise(F.lit(0.0)).alias("bias"))


# -- affine maps: struct(a, b, c, d, e, f) is x' = ax + by + c, y' = dx + ey + f -------


def affine(a, b, c, d, e, f) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n) for n, v in zip("abcdef", (a, b, c, d, e, f))])


def about(cx: Column, cy: Column, a, b, d, e) -> Column:
    """The linear part about a center."""
    lift = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    a, b, d, e = map(lift, (a, b, d, e))
    return affine(a, b, cx - (a * cx + b * cy), d, e, cy - (d * cx + e * cy))


def shift_map(dx, dy) -> Column:
    return affine(1, 0, dx, 0, 1, dy)


def rotate_map(degrees: Column, cx: Column, cy: Column) -> Column:
    t = F.radians(degrees)
    return about(cx, cy, F.cos(t), -F.sin(t), F.sin(t), F.cos(t))


def rescale_map(sx: Column, sy: Column, cx: Column, cy: Column) -> Column:
    return about(cx, cy, sx, 0, 0, sy)


def after(later: Column, m: Column) -> Column:
    """The map that applies m and then `later`."""
    l = later  # noqa: E741
    return affine(
        l["a"] * m["a"] + l["b"] * m["d"], l["a"] * m["b"] + l["b"] * m["e"], l["a"] * m["c"] + l["b"] * m["f"] + l["c"],
        l["d"] * m["a"] + l["e"] * m["d"], l["d"] * m["b"] + l["e"] * m["e"], l["d"] * m["c"] + l["e"] * m["f"] + l["f"],
    )

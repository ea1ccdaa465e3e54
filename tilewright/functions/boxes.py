"""Box geometry as Catalyst expressions over a box struct; the max corner is exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CORNERS, DEFAULT_LABEL, DEFAULT_SCORE


def double(x) -> Column:
    return x.cast("double") if isinstance(x, Column) else F.lit(float(x))


def whole(parts: dict[str, Column]) -> Column:
    """A struct that remembers its parts.

    Without this every field of a struct made here would carry all its other fields
    along, and nested geometry would grow beyond what the analyzer can walk.
    """
    out = F.struct(*[v.alias(n) for n, v in parts.items()])
    out._tilewright_parts = parts
    return out


def part(b: Column, name: str) -> Column:
    parts = getattr(b, "_tilewright_parts", None)
    return parts[name] if isinstance(parts, dict) else b[name]


def make(x_min, y_min, x_max, y_max, score=DEFAULT_SCORE, label=DEFAULT_LABEL) -> Column:
    parts = {n: double(v) for n, v in zip((*CORNERS, "score"), (x_min, y_min, x_max, y_max, score))}
    parts["label"] = label if isinstance(label, Column) else F.lit(label)
    return whole(parts)


def moved(b: Column, x_min: Column, y_min: Column, x_max: Column, y_max: Column) -> Column:
    """b with other corners, its score and label kept."""
    return make(x_min, y_min, x_max, y_max, part(b, "score"), part(b, "label"))


def each_corner(b: Column, x, y) -> Column:
    """b with x applied to both abscissae and y to both ordinates."""
    return moved(b, x(part(b, "x_min")), y(part(b, "y_min")), x(part(b, "x_max")), y(part(b, "y_max")))


def width(b: Column) -> Column:
    return part(b, "x_max") - part(b, "x_min")


def height(b: Column) -> Column:
    return part(b, "y_max") - part(b, "y_min")


def center(b: Column) -> tuple[Column, Column]:
    return (part(b, "x_min") + part(b, "x_max")) / 2, (part(b, "y_min") + part(b, "y_max")) / 2


def area(b: Column) -> Column:
    """Never negative: an inverted side counts as empty."""
    return F.greatest(width(b), F.lit(0.0)) * F.greatest(height(b), F.lit(0.0))


def short_side(b: Column) -> Column:
    return F.least(width(b), height(b))


def long_side(b: Column) -> Column:
    return F.greatest(width(b), height(b))


def expanded(b: Column, frac) -> Column:
    """Each side longer by `frac` of its length, about the center."""
    dx, dy = width(b) * double(frac) / 2, height(b) * double(frac) / 2
    return moved(b, part(b, "x_min") - dx, part(b, "y_min") - dy, part(b, "x_max") + dx, part(b, "y_max") + dy)


def shifted(b: Column, dx, dy) -> Column:
    return each_corner(b, lambda x: x + double(dx), lambda y: y + double(dy))


def scaled(b: Column, s) -> Column:
    """Multiplied about the origin."""
    return each_corner(b, lambda x: x * double(s), lambda y: y * double(s))


def clamp(x: Column, low, high) -> Column:
    """Between low and high; NaN stays NaN, where least() and greatest() would take it for the largest number."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(double(low), F.least(double(high), x)))


def clipped(b: Column, frame_width, frame_height) -> Column:
    return each_corner(b, lambda x: clamp(x, 0, frame_width), lambda y: clamp(y, 0, frame_height))


def rounded(b: Column) -> Column:
    """Grown to whole pixels: floor of the min corner, ceiling of the max corner."""
    return moved(b, F.floor(part(b, "x_min")), F.floor(part(b, "y_min")), F.ceil(part(b, "x_max")), F.ceil(part(b, "y_max")))


def as_int(b: Column) -> Column:
    """array<bigint>: the corners of rounded(), for slicing."""
    return F.array(F.floor(part(b, "x_min")), F.floor(part(b, "y_min")), F.ceil(part(b, "x_max")), F.ceil(part(b, "y_max")))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0 where the union is empty."""
    over = lambda lo, hi: F.greatest(F.lit(0.0), F.least(part(a, hi), part(b, hi)) - F.greatest(part(a, lo), part(b, lo)))
    inter = over("x_min", "x_max") * over("y_min", "y_max")
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def finite(b: Column) -> Column:
    ok = F.lit(True)
    for c in (*CORNERS, "score"):
        ok = ok & part(b, c).isNotNull() & ~F.isnan(part(b, c)) & (F.abs(part(b, c)) < float("inf"))
    return ok


def from_loose(d: Column) -> Column:
    """A box from a struct of every spelling found in box files.

    Corners as x_min.. or bbox [x0, y0, x1, y1] or x0..; score or confidence; label or class.
    """
    corner = lambda i, full, short: F.coalesce(d[full], F.get(d["bbox"], F.lit(i)), d[short])
    return make(
        corner(0, "x_min", "x0"), corner(1, "y_min", "y0"), corner(2, "x_max", "x1"), corner(3, "y_max", "y1"),
        F.coalesce(d["score"], d["confidence"], F.lit(DEFAULT_SCORE)), F.coalesce(d["label"], d["class"], F.lit(DEFAULT_LABEL)),
    )


def from_array(values: Column, label: Column | str = DEFAULT_LABEL) -> Column:
    """A box from [x0, y0, x1, y1] or [x0, y0, x1, y1, score]; a shorter array is an error."""
    checked = F.when(F.size(values) >= 4, values).otherwise(F.raise_error(F.lit("a box needs at least four numbers")))
    return make(*[F.get(checked, F.lit(i)) for i in range(4)], F.coalesce(F.get(checked, F.lit(4)), F.lit(DEFAULT_SCORE)), label)


# -- crop windows ------------------------------------------------------------


def window(det: Column, out_size: int = 256, paste_context: float = 0.15, window_context: float = 0.0) -> Column:
    """The square window around a detection: whole-pixel side of at least out_size, corner rounded half to even."""
    b = expanded(expanded(det, paste_context), window_context)
    side = F.ceil(F.greatest(width(b), height(b), F.lit(float(out_size)))).cast("double")
    cx, cy = center(b)
    x0, y0 = F.rint(cx - side / 2) + F.lit(0.0), F.rint(cy - side / 2) + F.lit(0.0)
    return moved(det, x0, y0, x0 + side, y0 + side)


def window_scale(win: Column, out_size: int = 256) -> Column:
    """Patch pixels for a source pixel."""
    side = width(win)
    return F.when(side == out_size, F.lit(1.0)).otherwise(F.lit(float(out_size)) / side)


def in_patch(b: Column, win: Column, scale) -> Column:
    """A box of the frame in the coordinates of a window's patch; without a window it is there already."""
    inside = scaled(shifted(b, -part(win, "x_min"), -part(win, "y_min")), scale)
    return F.when(win.isNull(), b).otherwise(inside)


def roi(rect: Column, frame_width, frame_height) -> Column:
    """The region to work on around a rectangle: half its longer side and 16 pixels more each way, within the frame."""
    r = rounded(rect)
    pad = F.ceil(F.lit(0.5) * long_side(rect)) + 16
    return clipped(moved(r, part(r, "x_min") - pad, part(r, "y_min") - pad, part(r, "x_max") + pad, part(r, "y_max") + pad), frame_width, frame_height)


def zoom(rect: Column, frame_width, frame_height, margin: float = 0.45) -> Column:
    """A rectangle with `margin` of its longer side around it, within the frame."""
    pad = long_side(rect) * margin
    return clipped(moved(rect, part(rect, "x_min") - pad, part(rect, "y_min") - pad, part(rect, "x_max") + pad, part(rect, "y_max") + pad), frame_width, frame_height)


# -- letterboxing ------------------------------------------------------------


def letterbox(frame_width: Column, frame_height: Column, size: int) -> Column:
    """struct(sx, sy, left, top): a frame fitted into a square, its size cut to whole pixels of at least one."""
    w, h, n = double(frame_width), double(frame_height), F.lit(float(size))
    fit = F.least(n / w, n / h)
    nw, nh = F.greatest(F.floor(w * fit).cast("double"), F.lit(1.0)), F.greatest(F.floor(h * fit).cast("double"), F.lit(1.0))
    return whole({"sx": nw / w, "sy": nh / h, "left": F.floor((n - nw) / 2).cast("double"), "top": F.floor((n - nh) / 2).cast("double")})


def undo_letterbox(b: Column, g: Column) -> Column:
    return each_corner(b, lambda x: (x - part(g, "left")) / part(g, "sx"), lambda y: (y - part(g, "top")) / part(g, "sy"))


def from_center(cx: Column, cy: Column, w: Column, h: Column, score=DEFAULT_SCORE, label=DEFAULT_LABEL) -> Column:
    return make(cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, score, label)


def order_columns(b: Column, ordinal: str) -> list[Column]:
    """Best first: score, then area; equals keep their order."""
    return [part(b, "score").desc(), area(b).desc(), F.col(ordinal).asc()]

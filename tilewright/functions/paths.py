"""Path, name and key expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".pgm")
RESERVED = "__"


def normalised(name: Column) -> Column:
    return F.lower(F.trim(name))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot begins no suffix."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def suffix(path: Column) -> Column:
    return F.regexp_extract(basename(path), r"(?<=.)(\.[^.]+)$", 1)


def is_image(path: Column) -> Column:
    return F.lower(suffix(path)).isin(*IMAGE_SUFFIXES)


def is_reserved(key: Column) -> Column:
    return F.startswith(key, F.lit(RESERVED))


def example_key(path: Column, n: Column) -> Column:
    return F.concat(stem(path), F.lit("#"), n.cast("string"))


def resolved(path: Column) -> Column:
    """The path without a file: scheme, empty and . parts, each .. taken with the part before it."""
    plain = F.regexp_replace(path, "^file:/*(?=/)", "")
    rooted = F.startswith(plain, F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda x: (x != "") & (x != "."))
    up = lambda done: F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, x: F.when((x == "..") & (rooted | ((F.size(done) > 0) & (F.get(done, F.size(done) - 1) != ".."))), up(done)).otherwise(F.concat(done, F.array(x))))
    return F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(kept, "/"))


def key_forms(path: Column) -> Column:
    """array<struct(priority, form)>: the path itself, its name, its stem, and the path resolved."""
    forms = (path, basename(path), stem(path), resolved(path))
    return F.array(*[F.struct(F.lit(i).alias("priority"), f.alias("form")) for i, f in enumerate(forms)])


def render_parts(path: Column) -> Column:
    """struct(split, scene, modality, stem) around the last `images` part of a path.

    Null where there is none, or too little around it.
    """
    parts = F.split(path, "/")
    back = F.array_position(F.reverse(parts), "images")
    at = F.size(parts) - back.cast("int") + 1  # from one
    part = lambda i: F.get(parts, i - 1)
    known = (back > 0) & (at > 1) & (at + 3 <= F.size(parts))
    return F.when(known, F.struct(part(at - 1).alias("split"), part(at + 1).alias("scene"), part(at + 2).alias("modality"), stem(path).alias("stem")))

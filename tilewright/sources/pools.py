"""Named pools of frames, and what a caller may name instead of one."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths


@dataclass(frozen=True)
class Pool:
    name: str
    patterns: tuple[str, ...]
    kind: str = "real"
    detector: str | None = None
    note: str = field(default="", compare=False)


_pools: dict[str, Pool] = {}


def register(pool: Pool) -> Pool:
    """By name, whatever its case; a pool of the same name is replaced."""
    _pools[pool.name.strip().lower()] = pool
    return pool


def configure(settings: dict[str, dict], roots: dict[str, str] | None = None) -> list[Pool]:
    """Pools from settings, as a JSON file may hold them: by name {"patterns": [..], "kind": .., "detector": .., "note": ..} or {"union": [names]}.

    {root} in a pattern stands for the root of that name.
    """
    made = []
    for name, said in settings.items():
        if "union" in said:
            made.append(union(name, *said["union"], note=said.get("note", "")))
        else:
            patterns = tuple(p.format_map(roots or {}) for p in said["patterns"])
            made.append(register(Pool(name, patterns, said.get("kind", "real"), said.get("detector"), said.get("note", ""))))
    return made


def get(name: str) -> Pool:
    key = str(name).strip().lower()
    if key not in _pools:
        raise KeyError(f"no pool {name!r}; there are {', '.join(sorted(_pools))}")
    return _pools[key]


def available() -> dict[str, str]:
    return {k: _pools[k].note for k in sorted(_pools)}


def union(name: str, *parts: str, note: str = "") -> Pool:
    """A pool of the frames of others."""
    return register(Pool(name, tuple(p for part in parts for p in get(part).patterns), get(parts[0]).kind, note=note))


def suggested_detector(spec) -> str:
    """A pool's own detector, else the grid model."""
    pool = _pools.get(str(spec).strip().lower()) if isinstance(spec, str) else None
    return pool.detector if pool is not None and pool.detector else "grid"


def source_name(spec) -> str:
    return spec if isinstance(spec, str) else f"{len(list(spec))} paths"


def expand(spec: str | os.PathLike | Iterable) -> list[str]:
    """Glob patterns or paths for the reader: of a pool, a pattern, a directory, a file, or several of these."""
    if isinstance(spec, (str, os.PathLike)):
        s = str(spec)
        if s.strip().lower() in _pools:
            return list(get(s).patterns)
        return [s]
    if isinstance(spec, Iterable):
        return sorted({p for one in spec for p in expand(one)})
    raise TypeError(f"no frames can be named by {spec!r}")


def scan(spark: SparkSession, spec) -> DataFrame:
    """(path, length): the image files of a spec, each once. Only the listing is read.

    A path that does not exist is a FileNotFoundError.
    """
    from pyspark.errors import AnalysisException

    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(expand(spec))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(spec)) from e
        raise
    return files.select("path", "length").where(paths.is_image(F.col("path"))).distinct()

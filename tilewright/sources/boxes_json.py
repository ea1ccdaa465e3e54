"""Box files: a JSON object of key -> list of boxes; keys from __ on are no frames.

An empty list says that the frame was scanned and has no box; a missing key, that it
was not scanned.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, paths

LOOSE = "array<struct<x_min:double,y_min:double,x_max:double,y_max:double,x0:double,y0:double,x1:double,y1:double,bbox:array<double>,score:double,confidence:double,label:string,class:string>>"


def parsed(entries: DataFrame) -> DataFrame:
    """(key, key_ord, ord, box) from (key_ord, key, list: the boxes as JSON); a key without boxes has one row whose box is null."""
    keys = entries.where(~paths.is_reserved(F.col("key")))
    boxed = keys.select("key", "key_ord", F.posexplode_outer(F.from_json("list", LOOSE)).alias("ord", "b"))
    return boxed.select("key", F.col("key_ord").cast("bigint").alias("key_ord"), F.coalesce("ord", F.lit(0)).cast("bigint").alias("ord"), F.when(F.col("b").isNotNull(), boxes.from_loose(F.col("b"))).alias("box"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, key_ord, ord, box) of a file that holds one object; anything else is an error. One task reads it: see read_lines()."""
    whole = spark.read.text(path, wholetext=True)
    entries = whole.select(F.from_json("value", "map<string,string>").alias("m"), F.trim("value").alias("value"))
    checked = F.when(F.col("m").isNotNull() & F.startswith("value", F.lit("{")), F.col("m")).otherwise(F.raise_error(F.lit("a box file must hold an object")).cast("map<string,string>"))
    return parsed(entries.select(F.posexplode(checked).alias("key_ord", "key", "list")))


def read_lines(lines: DataFrame) -> DataFrame:
    """The same from lines (value) that hold an object each, or from a file that write() made: a key a line, read by many tasks."""
    value = F.regexp_replace(F.trim("value"), "^[{,]|[,}]$", "")
    entries = lines.select(F.monotonically_increasing_id().alias("at"), F.from_json(F.concat(F.lit("{"), value, F.lit("}")), "map<string,string>").alias("m"))
    return parsed(entries.select(F.col("at").alias("key_ord"), F.explode("m").alias("key", "list")))


def meta(spark: SparkSession, path: str) -> dict:
    """What the reserved key __meta__ holds."""
    row = spark.read.text(path, wholetext=True).select(F.get_json_object("value", "$.__meta__").alias("m")).first()
    return json.loads(row.m) if row and row.m else {}


def lines(by_path: DataFrame, form: str = "path") -> DataFrame:
    """(key, value): each frame's boxes as JSON text. form: path, name or stem; of equal keys the last frame's counts."""
    key = {"path": F.col("path"), "name": paths.basename(F.col("path")), "stem": paths.stem(F.col("path"))}[form]
    return by_path.groupBy(key.alias("key")).agg(F.to_json(F.max_by("boxes", "frame_ord")).alias("value"), F.max("frame_ord").alias("ord"))


def write(by_path: DataFrame, path: str, meta_: dict | None = None, form: str = "path") -> None:
    """One file, for exchange with other tools: (path, frame_ord, boxes) row by row, so the driver holds a partition at most.

    Within the engine the index's parquet tables are used instead.
    """
    rows = lines(by_path, form).orderBy("ord").toLocalIterator()
    with open(path, "w", encoding="utf-8") as f:
        f.write("{" + json.dumps("__meta__") + ": " + json.dumps(meta_ or {}))
        for r in rows:
            f.write(",\n" + json.dumps(r.key) + ": " + r.value)
        f.write("}\n")

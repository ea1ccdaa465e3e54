"""What the operators of this subpackage share: tables, stage tables and expression helpers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import in_small_batches, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tilewright/{name}-{uuid.uuid4().hex}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the stage tables in the shared folder, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tilewright")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a file of a stage table, at least, where their number is known.
FILE_ROWS = 20_000


def stage(df: DataFrame, name: str, codec: str = "snappy", rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs no more than its own tasks.
    rows: a bound of the number of its rows, for tables of few columns: no more files are written than these need.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    path = stage_path(spark, name)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def tidy() -> None:
    """Give freed memory of a Python worker back, as workers outlive their tasks."""
    import ctypes
    import sys

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, hot: int = 4) -> DataFrame:
    """rows with the columns of lookup, which has each key once and n, how many rows have it.

    Keys with more than a partition's share of the rows, over `hot`, are broadcast (`hot` x
    partitions of them at most), so none of them is gathered in a task. Both should be written tables.
    """
    parts = hot * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.sum("n")).first()[0] or 0
    common = lookup.where(F.col("n") * parts > total)
    if not common.take(1):
        return rows.join(lookup, key)
    rest = rows.join(F.broadcast(common.select(key)), key, "left_anti").join(lookup.where(F.col("n") * parts <= total), key)
    return rows.join(F.broadcast(common), key).unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else.

    lower() does exactly that where every character is one byte long; other texts
    take the slower translate().
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def row_share(*keys: Column) -> Column:
    """A reproducible number in [0, 1) from the keys of a row."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def crc_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % F.lit(divisor)

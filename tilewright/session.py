"""The session: the folder that driver and executors share, and the size of what is handed to Python."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the folder that checkpoints go to already.

    Only where there is neither, and all runs on one machine (tests, a laptop), is a temporary folder made.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    known = sc._jsc.sc().getCheckpointDir()
    if not folder and known.isDefined():
        return known.get()
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tilewright-")
    if not known.isDefined():
        sc.setCheckpointDir(folder)
    return folder


#: Bytes of texts or pictures that go to Python, or come back, at once.
PART_BYTES = 8 << 20


def in_small_batches(spark: SparkSession) -> None:
    """Have texts and pictures handed to Python in batches of a few MB, from now on in this session, unless it asks for another size."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, str(64 << 20)).rstrip("bB") == str(64 << 20):  # Spark's own default
        spark.conf.set(name, str(PART_BYTES))

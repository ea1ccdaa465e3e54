"""Stage tables and joins with hot keys."""

import pytest
from pyspark.sql import functions as F

from tilewright.llm import common


def test_stages_are_cleared(spark):
    df = common.stage(spark.range(100_000, numPartitions=9), "test", rows=100_000)
    assert df.count() == 100_000 and len(df.inputFiles()) == 6
    common.clear_stages(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        spark.read.schema(df.schema).parquet(*df.inputFiles()).count()


@pytest.mark.parametrize("rows", [[0] * 900 + list(range(1, 100)), list(range(50)), [], [None, 7, 7]])
def test_hot_join_is_a_join(spark, rows):
    left = spark.createDataFrame([(i, k) for i, k in enumerate(rows)], "i long, k long")
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2)
    got = sorted((r.i, r.v) for r in common.hot_join(left, right, "k").collect())
    assert got == [(i, 2 * k) for i, k in enumerate(rows) if k is not None]

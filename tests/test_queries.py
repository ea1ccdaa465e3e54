"""Every registered query of the engine against its SQL on the same tables."""

import glob
import os

import duckdb
import pytest

from tilewright.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns) and len(got) == len(want) > 0
    rows = lambda d: d[cols].astype(str).sort_values(cols).reset_index(drop=True)
    assert rows(got).equals(rows(want))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_repeats_itself_over_other_partitions(spark, name):
    sf = "/root/testdata/sf0.001"
    first = sorted(map(str, QUERIES[name](spark, sf).collect()))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert first and sorted(map(str, QUERIES[name](spark, sf).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

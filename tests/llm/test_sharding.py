import math
import struct
import zlib
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from tilewright.llm import sharding


def test_query(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = sharding.op8_sharding(spark, sf).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in got} == {d: (len(t.encode()) + 16, zlib.crc32(t.encode())) for d, t in texts.items()}
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_only_the_new_shard_takes_rows_and_weights_hold(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id")
    w = [1.0, 2.0, 0.0, 1.0]
    rows = df.select(sharding.best_shard(F.col("doc_id"), w).alias("a"), sharding.best_shard(F.col("doc_id"), [*w, 1.0]).alias("b"), sharding.best_shard(F.col("doc_id"), [*w[:3], 0.0]).alias("c")).collect()
    n = Counter(r.a for r in rows)
    assert n[2] == 0 and abs(n[1] / 20_000 - 0.5) < 0.02 and abs(n[0] / 20_000 - 0.25) < 0.02
    assert all(r.b in (r.a, 4) for r in rows) and abs(sum(r.b == 4 for r in rows) / 20_000 - 0.2) < 0.02
    assert all(r.c == r.a for r in rows if r.a != 3)  # a shard that goes leaves the others' rows alone


def test_edge_rows(spark, tmp_path):
    long = "x" * 2_000_000
    rows = [(None, None, "s"), (None, "", "s"), (1, "é", "s"), (1, "é", "s"), (1, "other", None), (2, long, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, shard string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op8_sharding(spark, str(tmp_path)).collect()
    assert sorted(r["size"] for r in got) == [16, 16, 18, 18, 21, 2_000_016]
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in got if r.doc_id == 1}) == 1
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/empty/documents.parquet")
    assert sharding.op8_sharding(spark, f"{tmp_path}/empty").count() == 0


def spark_hash(*parts):
    """xxhash64() of numbers: bytes (long) or 4 bytes (int) chained by their seeds."""
    h = 42
    for p in parts:
        h = xxhash.xxh64_intdigest(p, h)
    return h


def test_the_winner_is_brute_force(spark, sf):
    """Every key goes to the shard of the highest score, recomputed for each of them."""
    for n, column in ((40, "shard"), (41, "grown_shard")):
        for r in sharding.op8_sharding(spark, sf).collect():
            key = struct.pack("<q", r.doc_id)
            u = [((spark_hash(key, struct.pack("<i", s)) >> 11) + 0.5) / 2**53 for s in range(n)]
            assert r[column] == max(range(n), key=lambda s: (-1 / math.log(u[s]), -s))


def test_rows_of_one_key_are_spread(spark):
    """A third of all rows are equal: slots are gapless, and no part of a bucket holds them all."""
    df = spark.createDataFrame([(5, "x")] * 3000 + [(i, "y") for i in range(10, 6010)], "doc_id long, shard string")
    got = sharding.assign(df, F.col("doc_id"), [1.0, 1.0, 1.0], rows_a_bucket=100)
    assert got.columns == ["doc_id", "shard", "slot"]
    slots = defaultdict(list)
    for r in got.collect():
        slots[r.shard].append(r.slot)
    assert sum(map(len, slots.values())) == 9000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.slot for r in sharding.assign(df.where("doc_id > 5").repartition(7), F.col("doc_id"), [1.0, 1.0, 1.0], rows_a_bucket=100).collect()}
    once = {r.doc_id: r.slot for r in sharding.assign(df.where("doc_id > 5"), F.col("doc_id"), [1.0, 1.0, 1.0], rows_a_bucket=100).collect()}
    assert again == once

"""Queries take every row of their tables."""

from tilewright.plans.registry import QUERIES


def test_repeated_op_names_numbers_every_event(spark, tmp_path):
    rows = [(i, 150 + i % 100, "view") for i in range(500)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = QUERIES["repeated_op_names"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, r.user_id, r.key) for r in got) == [(i, u, "view" if i < 100 else f"view#{i // 100 + 1}") for i, u, _ in rows]

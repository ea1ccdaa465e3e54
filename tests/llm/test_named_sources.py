"""Target weights hold however many sources there are."""

import pytest

from tilewright.llm import packing


def test_weights_hold_with_more_sources_than_queues(spark):
    rows = [(100 * s + i, "some words of a plain text here " * 5, f"s{s:02}") for s in range(12) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(df, {"s03": 0.6, "s07": 0.3, "absent": 9.0}, queues=5, window=64, quantum=8).collect()
    early = [r for r in got if r.sequence_id < 8]
    share = lambda s: sum(r.length for r in early if r.doc_id // 100 == s) / sum(r.length for r in early)
    rest = 10 / 12  # the natural share of the sources without a weight
    assert abs(share(3) - 0.6 / (0.9 + rest)) < 0.03 and abs(share(7) - 0.3 / (0.9 + rest)) < 0.03
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in {r.doc_id: r for r in got}.values())
    assert len({r.queue for r in got if r.doc_id // 100 in (3, 7)}) == 2
    with pytest.raises(ValueError):
        packing.pack(df, {f"s{s:02}": 1.0 for s in range(5)}, queues=5)

import hashlib

import numpy as np
import pytest

from tilewright.llm import warc
from tilewright.llm.common import stage_path


def test_loser_tree_is_a_merge():
    rng = np.random.default_rng(0)
    for k in (0, 1, 2, 3, 7, 20):
        runs = [sorted(rng.integers(0, 30, int(rng.integers(0, 40))).tolist()) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    last = {}
    for r in pages:
        last[r.html] = max(last.get(r.html, r.page_id), r.page_id)
    want = {}
    for r in pages:
        body = (r.html or "").encode()
        again = len(body) >= 1000 and last[r.html] != r.page_id
        want[r.page_id] = (len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last[r.html] if again else None)
    got = warc.op5_warc(spark, sf).collect()
    assert {r.page_id: tuple(r)[1:5] for r in got} == want
    history = sorted(got, key=lambda r: (r.url_key.encode(), r.stamp, r.page_id))
    assert [r.position for r in history] == list(range(len(pages)))


def round_trip(spark, rows, ranges=3):
    path = stage_path(spark, "warc-test")
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)
    warc.write_archives(df, path, archive_mb=1)
    return warc.merge_runs(warc.read_archives(spark, path), ranges).collect()


def test_edge_rows(spark):
    tricky = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40
    big, long = "same é" * 300, "long " * 500_000
    rows = [
        (1, "http://B.example.com/a", big, "c"), (2, None, big, "c"), (3, "http://b.example.com/a", big, "c"), (3, "http://b.example.com/a", big, "c"), (4, "no scheme", None, None), (None, "http://a.org", big, "c"),
        (5, "https://a.org/x?y#z", "short", ""), (6, "https://a.org/x?y", "short", ""), (7, "http://c.net/\r\n", tricky, ""), (8, "http://c.net/", tricky, ""), (9, "http://c.net/long", long, ""), (10, "", "", ""),
    ]
    got = round_trip(spark, rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got if r.payload_bytes >= 1000)
    assert kinds == [(0, "response", None), (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "revisit", 3), (7, "revisit", 8), (8, "response", None), (9, "response", None)]
    assert len(got) == len(rows)
    sizes = sorted(r.payload_bytes for r in got)
    assert sizes == sorted(len((r[2] or "").encode()) for r in rows)
    order = sorted(got, key=lambda r: r.position)
    assert [r.position for r in order] == list(range(len(rows)))
    keys = [(r.url_key.encode(), r.stamp, r.page_id if r.page_id is not None else -1) for r in order]
    assert keys == sorted(keys)
    assert "com,example,b)/a" in {r.url_key for r in got}


def test_empty(spark):
    assert round_trip(spark, []) == []


def test_broken_archives_are_told():
    good = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 6\r\n\r\nh\r\n\r\nxx\r\n\r\n"
    with pytest.raises(ValueError):
        list(warc.parse(good))
    with pytest.raises(ValueError):
        list(warc.parse(b"nothing"))


def test_archives_are_bounded_by_bytes(spark):
    """Pages of very different sizes: no archive has over WIDE times its size, but for single records; all come back."""
    path = stage_path(spark, "warc-test")
    rows = [(i, f"http://a.org/{i}", f"{i} " + "x" * (900_000 if i % 10 == 0 else 30_000_000 if i == 55 else 200)) for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, path, archive_mb=1)
    files = spark.read.format("binaryFile").load(path).select("length").collect()
    assert len(files) > 3 and all(f.length <= warc.WIDE * (1 << 20) or f.length > 30_000_000 for f in files)
    assert sorted((r.page_id, r.payload_bytes) for r in warc.read_archives(spark, path).collect()) == [(i, len(h)) for i, _, h in rows]


def test_size_groups_hold_their_bound():
    rng = np.random.default_rng(3)
    for _ in range(200):
        size = np.exp(rng.normal(8, rng.uniform(0, 4), int(rng.integers(1, 400)))).astype(int) + warc.HEAD
        power = np.ceil(np.log2(size)).astype(int)
        groups = warc.size_groups({int(p): (int((power == p).sum()), int(size[power == p].sum())) for p in set(power)}, 1 << 20)
        held = np.zeros(len(size), int)
        for over, up_to, records in groups:
            mine = (size > over) & (size <= up_to)
            held += mine
            assert records == 1 or not mine.any() or records * size[mine].max() <= warc.WIDE << 20
        assert (held == 1).all()
    assert warc.size_groups({}, 1 << 20)


def test_equal_pages_are_spread(spark):
    """A third of all pages are the same row, a third have no id: one response, every entry has a place of its own."""
    rows = [(7, "http://a.org/", "same " * 300)] * 400 + [(None, "http://b.org/", "none " * 300)] * 400 + [(1000 + i, f"http://c.org/{i % 5}", f"own {i}") for i in range(400)]
    path = stage_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), path)
    got = warc.merge_runs(warc.read_archives(spark, path), 12).collect()
    assert sorted(r.position for r in got) == list(range(1200))
    assert sorted(r.record_type for r in got if r.page_id == 7) == ["response"] + ["revisit"] * 399
    assert all(r.record_type == "response" for r in got if r.page_id is None)

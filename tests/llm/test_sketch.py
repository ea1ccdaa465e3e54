import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import sketch


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def exact_sketch(text):
    """The sketch, recomputed: XXH64 of each word, chained over five of them, the smallest 128 as signed numbers."""
    w = [xxhash.xxh64_intdigest(x.encode(), 42).to_bytes(8, "little") for x in re.split(r"[\x20\x09-\x0D]+", text.lower()) if x]
    out = set()
    for i in range(max(1, len(w) - 4) if w else 0):
        h = 42
        for x in w[i : i + 5]:
            h = xxhash.xxh64_intdigest(x, h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return sorted(out)[: sketch.K]


def exact_likeness(a, b):
    both = sorted(set(a) | set(b))[: sketch.K]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def exact_count(a):
    return len(a) if len(a) < sketch.K else (sketch.K - 1) / ((a[-1] + 2.0**63 + 1) / 2.0**64)


def as_hex(a):
    return "".join(f"{x % (1 << 64):016x}" for x in a)


def edited(text, follower):
    n = len(text) // 4
    return text[: len(text) - n] + follower[:n]


def check(got, docs, tolerance):
    docs = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [t or "" for _, t in docs]
    off = 0
    for i, (doc_id, _) in enumerate(docs):
        nxt = texts[(i + 1) % len(texts)]
        r = got[doc_id]
        e = edited(texts[i], nxt)
        assert r.n_chars == len(texts[i])
        assert r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), doc_id
        own, of_edited, of_next = exact_sketch(texts[i]), exact_sketch(e), exact_sketch(nxt)
        assert (r.fingerprint, r.edited_fingerprint) == (as_hex(own), as_hex(of_edited))
        assert (r.near_edited, r.near_next) == pytest.approx((exact_likeness(own, of_edited), exact_likeness(own, of_next)), abs=1e-12)
        n, m = exact_count(own), exact_count(of_edited)
        j = exact_likeness(own, of_edited)
        assert r.n_shingles == pytest.approx(n) and r.kept_by_edited == pytest.approx(min(1.0, j / (1 + j) * (n + m) / n) if own else 1.0)
        for likeness, other in ((r.near_edited, e), (r.near_next, nxt)):
            exact = jaccard(texts[i], other)
            small = len(shingles(texts[i])) < sketch.K and len(shingles(other)) < sketch.K
            off = max(off, abs(likeness - exact))
            assert likeness == pytest.approx(exact, abs=1e-12 if small and len(shingles(texts[i]) | shingles(other)) <= sketch.K else tolerance)
    return off


def test_query_is_brute_force(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in sketch.op9_fingerprint(spark, sf).collect()}
    assert len(got) == len(docs)
    check(got, docs, 0.2)
    by = {}
    for doc_id, text in docs:
        by.setdefault(text, set()).add(got[doc_id].fingerprint)
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) > len(by) * 0.9


@pytest.mark.parametrize("blocks", [1, 3, 50])
def test_edge_rows_and_blocks(spark, tmp_path, blocks, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCKS", blocks)
    long = " ".join(f"w{i % 5000}" for i in range(60_000))
    rows = [(1, None, "x"), (5, "", "x"), (6, "é" * 9, "x"), (7, "One two three", "y"), (20, "one TWO three", "y"), (21, long, "y"), (22, long + " end", "z"), (None, "no id at all", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sk string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sketch.op9_fingerprint(spark, str(tmp_path)).collect()}
    check(got, [(r[0], r[1]) for r in rows], 0.1)
    assert got[7].fingerprint == got[20].fingerprint and got[1].fingerprint == got[5].fingerprint == ""


def test_repeated_rows_and_one_row(spark, tmp_path):
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (4, "x")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/a/documents.parquet")
    got = sketch.op9_fingerprint(spark, f"{tmp_path}/a").collect()
    assert sorted((r.doc_id, r.near_next) for r in got) == [(3, 0.0), (3, 1.0), (4, 0.0)]
    spark.createDataFrame([(9, "only one here")], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    (r,) = sketch.op9_fingerprint(spark, f"{tmp_path}/b").collect()
    assert r.near_next == 1.0
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/c/documents.parquet")
    assert sketch.op9_fingerprint(spark, f"{tmp_path}/c").count() == 0


def test_sketches_merge(spark):
    a, b = " ".join(f"w{i}" for i in range(900)), " ".join(f"w{i}" for i in range(450, 1500))
    df = spark.createDataFrame([("g", a), ("g", b)], "g string, t string").withColumn("sk", sketch.sketch(F.col("t")))
    merged = sketch.merge_all(df, ["g"], "sk").first().sk
    x, y = (r.sk for r in df.collect())
    pair = spark.createDataFrame([(x, y)], "x array<bigint>, y array<bigint>")
    c = F.col
    r = pair.select(sketch.merge(c("x"), c("y")).alias("m"), sketch.distinct_count(c("x")).alias("n"), sketch.containment(c("x"), c("y")).alias("c"), sketch.resemblance(c("x"), c("y")).alias("j")).first()
    assert merged == r.m and len(merged) == sketch.K
    assert r.n == pytest.approx(896, rel=0.35)
    assert r.c == pytest.approx(446 / 896, abs=0.2)
    assert r.j == pytest.approx(jaccard(a, b), abs=0.15)


@pytest.mark.parametrize("blocks", [2, 40])
def test_hot_ids_and_equal_rows(spark, monkeypatch, blocks):
    """A third of the rows are equal, a third share an id: each has the row that follows next, whatever the blocks."""
    monkeypatch.setattr(sketch, "HOT", 150)
    rows = [(50, "equal row")] * 300 + [(70, f"text {i}") for i in range(300)] + [(i, f"own {i}") for i in range(300) if i not in (50, 70)] + [(None, f"none {i}") for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("__key", F.lit("k")).withColumn("next_text", F.lit("clash"))
    got = sketch.with_next(df, "doc_id", ["text"], F.xxhash64("text"), {"size": F.length("text")}, blocks)
    assert got.columns == ["doc_id", "text", "__key", "size", "next_text", "next_size"]
    got = got.collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (lambda h: h - (1 << 64) if h >> 63 else h)(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = sorted(((*r, order[(i + 1) % len(order)][1]) for i, r in enumerate(order)), key=str)
    assert sorted(((r.doc_id, r.text, r.next_text) for r in got), key=str) == want
    assert all(r.next_size == len(r.next_text) and r["__key"] == "k" for r in got)

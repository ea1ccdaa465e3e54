import zlib

import numpy as np

from tilewright.llm import quality


def brute_score(m, idx, val):
    s = m.bias + float((m.w[idx] * val).sum())
    for i in range(len(idx)):
        for j in range(i + 1, len(idx)):
            s += float(m.v[idx[i]] @ m.v[idx[j]]) * float(val[i]) * float(val[j])
    return s


def test_sum_of_squares_is_all_pairs():
    rng = np.random.default_rng(0)
    m = quality.Machine(0.3, rng.normal(size=quality.N).astype(np.float32), rng.normal(size=(quality.N, quality.FACTORS)).astype(np.float32) * 0.3)
    texts = [b"The cat sat on a mat.", b"", b"!!! $$$ %%%", "é ü 東京".encode()]
    start, idx, val = quality.features(texts)
    raw, _ = m.raw(start, idx, val)
    for i in range(len(texts)):
        s = slice(start[i], start[i + 1])
        assert abs(raw[i] - brute_score(m, idx[s], val[s])) < 1e-3


def test_features_do_not_depend_on_neighbours(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [bytes(rng.choice([*b"ab cD1\n.$\xc3"], int(n))) for n in rng.integers(0, 300, 40)]
    s, i, v = quality.features(texts)
    monkeypatch.setattr(quality, "BLOCK", 64)
    s2, i2, v2 = quality.features(texts)
    assert (s == s2).all() and (i == i2).all() and np.allclose(v, v2)
    for k, t in enumerate(texts):
        _, ik, vk = quality.features([t])
        assert (ik == i[s[k] : s[k + 1]]).all() and np.allclose(vk, v[s[k] : s[k + 1]])


def test_query_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op10_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(got) == 1000
    held = [(got[r.doc_id], r.quality) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(g.held_out for g, _ in held)
    good, bad = [g.score for g, q in held if q == 1], [g.score for g, q in held if q == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([g.predicted == q for g, q in held]) > 0.93
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_edge_rows(spark, tmp_path):
    rows = [(i, "plain words of a good text here " * 4, "x") for i in range(30)] + [(100 + i, "BAD!! $$$ " * 12, "x") for i in range(30)]
    rows += [(200, None, "x"), (201, "", None), (None, "plain words", "x"), (202, "word " * 300_000, "x"), (203, "same", "x"), (203, "same", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    lab = [(i, 1, 0) for i in range(30)] + [(100 + i, 0, 0) for i in range(30)] + [(200, 1, 0), (5, None, 0), (5, 1, 0), (None, 1, 0), (999, 0, 0)]
    spark.createDataFrame(lab, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op10_quality(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[3].score > 0.5 > by[103].score
    assert by[200].score == by[201].score


def test_without_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [r.score for r in quality.op10_quality(spark, str(tmp_path)).collect()] == [0.5]


def test_the_sample_is_bounded_whatever_repeats(spark, monkeypatch):
    """A third of the labels and of the documents share an id: no more than `sample` labels are learned from, ids of any type."""
    docs = spark.createDataFrame([("hot", f"text {i} of the hot id") for i in range(200)] + [(f"d{i}", "plain words of a text") for i in range(400)], "doc_id string, text string")
    labels = spark.createDataFrame([("hot", 1)] * 150 + [("hot", 0)] * 150 + [(f"d{i}", i % 2) for i in range(300)], "doc_id string, quality long")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows, y: seen.append(len(rows)) or quality.Machine(0.0, np.zeros(quality.N, np.float32), np.zeros((quality.N, 1), np.float32)))
    size = len(quality.features([b"plain words of a text"])[1])  # those of the hot id have one word more
    for sample, most, want in ((50, 10**9, 50), (10_000, 10**9, 302), (10_000, 300 * size + 1, 300)):
        quality.train(docs, labels, sample, most)
        assert seen[-1] == want

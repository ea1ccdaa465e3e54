"""Near copies at an exact Jaccard similarity, as the pipeline's stage takes them."""

from pyspark.sql import functions as F

import corpus_pipeline
from tilewright.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def smallest(rows):
    """{id: smallest id of its component} over all pairs of (id, text)."""
    root, sets = {i: i for i, _ in rows}, [(i, shingles(t)) for i, t in rows]
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_stage_is_all_pairs_at_080(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = sorted(set(smallest(rows).values()))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in got.collect()) == want


def test_edited_texts_in_large_buckets(spark, monkeypatch):
    """Texts with one word in fifty changed go, those with one in ten stay, however buckets are cut."""
    base = [f"w{i * 7919 % 1000}" for i in range(200)]
    edit = lambda n, tag: " ".join(f"{tag}{i}" if i % n == n // 2 else w for i, w in enumerate(base))
    rows = [(1, " ".join(base)), (None, " ".join(base).upper() + "\n")] + [(i, edit(50, "a") + f" end{i}") for i in range(10, 40)] + [(50, edit(10, "b")), (51, None), (52, " "), (53, "few words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "CHUNK", 4)
    got = simhash.keep_one(df, words=5, least=0.8)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 50, 51, 53]
    assert simhash.keep_one(df.limit(0), words=5, least=0.8).count() == 0


def test_a_large_group_is_not_paired(spark, monkeypatch):
    """Hundreds of near copies in small chunks, and strays in their buckets: components are those of all pairs, and few texts are read."""
    import random

    rng = random.Random(4)
    base = [f"w{i * 7919 % 1000}" for i in range(120)]
    edit = lambda n: " ".join(f"e{rng.random()}" if i in n else w for i, w in enumerate(base))
    rows = [(i, edit({rng.randrange(120)})) for i in range(150)]  # within 0.8 of each other
    rows += [(200 + i, edit(set(rng.sample(range(120), 4)))) for i in range(40)]  # some are, some aren't
    monkeypatch.setattr(simhash, "CHUNK", 8)
    seen, stage = {}, simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name, **k: seen.setdefault(name, []).append(out := stage(df, name, **k)) or out)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=5, least=0.8).collect()}
    want = smallest(rows)
    assert got == want and 1 < len(set(want.values())) < 60
    assert "minhash-large" in seen


def test_fingerprints_link_without_bands(spark, monkeypatch):
    """The stage's pairs come from fingerprints through the pivot tables, and are checked on the texts."""
    keys = simhash.band_keys
    monkeypatch.setattr(simhash, "band_keys", lambda text, words: keys(text, words).withField("bands", F.array(F.xxhash64(text))))  # none is shared
    words = [f"w{i * 7919 % 100003}" for i in range(3000)]
    rows = [(i, " ".join(words) + f" end{i}") for i in range(5)] + [(9, " ".join(reversed(words)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, words=5, least=0.8).collect()) == [0, 9]
    # within 3 bits, but not alike enough
    assert sorted(r.doc_id for r in simhash.keep_one(df, words=5, least=0.9999).collect()) == [0, 1, 2, 3, 4, 9]

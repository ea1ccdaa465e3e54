import re
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tilewright.llm import simhash

LONG = "word " * 30_000


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    ones = Counter(b for s in shingles for h in [xxhash.xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(prints):
    """{index: component} over all pairs."""
    root = list(range(len(prints)))
    p = np.array(prints, dtype=np.uint64)
    for i in range(len(p)):
        for j in np.flatnonzero(np.bitwise_count(p ^ p[i]) <= 3):
            a, b = root[i], root[j]
            if a != b:
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_query_is_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    prints = [brute_print(r.text) for r in docs]
    parts = brute_components(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash(spark, sf).collect()}
    assert got == {r.doc_id: (f"{p:016x}", docs[c].doc_id) for r, p, c in zip(docs, prints, parts)}


def test_links_over_large_cells(spark, monkeypatch):
    """Chains within a cell of many members, cut into further cells, keep every component."""
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 1 << 63, 5)]
    prints = set()
    for b in base:
        for _ in range(300):
            x = b
            for bit in rng.integers(0, 64, int(rng.integers(0, 7))):
                x ^= 1 << int(bit)
            prints.add(x)
    prints = sorted(prints)
    monkeypatch.setattr(simhash, "CELL", 16)
    df = spark.createDataFrame([(simhash.as_signed(x),) for x in prints], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [roots.get(simhash.as_signed(x), simhash.as_signed(x)) for x in prints]
    want = brute_components(prints)
    pairs = set(zip(got, want))
    assert len(pairs) == len({g for g, _ in pairs}) == len({w for _, w in pairs})


def test_edge_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n", None), (4, "one two", "x"), (4, "one two", "x"), (5, "ONE two", "x"), (None, "one  two", "x"), (None, "quite other words here", "y"), (6, LONG, "y"), (7, LONG + "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.component_id, []).append(r.doc_id)
    assert {k: sorted(v, key=str) for k, v in by.items()} == {1: [1, 2, 3], 4: [4, 4, 5, None], None: [None], 6: [6, 7]}
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, 6, None]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
    assert simhash.keep_one(df).count() == 0


def test_pivots_discard_only_what_is_apart(spark):
    """The largest coordinate difference never exceeds the distance, and pivots lie apart."""
    rng = np.random.default_rng(2)
    prints = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 300)]
    pivots = simhash.choose_pivots(spark.createDataFrame([(x,) for x in prints], "fp long"))
    assert len(set(pivots)) == simhash.PIVOTS and set(map(simhash.as_signed, pivots)) <= set(prints)
    fp = np.array(prints, np.int64).view(np.uint64)
    own = np.bitwise_count(fp[:, None] ^ np.array(pivots, np.uint64)[None]).astype(int)
    df = spark.createDataFrame([(x,) for x in prints], "fp long").select("fp", simhash.pivot_table(F.col("fp"), pivots).alias("piv"))
    got = {r.fp: np.array(r.piv, np.int64).view(np.uint8).tolist() for r in df.collect()}
    assert all(got[p] == own[i].tolist() for i, p in enumerate(prints))
    for i in range(0, 300, 7):
        assert (np.abs(own - own[i]).max(axis=1) <= np.bitwise_count(fp ^ fp[i])).all()
    assert simhash.choose_pivots(spark.createDataFrame([], "fp long")) == simhash.splitmix(simhash.PIVOTS)


def test_a_long_chain_is_one_component(spark):
    """As many rounds as it takes: no bound on the length of a chain."""
    edges = spark.createDataFrame([(i + 1, i) for i in range(3000)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_a_hot_fingerprint_joins_by_broadcast(spark):
    rows = [(i, "the same text of many rows") for i in range(400)] + [(1000 + i, f"text {i * 7919} of its {i * 104729} own words {i * 1299709}") for i in range(200)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 600 and {r.component_id for r in got if r.doc_id < 400} == {0}


def test_a_large_cell_is_cut_not_paired(spark, monkeypatch):
    """Twenty thousand fingerprints that agree on two blocks: planted links are found, and no cell of more than CELL is compared."""
    rng = np.random.default_rng(5)
    free = [b for x in simhash.cut(list(range(64)))[2:] for b in x]
    own = rng.integers(0, 1 << len(free), 20_000)
    prints = [sum(1 << b for i, b in enumerate(free) if int(x) >> i & 1) for x in own]
    near = [p ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False)) for p in prints[:200]]
    seen = []
    work = simhash.cell_links
    monkeypatch.setattr(simhash, "cell_links", lambda batches: work(batches))
    stage = simhash.stage
    monkeypatch.setattr(simhash, "stage", lambda df, name, **k: seen.append((name, out := stage(df, name, **k))) or out)
    df = spark.createDataFrame([(simhash.as_signed(x),) for x in {*prints, *near}], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    root = lambda x: roots.get(simhash.as_signed(x), simhash.as_signed(x))
    assert all(root(a) == root(b) for a, b in zip(prints, near))
    large = [d for n, d in seen if n == "simhash-large-cells"]
    assert len(large) == 1 and large[0].count() >= 20_000  # cut once, each member ten times
    assert seen[-1][1].agg(F.max("n")).first()[0] <= simhash.CELL

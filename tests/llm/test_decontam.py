import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tilewright.llm import decontam

GAP = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(decontam.ascii_lower.__globals__["UPPER"], decontam.ascii_lower.__globals__["UPPER"].lower())


def words(text):
    return GAP.findall((text or "").translate(LOW))


def brute(text, items):
    """(n_words, n_hit, items)"""
    w, hit, found = words(text), set(), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            for p in range(len(w) - len(win) + 1):
                if w[p : p + len(win)] == win:
                    hit |= set(range(p, p + len(win)))
                    found.add("" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def expected(text, items, counts):
    n, hit, found = brute(text, items)
    return n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0, len(near(text, items, counts))


def near(text, items, counts, slack=decontam.SLACK):
    """Items with a window all of whose words lie around an occurrence of its rarest one."""
    w, found = words(text), set()
    for item, t in items:
        v = words(t)
        for i in range(max(1, len(v) - 9) if v else 0):
            win = v[i : i + 10]
            if all(x in counts for x in win):
                rarest = min(win, key=lambda x: counts[x])  # the first of the rarest
                reach = len(win) + slack
                if any(x == rarest and set(win) <= set(w[max(0, p - reach + 1) : p + reach]) for p, x in enumerate(w)):
                    found.add("" if item is None else str(item))
    return found


def counted(texts):
    return Counter(x for t in texts for x in words(t))


def run(spark, path, docs, items, extra=""):
    spark.createDataFrame(docs, "doc_id long, text string, k1 string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return [(r.doc_id, tuple(r)[1:]) for r in decontam.op7_decontamination(spark, str(path)).collect()]


def test_query_is_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in decontam.op7_decontamination(spark, sf).collect()}
    counts = counted(docs.values())
    assert got == {d: expected(t, items, counts) for d, t in docs.items()}
    assert any(v[4] for v in got.values())


@pytest.mark.parametrize("broadcast", [True, False])
def test_edge_rows(spark, tmp_path, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontam, "BROADCAST", -1)
        monkeypatch.setattr(decontam, "TERMS", -1)
    long = "one two three four five six seven eight nine ten eleven twelve"
    items = [(1, long), (2, "Été à Paris"), (3, None), (4, " -- "), (5, "solo"), (6, long), (7, "a b a b a b a b a b a b"), (None, "nobody here")]
    filler = " ".join(f"x{i}" for i in range(50_000))
    docs = [
        (1, long.upper() + "!", "o"), (2, "zero one-two,three four five six seven eight nine ten", "o"), (3, "one two three four five six seven eight nine", "o"), (4, None, None), (5, "", "o"),
        (6, "Été à Paris, été à Paris", "o"), (7, "ÉTÉ à paris", "o"), (8, "solo solo x solo", "o"), (9, filler + " " + long + " " + filler, "o"), (10, "a b " * 12, "o"), (None, "nobody here solo", "o"),
        (11, long, "o"), (11, long, "o"), (11, "another text", "o"), (12, "... \x00 !", "o"),
    ]
    got = run(spark, tmp_path, docs, items)
    counts = counted(t for _, t, _ in docs)
    assert sorted(got, key=str) == sorted(((d, expected(t, items, counts)) for d, t, _ in docs), key=str)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = decontam.keep_clean(df, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert clean.columns == df.columns
    clash = df.withColumn("found", F.lit("f")).withColumn("items", F.lit("i")).withColumn("words", F.lit("w"))
    whole = decontam.contaminated(clash, spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert whole.columns == ["doc_id", "text", "k1", "found", "words", "n_words", "n_hit", "items", "n_near"]
    assert {(r.k1, r.found, r.words) for r in whole.collect()} == {("o", "f", "w"), (None, "f", "w")}
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, t, _ in docs if not brute(t, items)[1])


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path / "a", [], [(1, "some words")]) == []
    assert run(spark, tmp_path / "b", [(1, "some words", "x")], []) == [(1, expected("some words", [], {}))]
    assert run(spark, tmp_path / "c", [(1, "some words", "x")], [(1, "absent words entirely")]) == [(1, expected("some words", [], {}))]


def test_proximity(spark, tmp_path):
    """Words in another order and with others between them, up to the distance; copies and repeats alike."""
    item = "common rare term"
    docs = [(1, "rare x common y z term"), (2, "rare a b c d e f g common term"), (3, "common term"), (4, "term a b c d rare e f g h common"), (5, "rare " * 30 + "common " * 9 + "term"), (6, "common " * 5 + "a b c d e f term rare"), (7, "rare x common y z term")]
    counts = counted(t for _, t in docs)
    got = run(spark, tmp_path, [(d, t, "x") for d, t in docs], [(1, item), (2, "rare"), (3, "x rare x")])
    assert got and sorted(got) == [(d, expected(t, [(1, item), (2, "rare"), (3, "x rare x")], counts)) for d, t in docs]
    assert {d: v[5] for d, v in got}[2] == 1 and {d: v[5] for d, v in got}[1] == 3

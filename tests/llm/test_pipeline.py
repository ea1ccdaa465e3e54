import importlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from test_decontam import brute as benchmark_hits
from test_near_copies import smallest
from test_packing import check_pieces

import corpus_pipeline
from tilewright.llm import lang_id, packing, quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before and after every stage."""
    from tilewright.llm.common import stage

    rows = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, f in corpus_pipeline.STAGES:
        rows.append(stage(f(spark, rows[-1], SF), "test-" + name.replace(" ", "-")))
    return rows


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_stages_are_in_order_and_keep_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near duplicates", "benchmark", "packing"]
    assert all(r.columns == stages[0].columns for r in stages[1:5])


def test_language_drops_what_has_none(spark, stages):
    model = lang_id.contract_model(stages[0])
    p = stages[0].select("doc_id", lang_id.predict(model, F.col("text"), spark).alias("p"))
    assert ids(stages[1]) == sorted(r.doc_id for r in p.collect() if r.p.lang_pred != "und" and r.p.score >= corpus_pipeline.LEAST_LANGUAGE)


def test_quality_keeps_good_ones(spark, stages):
    kept = set(ids(stages[2]))
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in set(ids(stages[1]))}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept for d in good) / len(good) > 0.97


def test_one_of_each_group_stays(stages):
    """Groups by the exact Jaccard similarity of five-word shingles, over all pairs."""
    rows = sorted((r.doc_id, r.text) for r in stages[2].select("doc_id", "text").collect())
    assert ids(stages[3]) == sorted(set(smallest(rows).values()))


def test_benchmark_text_is_gone(spark, stages):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert ids(stages[4]) == sorted(r.doc_id for r in stages[3].collect() if not benchmark_hits(r.text, items)[1])


def test_all_that_is_left_is_packed(spark, stages):
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids + [0] for r in stages[4].collect()}
    check_pieces([r.asDict() | {"key": r.doc_id} for r in stages[5].collect()], want)


def test_run_and_registration(spark, stages):
    entry = importlib.import_module("__spark_entry__")
    got = entry.queries()["pipeline"](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, stages[5].collect()))
    assert {f"op{i}" for i in range(1, 11)} == {n.split("_")[0] for n in entry.queries() if n.startswith("op")}


def test_odd_rows_go_through(spark):
    """What each stage keeps of nulls, empty texts, repeats and an empty table; other columns come through."""
    same = "the words of a text " * 9
    rows = [(1, None, "en", "a", 0, 9), (2, "", None, None, 0, 9), (2, "", None, None, 0, 9), (None, same, "en", "b", None, 9), (3, same, "en", "b", 1, 9), (4, "x" * 100_000, None, "c", 1, 9), (5, "12 34", "fr", "c", 1, 9)]
    clash = "component long, k1 string, p string, row string"
    df = spark.createDataFrame([(*r, "k", "p", "r") for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {clash}")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert labels  # the quality stage learns from documents with these ids
    got = {}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, df, SF)
        got[name] = out.collect()
        assert f(spark, df.limit(0), SF).collect() == []
        if name != "packing":
            assert out.columns == df.columns
            assert all((r.component, r.k1, r.p, r.row) == (9, "k", "p", "r") for r in got[name])
    kept = lambda name: sorted((r.doc_id for r in got[name]), key=str)
    assert set(kept("language")) == {3, None}  # no language: null, empty, digits; too long a code: one letter over and over
    assert kept("near duplicates") == [1, 3, 4, 5]
    assert kept("benchmark") == sorted((r[0] for r in rows), key=str)
    pieces = got["packing"]
    assert sorted({(r.doc_id, r.doc_tokens) for r in pieces if r.doc_id in (1, 2)}) == [(1, 1), (2, 1)] and sum(r.doc_id == 2 for r in pieces) == 2
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4, 5, None}

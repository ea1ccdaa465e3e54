import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tilewright.llm import packing


def check_pieces(pieces, ids_of, window=1024):
    """Every id in exactly one piece, sequences gapless and full but for the last."""
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p["key"], []).append(p)
        sequences.setdefault(p["sequence_id"], []).append(p)
    assert set(docs) == set(ids_of)
    for key, parts in docs.items():
        ids, at = ids_of[key], 0
        for p in sorted(parts, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    lengths = {}
    for s, parts in sequences.items():
        at = 0
        for p in sorted(parts, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        lengths[s] = at
    assert sorted(lengths) == list(range(len(lengths)))
    assert all(n == window for s, n in lengths.items() if s != max(lengths)) and all(n <= window for n in lengths.values())


def test_query_round_trip(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    t = Tokenizer.from_file(packing.default_vocabulary())
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in docs}
    got = [r.asDict() | {"key": r.doc_id} for r in packing.op4_packing(spark, sf).collect()]
    check_pieces(got, ids)


def by_hand(lengths, weights, window, quantum):
    """[(queue, slot)] in order: deficits carried slot by slot, a window's slots grouped by queue, and what is left of each queue."""
    each, left, open_, out = window // quantum, [n // quantum for n in lengths], {q for q, n in enumerate(lengths) if n >= quantum}, []
    given = [0] * len(lengths)
    while open_:
        who = sorted(open_)
        share = np.maximum(np.array([(left if weights is None else weights)[q] for q in who], float), 1e-12)
        m = packing.rounded_shares(share, max(packing.CYCLE, -(-8 * len(lengths) // each)) * each)
        total, deficit, s = int(m.sum()), dict.fromkeys(who, 0), len(who)
        while True:
            now = []
            for _ in range(each):
                for q, x in zip(who, m):
                    deficit[q] += int(x)
                due = [(((2 * s - 3) * total - deficit[q] * (2 * s - 2)) / int(x), q) for q, x in zip(who, m) if s == 1 or deficit[q] * (2 * s - 2) >= total]
                q = min(due)[1]
                deficit[q] -= total
                assert all(abs(d) < total for d in deficit.values())
                now.append(q)
            short = {q for q in who if now.count(q) > left[q]}
            if short:
                open_ -= short
                break
            for q in sorted(now):
                out.append((q, given[q]))
                given[q] += 1
                left[q] -= 1
    return out, given


@pytest.mark.parametrize("weights", [None, [1, 1, 1, 1, 1], [5, 1, 0.3, 2, 1e-9]])
def test_round_robin_against_one_slot_at_a_time(weights):
    """The places are those of the round-robin that hands out one slot after another, over several phases."""
    lengths = np.array([10_000, 370, 0, 48_010, 5])
    w = None if weights is None else np.array(weights, float)
    plan = packing.Plan(lengths, w, window=64, quantum=8)
    served, given = by_hand(lengths.tolist(), weights, 64, 8)
    for q in range(5):
        want = [i for i, (o, _) in enumerate(served) if o == q]
        assert plan.edge[q] == 8 * given[q] and plan.places(q, np.arange(given[q])).tolist() == want
        assert lengths[q] - plan.edge[q] < 64 + 8
    seen = np.zeros(int(lengths.sum()), int)
    for q in range(5):
        begin = np.arange(0, lengths[q], 13)
        _, _, length, place = plan.pieces(q, begin, np.minimum(13, lengths[q] - begin))
        for n, p in zip(length, place):
            seen[p : p + n] += 1
            assert p // 64 == (p + n - 1) // 64
    assert (seen == 1).all()


@pytest.mark.parametrize("weights", [[0.5, 0.3, 0.2], [0.9] + [0.02] * 5, [0.7] + [0.3 / 99] * 99, [1.0], np.random.default_rng(0).random(40) ** 6 + 1e-4])
def test_windows_hold_the_mixture(weights):
    """While no queue is dry, each is less than a slot from its share after every window, and has one run in it."""
    w = np.array(weights) / np.sum(weights)
    m = packing.rounded_shares(w, packing.CYCLE * 16) / (packing.CYCLE * 16)
    assert (abs(m - w) < 1.1 / (packing.CYCLE * 16) * max(1, len(w) / 8)).all()
    lengths = np.ceil(m * 700 * 1024).astype(np.int64) + 2048
    plan = packing.Plan(lengths, w)
    owner = np.full(700 * 16, -1)
    for q in range(len(w)):
        at = plan.places(q, np.arange(plan.edge[q] // 64))
        owner[at[at < len(owner)]] = q
    for windows in range(1, 700):
        got = np.bincount(owner[: windows * 16], minlength=len(w))
        assert (abs(got - m * windows * 16) < 1).all()
        last = owner[(windows - 1) * 16 : windows * 16]
        assert (np.diff(last) != 0).sum() + 1 == len(set(last.tolist()))


def test_ids_of_both_tokenizers_are_alike():
    """Over every code point in several contexts, and random words, tiktoken gives the ids of the tokenizer file."""
    path = packing.default_vocabulary()
    exact, fast = Tokenizer.from_file(path), packing.byte_level(path)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"{c}a {c}1 {c}" for c in points[at : at + 997]) for at in range(0, len(points), 997)]
    rng = np.random.default_rng(0)
    texts += [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzABCDÉß019'.,-\n\t "), 7)) for _ in range(500)) for _ in range(20)]
    for t in texts:
        assert fast.encode_ordinary(t) == exact.encode(t, add_special_tokens=False).ids


def test_edge_rows(spark):
    long = "Zebra crossing, " * 60_000
    rows = [(1, None, "a", 1), (2, "", "a", 2), (3, "x <|endoftext|> y", None, 3), (3, "x <|endoftext|> y", None, 3), (None, "no id", "b", 4), (5, long, "b", 5), (6, "a b  c\n\n\td é東🙂", "c", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, length long")
    t = Tokenizer.from_file(packing.default_vocabulary())
    want = sorted((r[0] or -1, len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1) for r in rows)
    got = packing.contract_pieces(df).collect()
    total = {}
    for r in got:
        total.setdefault((r.doc_id or -1, r.doc_tokens), 0)
        total[(r.doc_id or -1, r.doc_tokens)] += r.length
    assert sorted(total) == sorted(set(want))
    n = len(t.encode("x <|endoftext|> y", add_special_tokens=False).ids) + 1
    assert total[(3, n)] == 2 * n
    ids = {5: t.encode(long, add_special_tokens=False).ids + [0]}
    for r in got:
        if r.doc_id == 5:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[5][r.start : r.start + r.length], "<u4").tobytes())


def test_many_sources_are_hashed(spark):
    df = spark.createDataFrame([(i, f"text number {i}", f"s{i % 37}") for i in range(200)], "doc_id long, text string, source string")
    got = packing.pack(df, queues=5, window=64, quantum=8).collect()
    assert {r.queue for r in got} <= set(range(5))
    assert sum(r.length for r in got) == sum({r.doc_id: r.doc_tokens for r in got}.values())


def test_empty(spark):
    assert packing.contract_pieces(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0

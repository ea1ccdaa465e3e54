"""Quality classification by a factorisation machine.

A text's features are its hashed words (weights proportional to the root of their
counts, of unit length together), structure statistics of the whole text, each cut
into bins, and as metadata its length. The machine scores

    sigmoid(b + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2])

so the interactions of all pairs of features cost time linear in their number. Weights
are fitted on the driver by AdaGrad on a bounded sample of labels (`sample`, all if
there are fewer), whose texts' features, not texts, are gathered (`most` at most). Scoring
reads every whole text, very long ones in one go.

Defined results: a null text counts as empty; an empty text has its structure bins and
a score like any other. Without any labelled row every score is 0.5. Different labels
of one document each count as an example, equal ones once; of several texts with the id of
a label, the one that sorts first is learned from. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_remainder, in_small_batches, row_share, stage, table, tidy

WORD_BITS = 15
WORDS = 1 << WORD_BITS
BINS = 16
FACTORS = 8
#: Labelled rows to fit on at most, and features of theirs: beyond these, the rows with the most features are left out.
SAMPLE, MOST = 6000, 20_000_000
ACCEPT = 0.3
BLOCK = 1 << 20
STATS = ("upper", "digit", "punctuation", "symbol", "high", "space", "word_length", "longest_word", "line_length", "lines", "variety", "repeats", "length")
N = WORDS + len(STATS) * BINS

#: Kinds of bytes: 1 lower, 2 upper, 3 digit, 4 usual punctuation, 5 other symbols, 6 white space, 7 over 127, 0 the rest.
KIND = np.zeros(256, np.uint8)
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 7
KIND[[*b".,;:'\"()-?!"]] = 4
KIND[[*b"#$%&*+/<=>@[\\]^_`{|}~"]] = 5
KIND[[*b" \t\n\r\x0b\x0c"]] = 6
#: Most bytes of a word that make one feature.
PIECE = 64
RADIX = 0x100000001B3


def bins(values: np.ndarray) -> np.ndarray:
    return np.clip(values, 0, BINS - 1).astype(np.int64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: start of each text's features, feature numbers, weights."""
    sizes, idx, val = [], [], []
    group: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        group.append(t)
        size += len(t)
        if size >= BLOCK or i == len(texts) - 1:
            s, f, v = _features(group)
            sizes.append(s)
            idx.append(f)
            val.append(v)
            group, size = [], 0
    if not sizes:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(([0], np.cumsum(np.concatenate(sizes)))), np.concatenate(idx), np.concatenate(val)


def _features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(texts)
    data = np.frombuffer(b"".join(t + b" " for t in texts), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    starts = np.concatenate(([0], ends[:-1]))
    kind = KIND[data]
    length = np.maximum(ends - starts - 1, 1).astype(np.float64)

    # words: maximal runs without white space, hashed by a polynomial over their bytes
    solid = kind != 6
    edge = np.diff(np.concatenate(([0], solid.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(ends, begin, side="right")
    hashes = np.zeros(len(begin), np.uint64)
    wide = end - begin
    whole, whole_doc = wide, doc
    if len(begin) and wide.max() > PIECE:  # longer words are cut into pieces, each a feature like a word
        pieces = -(-wide // PIECE)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin, end, doc = np.repeat(begin, pieces) + PIECE * nth, np.repeat(end, pieces), np.repeat(doc, pieces)
        wide = np.minimum(end - begin, PIECE)
        hashes = np.zeros(len(begin), np.uint64)
    if len(begin):
        low = data | np.where(kind == 2, np.uint8(32), np.uint8(0))
        with np.errstate(over="ignore"):
            order = np.argsort(-wide, kind="stable")  # the words that still have a byte k come first
            left = np.cumsum(np.bincount(wide)[::-1])[::-1]
            for k in range(int(wide.max())):
                live = order[: left[k + 1]]
                hashes[live] = (hashes[live] ^ low[begin[live] + k]) * np.uint64(RADIX)
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= wide.astype(np.uint64)
    word = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pair, count = np.unique(doc.astype(np.int64) * WORDS + word, return_counts=True)
    row, col = pair // WORDS, pair % WORDS
    words = np.bincount(doc, minlength=n).astype(np.float64)
    x = np.sqrt(count / np.maximum(words[row], 1))

    share = {k: np.add.reduceat((kind == k).astype(np.int32), starts) / length for k in (2, 3, 4, 5, 7)}
    space = (np.add.reduceat((kind == 6).astype(np.int32), starts) - 1) / length
    lines = np.add.reduceat((data == 10).astype(np.int32), starts) + 1.0
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, whole_doc, whole)
    mean = np.bincount(whole_doc, weights=whole, minlength=n) / np.maximum(np.bincount(whole_doc, minlength=n), 1)
    again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])) + 1
    repeats = np.bincount(doc[again], minlength=n) / np.maximum(words, 1)
    variety = np.bincount(row, minlength=n) / np.maximum(words, 1)
    stats = [
        bins(np.sqrt(share[2]) * 16), bins(np.sqrt(share[3]) * 16), bins(np.sqrt(share[4]) * 24), bins(np.sqrt(share[5]) * 24), bins(np.sqrt(share[7]) * 16), bins(space * 40),
        bins(mean), bins(np.log2(longest + 1.0) * 2), bins(np.log2(length / lines)), bins(np.log2(lines)), bins(variety * 15.99), bins(np.sqrt(repeats) * 16), bins(np.log2(length)),
    ]
    extra = np.stack([WORDS + i * BINS + s for i, s in enumerate(stats)], axis=1).ravel()
    rows = np.concatenate((row, np.repeat(np.arange(n), len(STATS))))
    idx = np.concatenate((col, extra))
    val = np.concatenate((x, np.full(len(extra), 1 / np.sqrt(len(STATS))))).astype(np.float32)
    by = np.argsort(rows, kind="stable")
    return np.bincount(rows, minlength=n), idx[by], val[by]


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, start: np.ndarray, idx: np.ndarray, val: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and sum_i v_if x_i; every row has features."""
        vx = self.v[idx] * val[:, None]
        sums = np.add.reduceat(vx, start[:-1], axis=0)
        squares = np.add.reduceat(vx * vx, start[:-1], axis=0)
        linear = np.add.reduceat(self.w[idx] * val, start[:-1])
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = []
        group: list[bytes] = []
        size = 0
        for i, t in enumerate(texts):
            group.append(t)
            size += len(t)
            if size >= BLOCK or i == len(texts) - 1:
                raw, _ = self.raw(*features(group))
                out.append(1 / (1 + np.exp(-np.clip(raw.astype(np.float64), -30, 30))))
                group, size = [], 0
        return np.concatenate(out) if out else np.zeros(0)


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.15, decay: float = 1e-5, batch: int = 64, seed: int = 0) -> Machine:
    """AdaGrad on the logistic loss."""
    rng = np.random.default_rng(seed)
    p = np.clip(labels.mean(), 0.01, 0.99)
    m = Machine(float(np.log(p / (1 - p))), np.zeros(N, np.float32), rng.normal(0, 0.05, (N, FACTORS)).astype(np.float32))
    gw, gv = np.full(N, 1e-6, np.float32), np.full((N, FACTORS), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            size = np.array([len(rows[i][0]) for i in pick])
            raw, sums = m.raw(np.concatenate(([0], np.cumsum(size))), idx, val)
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]).astype(np.float32)
            m.bias -= rate * 0.05 * float(error.mean())
            each = np.repeat(error, size)
            dw = each * val
            dv = (each * val)[:, None] * (np.repeat(sums, size, axis=0) - m.v[idx] * val[:, None])
            used, where = np.unique(idx, return_inverse=True)
            sw = np.bincount(where, weights=dw, minlength=len(used)).astype(np.float32) / len(pick) + decay * m.w[used]
            sv = np.stack([np.bincount(where, weights=dv[:, f], minlength=len(used)) for f in range(FACTORS)], axis=1).astype(np.float32) / len(pick) + decay * m.v[used]
            gw[used] += sw * sw
            gv[used] += sv * sv
            m.w[used] -= rate * sw / np.sqrt(gw[used])
            m.v[used] -= rate * 0.3 * sv / np.sqrt(gv[used])
    return m


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = MOST) -> Machine | None:
    """A machine fitted on `sample` of the labels, those of the lowest hash. docs: doc_id, text; labels: doc_id, quality.

    Equal labels count once, and a label goes with one text (of several rows with its id, the one
    that sorts first), so `sample` labels are broadcast and no more rows gathered, whatever repeats.
    """
    in_small_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null").distinct()
    known = known.withColumn("h", row_share(F.col("doc_id"), F.col("quality"), F.lit("fm")))
    enough = (1.2 * sample + 100) / max(known.count(), 1)  # those that can be among the lowest
    few = stage(known.where(F.col("h") < enough).orderBy("h", "doc_id", "quality").limit(sample).drop("h"), "quality-labels")
    wanted = F.broadcast(few.select("doc_id").distinct())  # `sample` rows at most
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(wanted, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            start, idx, val = features([t.encode() for t in b["text"]])
            cut = start[1:-1]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": np.diff(start), "idx": [x.astype(np.int32).tobytes() for x in np.split(idx, cut)], "val": [x.tobytes() for x in np.split(val, cut)]})

    rows = stage(texts.mapInPandas(extract, f"doc_id {kind}, n long, idx binary, val binary").join(F.broadcast(few), "doc_id"), "quality-features")
    total = 0
    for least in sorted((r.n for r in rows.select("n").collect()), reverse=False):  # `sample` numbers
        total += least
        if total > most:
            rows = rows.where(F.col("n") < least)
            break
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.quality))  # `sample` rows and `most` features at most
    if not got:
        return None
    return fit([(np.frombuffer(r.idx, np.int32), np.frombuffer(r.val, np.float32)) for r in got], np.array([r.quality for r in got]))


def predict(machine: Machine | None, text: Column, spark: SparkSession) -> Column:
    """double: how likely label 1 is."""
    in_small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        for texts in batches:
            yield pd.Series(m.score([t.encode() if isinstance(t, str) else b"" for t in texts]) if m is not None else np.full(len(texts), 0.5))
        tidy()

    return of(text)


def contract_machine(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """Fitted on labels of rows whose crc32 of doc_id leaves no 0 on division by 5."""
    return train(docs, labels.where(crc_remainder(F.col("doc_id"), 5) != 0))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    machine = contract_machine(docs, table(spark, sf_dir, "labels"))
    out = docs.select("doc_id", (crc_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), predict(machine, F.col("text"), spark).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))

"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over bytes: for every context of up to max_order
bytes seen in its training texts, how often each byte followed. The probability of a
byte comes from the longest known context; a byte that never followed it costs an
escape (method C: distinct followers over occurrences plus distinct followers) and
is looked up in the next shorter context, at last uniformly over 256 bytes. The
statistics are frozen after training, so a text's code length is a sum over its
bytes, and the language of the shortest code is predicted. Costs are held in units of
2^-16 bit as whole numbers: sums are exact and the same in any order.

Training counts are gathered by partition and summed; only the summed table reaches
the driver, which is bounded by the training sample: of the `langs` languages with the most
texts at most `sample` texts each (all if it has fewer), those of the lowest hash of the row,
and no more than `most` bytes together, in equal parts. Equal rows count towards these
bounds like others. Scoring reads the whole of every text in blocks of BLOCK bytes.

Defined results: a null text, or one without any letter, is `und` with score 0, as is
every text if nothing was learned. Ties go to the language that sorts first. A text's
history before its first byte is max_order newlines. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_remainder, in_small_batches, row_share, stage, table, tidy

MAX_ORDER = 3
#: Training texts of each language, bytes of all, and languages, at most.
SAMPLE, MOST, LANGS = 1500, 20_000_000, 32
#: Bytes scored at once.
BLOCK = 1 << 19
UNIT = 65536.0
#: most_bits() over the training texts' 99.9th percentile, and bits allowed besides, for short texts.
MARGIN, SHORT = 2.0, 64.0
MIX = np.uint64(0x9E3779B97F4A7C15)


def grams(data: np.ndarray, order: int, pad: int) -> np.ndarray:
    """The byte at each place behind the padding with the `order` bytes before it, as one number."""
    n = len(data) - pad
    key = np.zeros(n, np.uint64)
    for back in range(order, -1, -1):
        key = (key << np.uint64(8)) | data[pad - back : pad - back + n].astype(np.uint64)
    return key


@dataclass
class Lookup:
    """An open-addressing table from keys to row numbers."""

    slots: np.ndarray
    rows: np.ndarray
    bits: int

    @classmethod
    def of(cls, keys: np.ndarray) -> Lookup:
        bits = max(4, int(len(keys) * 4).bit_length())
        mask = np.uint64((1 << bits) - 1)
        slots = np.full(1 << bits, np.uint64(2**64 - 1))
        rows = np.zeros(1 << bits, np.int32)
        left = np.arange(len(keys))
        at = (keys * MIX) >> np.uint64(64 - bits)
        while len(left):
            place = at[left]
            free = slots[place] == np.uint64(2**64 - 1)
            won = np.zeros(len(left), bool)
            first = np.unique(place[free], return_index=True)[1]
            won[np.flatnonzero(free)[first]] = True
            slots[place[won]] = keys[left[won]]
            rows[place[won]] = left[won]
            left = left[~won]
            at[left] = (at[left] + np.uint64(1)) & mask
        return cls(slots, rows, bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that are not there."""
        mask = np.uint64((1 << self.bits) - 1)
        at = (keys * MIX) >> np.uint64(64 - self.bits)
        seen = self.slots[at]
        out = np.where(seen == keys, self.rows[at], np.int32(-1))
        open_ = np.flatnonzero((seen != keys) & (seen != np.uint64(2**64 - 1)))
        while len(open_):
            at_open = (at[open_] + np.uint64(1)) & mask
            at[open_] = at_open
            seen = self.slots[at_open]
            hit = seen == keys[open_]
            out[open_[hit]] = self.rows[at_open[hit]]
            open_ = open_[~hit & (seen != np.uint64(2**64 - 1))]
        return out


@dataclass
class Model:
    """Frozen statistics: by order, the cost of each known (context, byte) and the escape cost of each known context."""

    langs: list[str]
    max_order: int
    symbols: list[tuple[Lookup, np.ndarray]]
    escapes: list[tuple[Lookup, np.ndarray]]
    #: 99.9th percentile of the training texts' bits a byte
    usual: float = 0.0

    def costs(self, data: np.ndarray) -> np.ndarray:
        """(bytes, langs) costs of the bytes behind the first max_order ones."""
        n, pad = len(data) - self.max_order, self.max_order
        out = np.zeros((n, len(self.langs)), np.int32)
        todo = np.arange(n)
        whole = grams(data, pad, pad)
        for order in range(pad, -1, -1):
            key = whole[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
            lookup, cost = self.symbols[order]
            row = lookup.find(key)
            hit = row >= 0
            if hit.all():
                if order == pad:
                    return cost[row]
                out[todo] += cost[row]
                return out
            out[todo[hit]] += cost[row[hit]]
            todo, key = todo[~hit], key[~hit]
            lookup, cost = self.escapes[order]
            row = lookup.find(key >> np.uint64(8))
            known = row >= 0
            out[todo[known]] += cost[row[known]]
        out[todo] += np.int32(8 * UNIT)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, langs) exact code lengths in units of 2^-16 bit."""
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        pad = b"\n" * self.max_order
        held: list[tuple[int, bytes]] = []
        size = 0

        def flush():
            nonlocal held, size
            if not held:
                return
            data = np.frombuffer(b"".join(pad + t if i >= 0 else t for i, t in held), np.uint8)
            cost = self.costs(data)
            at = 0
            for i, t in held:
                out[abs(i) - 1 if i < 0 else i] += cost[at : at + len(t)].sum(axis=0, dtype=np.int64)
                at += len(t) + len(pad)
            held, size = [], 0

        for i, t in enumerate(texts):
            if len(t) <= BLOCK:
                if t:
                    held.append((i, t))
                    size += len(t)
                    if size >= BLOCK:
                        flush()
                continue
            flush()
            long = pad + t
            for at in range(0, len(t), BLOCK):
                piece = np.frombuffer(long[at : at + BLOCK + len(pad)], np.uint8)
                out[i] += self.costs(piece).sum(axis=0, dtype=np.int64)
        flush()
        return out


def count_grams(docs: DataFrame, max_order: int) -> DataFrame:
    """(lang, ord, gram, n): how often each byte followed each context in the texts of each language."""
    in_small_batches(docs.sparkSession)
    pad = b"\n" * max_order

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                size, group = 0, []
                for last, text in [*((False, t.encode()) for t in texts), (True, b"")]:
                    group.append(text)
                    size += len(text)
                    if size and (last or size >= BLOCK):
                        for order in range(max_order + 1):
                            keys = np.concatenate([grams(np.frombuffer(pad + t, np.uint8), order, max_order) for t in group if t])
                            gram, n = np.unique(keys, return_counts=True)
                            yield pd.DataFrame({"lang": lang, "ord": order, "gram": gram.view(np.int64), "n": n})
                        size, group = 0, []

    return docs.select("lang", "text").mapInPandas(count, "lang string, ord int, gram long, n long").groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))


def build(langs: list[str], counts: pd.DataFrame, max_order: int) -> Model:
    """The frozen statistics from (lang, ord, gram, n)."""
    symbols, escapes = [], []
    lower = np.full((0, len(langs)), 0, np.int32)
    for order in range(max_order + 1):
        part = counts[counts["ord"] == order]
        keys = np.unique(part["gram"].to_numpy().astype(np.uint64))
        table_ = np.zeros((len(keys), len(langs)), np.int64)
        table_[np.searchsorted(keys, part["gram"].to_numpy().astype(np.uint64)), part["lang"].map(langs.index).to_numpy(int)] = part["n"].to_numpy()
        contexts, which = np.unique(keys >> np.uint64(8), return_inverse=True)
        total = np.zeros((len(contexts), len(langs)), np.int64)
        kinds = total.copy()
        np.add.at(total, which, table_)
        np.add.at(kinds, which, table_ > 0)
        whole = np.maximum(total + kinds, 1)
        escape = np.where(total > 0, np.rint(-np.log2(np.maximum(kinds, 1) / whole) * UNIT), 0).astype(np.int32)
        if order:
            shorter = symbols[-1][0].find(keys & np.uint64((1 << 8 * order) - 1))
            base = lower[shorter]
        else:
            base = np.full((len(keys), len(langs)), int(8 * UNIT), np.int32)
        seen = np.rint(-np.log2(np.maximum(table_, 1) / whole[which]) * UNIT).astype(np.int32)
        lower = np.where(table_ > 0, seen, escape[which] + base)
        symbols.append((Lookup.of(keys), lower))
        escapes.append((Lookup.of(contexts), escape))
    return Model(langs, max_order, symbols, escapes)


def sampled(docs: DataFrame, sample: int, most: int = MOST, langs: int = LANGS) -> DataFrame | None:
    """A written table of training texts (lang, text) within the bounds, or None if there are no languages."""
    known = docs.where("lang is not null and text is not null and text != ''")
    rows = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()}
    if not rows:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in rows.items() for x in (lang, min(1.0, 1.2 * sample / n + 20 / n))]), F.col("lang"))
    few = known.select("lang", "text", row_share(*[F.col(c) for c in docs.columns if c != "text"], F.lit("ppm")).alias("h")).where(F.col("h") < share)
    order = Window.partitionBy("lang").orderBy("h", F.xxhash64("text"), "text")
    # limited before the shuffle as well, whatever shares a hash
    first = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample)
    size = F.sum(F.octet_length("text").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return stage(first.withColumn("size", size).where((F.col("size") <= most // len(rows)) | (F.col("rank") == 1)).select("lang", "text"), "language-sample")


def train(docs: DataFrame, max_order: int = MAX_ORDER, sample: int = SAMPLE, most: int = MOST, langs: int = LANGS) -> Model | None:
    """A model of the languages of docs (lang, text, and any columns that tell rows apart), or None if there are none."""
    keep = sampled(docs, sample, most, langs)
    if keep is None:
        return None
    counts = count_grams(keep, max_order).toPandas()
    if not len(counts):
        return None
    model = build(sorted(set(counts["lang"])), counts, max_order)
    bits = keep.select(predict(model, F.col("text"), docs.sparkSession).alias("p")).where("p.lang_pred != 'und'").agg(F.percentile_approx("p.bits", 0.999, 10_000)).first()[0]
    model.usual = bits or 0.0
    return model


def predict(model: Model | None, text: Column, spark: SparkSession) -> Column:
    """struct<lang_pred string, score double, bits double>: the language, its posterior probability, and bits a byte of its code."""
    in_small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, bits double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            data = [t.encode() if m is not None and isinstance(t, str) and any(map(str.isalpha, t)) else b"" for t in texts]
            out = pd.DataFrame({"lang_pred": "und", "score": 0.0, "bits": 0.0}, index=range(len(data)))
            some = np.flatnonzero([len(d) > 0 for d in data])
            if len(some):
                length = m.code_lengths([data[i] for i in some])
                best = length.argmin(axis=1)
                least = length[np.arange(len(some)), best]
                out.loc[some, "lang_pred"] = np.array(m.langs, object)[best]
                out.loc[some, "score"] = 1.0 / np.exp2(np.maximum(-(length - least[:, None]) / UNIT, -1000.0)).sum(axis=1)
                out.loc[some, "bits"] = least / UNIT / np.array([len(data[i]) for i in some])
            yield out
        tidy()

    return of(text)


def contract_rows(docs: DataFrame) -> DataFrame:
    """Rows whose crc32 of doc_id leaves 0 or 2 on division by 3."""
    return docs.where(crc_remainder(F.col("doc_id"), 3) != 1).select("doc_id", "lang", "text")


def contract_model(docs: DataFrame) -> Model | None:
    """Learned from contract_rows()."""
    return train(contract_rows(docs))


def most_bits(model: Model | None, docs: DataFrame | None = None) -> float:
    """Bits a byte up to which a text is of a learned language: MARGIN times the 99.9th percentile of the training texts."""
    return MARGIN * model.usual if model is not None else 0.0


def is_coded(p: Column, text: Column, limit: float) -> Column:
    """Whether a prediction's code length is within the limit, to which SHORT bits a text are added."""
    return p["bits"] * F.octet_length(text) <= limit * F.octet_length(text) + SHORT


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = contract_model(docs)
    out = docs.select("doc_id", (crc_remainder(F.col("doc_id"), 3) == 1).alias("held_out"), predict(model, F.col("text"), spark).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")

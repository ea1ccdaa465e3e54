"""Mixture-controlled packing by deficit round-robin.

Every source is a queue of tokens, its documents one after another. Windows of `window`
tokens are filled with slots of `quantum` tokens. With each slot every queue's deficit,
what it is due less what it has got, grows by its share of the slot; of the queues that
are due enough, the one whose deficit would first reach a whole slot is served and pays
one. (With S queues, enough is 1 / (2S - 2) of a slot; this choice keeps every deficit
between -1 and 1 slot for ever, whatever the shares: Tijdeman's bound for the chairman
assignment problem.) Deficits pass from window to window. Within a window the slots of a
queue lie together, so a queue has one run of tokens in it.

Nothing here is sequential over the data. Shares are rounded to whole slots of a cycle of
CYCLE windows (a queue has one slot in it at least); deficits are zero again at its end,
so one cycle, worked out slot by slot, tells the place of every slot: each task works out
the windows of its own documents from the queues' lengths alone, whatever partition they
are in. When a queue can't fill its part of the next window it leaves the round, and the
others share what it would have got: a new phase begins, at most one for each queue. What
a queue has left then (less than a window and a slot) goes into a tail behind all
windows, so at most one sequence is short; it is padded unless its length is a power of two.

Sources are hashed into at most `queues` queues if there are more (so the table of
queue lengths that goes to every task is bounded); those with a target weight keep
queues of their own, and more of them than queues are an error. Without weights each
phase gives every queue its share of the tokens that are left. Token ids are computed once and
written to the shared folder, a row a document, and the pieces are cut from there.

Defined results: a null text is empty and has the closing id alone; a null source is a
queue of its own; repeated rows are packed as often as they occur; target weights of a
source that isn't named are its natural share; very long texts are cut like others.
"""

from __future__ import annotations

import json
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import in_small_batches, stage, table, tidy

WINDOW = 1024
QUANTUM = 64
QUEUES = 256
#: Windows after which the round-robin repeats itself.
CYCLE = 512
#: How a byte-level vocabulary cuts a text before it merges. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows of the table of queue starts (queues x partitions) that are broadcast at most.
BROADCAST = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def probe(vocabulary: str) -> tuple[bool, list[str], str]:
    """Whether tiktoken gives the ids of a tokenizer file, its special tokens' strings, and the type that holds an id.

    It does for byte-level vocabularies, several times faster; a text of many kinds of
    characters must come out alike.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    exact = Tokenizer.from_file(vocabulary)
    specials = [t["content"] for t in spec.get("added_tokens", [])]
    pre = spec.get("pre_tokenizer") or {}
    text = "It's  the 12th\n\n\tprobe: naïve Ünïcödé, 東京 🙂 don't_stop! "
    alike = spec["model"]["type"] == "BPE" and pre.get("type") == "ByteLevel" and not spec.get("normalizer")
    alike = alike and byte_level(vocabulary).encode_ordinary(text) == exact.encode(text, add_special_tokens=False).ids
    return alike, specials, "<u2" if exact.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"


def byte_level(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    specials = {t["content"] for t in spec.get("added_tokens", [])}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in specials}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoder(vocabulary: str, fast: bool, specials: list[str]):
    """text -> array of ids as the tokenizer file defines them, by tiktoken where it gives the same.

    Texts with a special token's string go to the tokenizer itself, which is loaded only then.
    """
    # kept for as long as the worker lives, and out of what is pickled
    cache = sys.modules.setdefault("tilewright_worker_cache", types.ModuleType("tilewright_worker_cache")).__dict__

    def held(kind: str, load):
        if (kind, vocabulary) not in cache:
            cache[kind, vocabulary] = load()
        return cache[kind, vocabulary]

    def encode(text: str) -> np.ndarray:
        if fast and not any(s in text for s in specials):
            return np.array(held("fast", lambda: byte_level(vocabulary)).encode_ordinary(text), np.uint32)
        return np.array(held("exact", lambda: Tokenizer.from_file(vocabulary)).encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def tokenized(docs: DataFrame, queues: int, vocabulary: str, probed: tuple, sources: list[str], rest: int) -> DataFrame:
    """A written table, queue i + 1 for sources[i], others hashed into `rest` queues behind (or in queue 0): doc_id, queue, part, ids (little-endian, 16 bits where they fit), n, and before: tokens of the queue in earlier rows of the part."""

    fast, specials, stored = probed

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(vocabulary, fast, specials), TaskContext.get().partitionId(), {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids = [np.append(encode(t) if t else np.zeros(0, np.uint32), np.uint32(0)) for t in b["text"].to_pylist()]
                before = []
                for q, x in zip(b["queue"].to_pylist(), ids):
                    before.append(seen.get(q, 0))
                    seen[q] = before[-1] + len(x)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"], b["queue"], pa.array([part] * len(ids), pa.int32()), pa.array([len(x) for x in ids], pa.int64()), pa.array(before, pa.int64()), pa.array([x.astype(stored).tobytes() for x in ids], pa.binary())],
                    ["doc_id", "queue", "part", "n", "before", "ids"],
                )
        tidy()

    own = F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(sources) for x in (s, i + 1)]), F.col("source")) if sources else F.lit(None).cast("int")
    other = F.pmod(F.xxhash64("source"), F.lit(rest)).cast("int") + (len(sources) + 1 if sources else 0) if rest else F.lit(0)
    queue = F.coalesce(own, other)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows_in = docs.select("doc_id", "text", queue.alias("queue"))
    return stage(rows_in.mapInArrow(rows, f"doc_id {kind}, queue int, part int, n long, before long, ids binary"), "tokens", "zstd")


def rounded_shares(shares: np.ndarray, total: int) -> np.ndarray:
    """Whole numbers of sum `total` near shares x total, each 1 at least."""
    exact = shares / shares.sum() * total
    out = np.maximum(np.floor(exact).astype(np.int64), 1)
    by = np.argsort(exact - out, kind="stable")
    while (more := total - int(out.sum())) > 0:
        out[by[::-1][:more]] += 1
    while out.sum() > total:  # a queue below one slot was given one: the largest pays
        out[out.argmax()] -= 1
    return out


def cycle_of(slots: np.ndarray) -> np.ndarray:
    """Which queue each slot of a cycle goes to; slots: how many each queue has in it."""
    n, total = len(slots), int(slots.sum())
    if n == 1:
        return np.zeros(total, np.int64)
    deficit, out, parts = np.zeros(n, np.int64), np.empty(total, np.int64), 2 * n - 2
    for i in range(total):
        deficit += slots
        ahead = (total * (parts - 1) - deficit * parts) / slots
        out[i] = served = np.where(deficit * parts >= total, ahead, np.inf).argmin()
        deficit[served] -= total
    return out


class Plan:
    """Where every token of every queue goes, from the queues' lengths and, if given, target weights."""

    def __init__(self, lengths: np.ndarray, weights: np.ndarray | None = None, window: int = WINDOW, quantum: int = QUANTUM):
        self.window, self.quantum, self.each = window, quantum, window // quantum
        self.total, self.n = int(lengths.sum()), len(lengths)
        self.cycle = max(CYCLE, -(-8 * self.n // self.each))
        self._tables: dict[int, tuple] = {}
        left, open_, at = lengths // quantum, lengths >= quantum, 0
        self.phases: list[tuple[int, np.ndarray, np.ndarray]] = []  # first window, queues, their slots in a cycle
        base = [np.zeros(self.n, np.int64)]  # slots of each queue that were served before each phase
        while open_.any():
            who = np.flatnonzero(open_)
            share = np.maximum((left if weights is None else weights)[who].astype(float), 1e-12)
            self.phases.append((at, who, rounded_shares(share, self.cycle * self.each)))
            before, _ = self.table(len(self.phases) - 1)
            m = self.phases[-1][2]
            runs = np.array([left[q] // m[i] * self.cycle + np.searchsorted(before[:, i], left[q] % m[i], side="right") - 1 for i, q in enumerate(who)])
            n = int(runs.min())  # windows for which every queue has enough
            served = n // self.cycle * m + before[n % self.cycle]
            left = left.copy()
            left[who] -= served
            base.append(base[-1].copy())
            base[-1][who] += served
            open_[who[runs == n]] = False
            at += n
        self.base = np.array(base)
        self.edge = self.base[-1] * quantum  # tokens of each queue in windows; the others are its tail
        self.tail = at * window + np.concatenate(([0], np.cumsum(lengths - self.edge)))
        self._tables = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": {}}  # each task works out the cycles that it needs

    def table(self, phase: int) -> tuple[np.ndarray, np.ndarray]:
        """(window of the cycle, queue): the queue's slots in earlier windows, and those of earlier queues in this one."""
        if phase not in self._tables:
            m = self.phases[phase][2]
            slot = np.arange(self.cycle * self.each) // self.each * len(m) + cycle_of(m)
            count = np.bincount(slot, minlength=self.cycle * len(m)).reshape(self.cycle, len(m))
            before = np.vstack((np.zeros(len(m), np.int64), np.cumsum(count, axis=0)))
            self._tables[phase] = before, np.cumsum(count, axis=1) - count
        return self._tables[phase]

    def places(self, queue: int, slot: np.ndarray) -> np.ndarray:
        """The place among all slots of the queue's slots that lie in windows."""
        phase = np.searchsorted(self.base[:, queue], slot, side="right") - 1
        out = np.empty(len(slot), np.int64)
        for p in np.unique(phase):
            mine = np.flatnonzero(phase == p)
            first, who, m = self.phases[p]
            before, beside = self.table(int(p))
            i = int(np.searchsorted(who, queue))
            cycle, rest = np.divmod(slot[mine] - self.base[p, queue], m[i])
            w = np.searchsorted(before[:, i], rest, side="right") - 1
            out[mine] = (first + cycle * self.cycle + w) * self.each + beside[w, i] + rest - before[w, i]
        return out

    def pieces(self, queue: int, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of n tokens from place `begin` of a queue as pieces: (run, start within it, length, place in the whole stream)."""
        q, edge, end = self.quantum, int(self.edge[queue]), begin + n

        def each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            run = np.repeat(np.arange(len(count)), count)
            return run, np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)

        stop = np.minimum(end, edge)
        run, nth = each(np.maximum(-(-stop // q) - begin // q, 0))
        slot = begin[run] // q + nth
        a, b = np.maximum(slot * q, begin[run]), np.minimum((slot + 1) * q, stop[run])
        place = self.places(queue, slot) * q + a - slot * q
        # the tail is one run, cut where windows end
        x = np.maximum(begin, edge)
        there, size = self.tail[queue] + x - edge, np.maximum(end - x, 0)
        late, nth = each(np.where(size > 0, (there + size - 1) // self.window - there // self.window + 1, 0))
        low = np.maximum(there[late], (there[late] // self.window + nth) * self.window)
        high = np.minimum(there[late] + size[late], (there[late] // self.window + nth + 1) * self.window)
        run, start = np.concatenate((run, late)), np.concatenate((a - begin[run], low - there[late] + x[late] - begin[late]))
        length, place = np.concatenate((b - a, high - low)), np.concatenate((place, low))
        by = np.lexsort((start, run))
        run, start, length, place = run[by], start[by], length[by], place[by]
        if len(run) > 1:  # join neighbours
            head = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % self.window == 0))))
            length = np.add.reduceat(length, head)
            run, start, place = run[head], start[head], place[head]
        return run, start, length, place


def pack(docs: DataFrame, weights: dict[str, float] | None = None, window: int = WINDOW, quantum: int = QUANTUM, queues: int = QUEUES, vocabulary: str | None = None) -> DataFrame:
    """Pieces of docs (doc_id, text, source): doc_id, queue, start, length, ids (binary), doc_tokens, sequence_id, offset, padded_length.

    weights: target shares by source; without them each queue's share of all tokens, so
    all run dry together but for rounding. With more sources than queues those named here have queues of
    their own and the others are hashed.
    """
    if window % quantum:
        raise ValueError("window must be a multiple of quantum")
    vocabulary = vocabulary or default_vocabulary()
    in_small_batches(docs.sparkSession)
    named = docs.where("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sources = [r.source for r in named.orderBy("source").select("source").limit(queues + 1).collect()]  # more than `queues` are hashed
    rest = 0
    if len(sources) > queues:
        known = docs.where(F.col("source").isin(list(weights))).select("source").distinct().orderBy("source").limit(queues + 1).collect() if weights else []
        sources = [r.source for r in known]
        rest = queues - len(sources)
        if rest < 1:
            raise ValueError(f"{len(sources)} or more sources have weights, and others none; with {queues} queues at most {queues - 1} can")
    probed = probe(vocabulary)
    stored = probed[2]
    tokens = tokenized(docs, queues, vocabulary, probed, sources, rest)
    parts = tokens.groupBy("queue", "part").agg(F.sum("n").alias("tokens"))
    earlier = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stage(parts.select("queue", "part", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base")), "queue-starts")
    if starts.count() <= BROADCAST:  # else the ids are shuffled once
        starts = F.broadcast(starts)
    width = queues + 1
    lengths = np.zeros(width, np.int64)
    for r in parts.groupBy("queue").agg(F.sum("tokens").alias("n")).collect():  # at most queues + 1 rows
        lengths[r.queue] = r.n
    share = None
    if weights:
        share = lengths.astype(float)
        for i, s in enumerate(sources):
            if s in weights:
                share[i + 1] = weights[s] * lengths.sum()
    plan = Plan(lengths, share, window, quantum)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = plan.total - 1
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                queue, base, before, n = (b[c].to_numpy(zero_copy_only=False) for c in ("queue", "base", "before", "n"))
                found = []
                for q in np.unique(queue):
                    own = np.flatnonzero(queue == q)
                    run, *rest = plan.pieces(int(q), (base + before)[own], n[own])
                    found.append((own[run], *rest))
                run, start, length, place = (np.concatenate(x) for x in zip(*found))
                by = np.lexsort((start, run))
                run, start, length, place = run[by], start[by], length[by], place[by]
                raw, edge, ids = b["ids"].to_pylist(), np.searchsorted(run, np.arange(b.num_rows + 1)).tolist(), []
                for i, packed in enumerate(raw):
                    whole = np.frombuffer(packed, stored).astype("<u4").tobytes()
                    ids += [whole[4 * x : 4 * (x + k)] for x, k in zip(start[edge[i] : edge[i + 1]].tolist(), length[edge[i] : edge[i + 1]].tolist())]
                sequence = place // window
                size = np.where(sequence == last // window, last % window + 1, window)
                padded = np.where((size & (size - 1)) == 0, size, window)
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].take(pa.array(run)), pa.array(queue[run]), pa.array(start), pa.array(length), pa.array(ids, pa.binary()), pa.array(n[run]), pa.array(sequence), pa.array(place % window), pa.array(padded)],
                    ["doc_id", "queue", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"],
                )
        tidy()

    placed = tokens.join(starts, ["queue", "part"]).select("doc_id", "queue", "n", "before", "base", "ids")
    return placed.mapInArrow(cut, f"doc_id {kind}, queue int, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, padded_length long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return contract_pieces(table(spark, sf_dir, "documents"))


def contract_pieces(docs: DataFrame) -> DataFrame:
    out = pack(docs.select("doc_id", "text", "source"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")

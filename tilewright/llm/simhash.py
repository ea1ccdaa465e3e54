"""SimHash near-duplicates, with pairs sifted by pivot distance tables.

A fingerprint has 64 bits; bit b is 1 if more than half of the document's shingle
hashes have it set. Two fingerprints link at 3 or fewer differing bits, and
documents that links connect form a component.

Pairs are found among distinct fingerprints:

1. The distances of every fingerprint to the pivots, PIVOTS reference fingerprints, are
   computed once. The pivots are fingerprints of the input that lie far apart. The
   difference of two fingerprints' distances to one pivot is at most their own distance,
   so a pair whose largest coordinate difference is over 3 is discarded unseen; the
   survivors are verified bit by bit.
2. A random pivot halves the pairs at best, whatever the number of fingerprints, so
   the table alone would still look at all pairs. The pivots of one bit each (and the
   zero fingerprint) give coordinates from which the bits themselves are read off: a
   fingerprint's coordinates on a block of them are its bits there. Of five blocks, two
   fingerprints with at most 3 differing bits agree on two at least, so pairs are only
   formed in cells of equal coordinates on two of the five blocks (ten cells for each
   fingerprint, no link is lost).
3. A cell of more than CELL members is cut into cells of its own in the same way: the
   bits that it doesn't fix yet are five new blocks. Each such cut fixes two fifths of
   what is left (26, 41, 50 and at least 55 of 64 bits), so after the third a cell has
   no more than 2^9 = CELL possible members: no more than CELL are ever compared with each
   other, and nothing is capped. A cell returns a spanning forest of its links, not all.

With `least` given, near_duplicates and keep_one link texts by the exact Jaccard similarity
of their sets of word shingles; every link is verified on the texts themselves. Candidates come
from the fingerprints first: the texts of a component of them, found by the pivot tables as
above, are a bucket. What these don't link, as near copies may differ in more than 3 bits, has
candidates that share a band of MinHashes (BANDS of ROWS: of pairs at 0.8 all but 1 in 14,000 do).
Buckets of the same members are looked at once. Components and the first bands are verified first; of the
others, buckets whose members are already connected have nothing to add and are left out,
so the copies of a large group are read for few buckets. A bucket of over CHUNK members is cut
into chunks, each compared within itself; then one text of each component so far meets those
of the others; and only chunks that are still not of one component meet each other in full.

Defined results: a text without words, or null, has fingerprint 0 and links like any
other. A null doc_id has a fingerprint and takes its component's smallest known id. Very long
texts are hashed whole, in blocks; repeated rows share a fingerprint and a component.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, hot_join, in_small_batches, row_share, shared_dir, stage, table, tidy

MAX_BITS = 3
SEED = 42
#: Blocks of bits that cells are formed of; two of them agree at MAX_BITS or fewer differing bits.
BLOCKS = 5
#: Members of a cell that are compared with each other; larger ones are cut further.
CELL = 512
#: Pivots, eight to a bigint, and fingerprints that they are chosen from.
PIVOTS, PIVOT_SAMPLE = 32, 2048
#: Most members of a MinHash bucket that are compared at once with as many others, and shingles of theirs.
CHUNK, CHUNK_SHINGLES = 512, 1 << 20
#: Edges of a file, at least, when components are sought.
EDGES = 20_000
#: Texts, or roots, that are looked up by a broadcast at most.
BROADCAST = 200_000
#: MinHash bands of a text, MinHashes in each, and bands that are verified first.
BANDS, ROWS, FIRST_BANDS = 24, 5, 4


def splitmix(n: int) -> list[int]:
    """n fixed 64-bit reference fingerprints."""
    out, x, mask = [], 0, (1 << 64) - 1
    for _ in range(n):
        x = (x + 0x9E3779B97F4A7C15) & mask
        z = x
        z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & mask
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & mask
        out.append(z ^ (z >> 31))
    return out


def shingle_hashes(text: str | None, words: int, block: int = 1 << 16) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles in order, a block at a time; a shorter text is one shingle, none has none."""
    tokens = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII white-space characters
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    del tokens
    starts, ends, h = starts[:n], ends[len(ends) - n :], xxhash.xxh64_intdigest
    for at in range(0, n, block):
        a, b = starts[at : at + block].tolist(), ends[at : at + block].tolist()
        yield np.fromiter((h(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, len(a))


def fingerprint_of(text: str | None, words: int = 3) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, words):
        ones += np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big", signed=True) if n else 0


def fingerprint(text: Column, words: int = 3) -> Column:
    """bigint: the 64 bits as a signed number."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint_of(t if isinstance(t, str) else None, words) for t in texts], dtype="int64")
        tidy()

    return of(text)


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def choose_pivots(prints: DataFrame, n: int = PIVOTS, sample: int = PIVOT_SAMPLE) -> list[int]:
    """n reference fingerprints: of a bounded sample of the input's (by hash) always the one farthest from those chosen; fixed numbers where there are too few."""
    enough = (1.2 * sample + 100) / max(prints.count(), 1)  # those that can be among the lowest
    low = prints.withColumn("h", row_share(F.col("fp"), F.lit("pivot"))).where(F.col("h") < enough).orderBy("h", "fp")
    some = np.array([r.fp for r in low.limit(sample).collect()], np.int64).view(np.uint64)  # `sample` rows at most
    out: list[int] = []
    if len(some):
        far = np.full(len(some), 65, np.int64)
        while len(out) < n and far.max() > MAX_BITS:
            out.append(int(some[far.argmax()]))
            far = np.minimum(far, np.bitwise_count(some ^ np.uint64(out[-1])))
    return out + splitmix(n - len(out))


def pivot_table(fp: Column, pivots: list[int]) -> Column:
    """array<bigint>: the distances to the pivots, eight of them packed into each number."""
    packed = []
    for at in range(0, len(pivots), 8):
        one = F.lit(0).cast("long")
        for i, p in enumerate(pivots[at : at + 8]):
            one = one.bitwiseOR(F.shiftleft(F.bit_count(fp.bitwiseXOR(F.lit(as_signed(p)))).cast("long"), 8 * i))
        packed.append(one)
    return F.array(*packed)


def cut(bits: list[int]) -> list[list[int]]:
    """The bits as BLOCKS blocks of neighbours, as equal as can be."""
    return [list(map(int, x)) for x in np.array_split(np.array(bits, int), BLOCKS)]


def splits(bits: list[int]) -> list[tuple[list[int], list[int]]]:
    """For every two blocks of the bits: theirs, and the rest."""
    return [([*a, *b], [x for x in bits if x not in a and x not in b]) for a, b in combinations(cut(bits), 2)]


def linked(fa, fb, pa_, pb) -> np.ndarray:
    """Which of the aligned pairs link: by the pivot tables first, then bit by bit."""
    near = np.arange(len(fa))
    for i in range(pa_.shape[1]):
        near = near[np.abs(pa_[near, i] - pb[near, i]) <= MAX_BITS]
        if not len(near):
            return near
    return near[np.bitwise_count(fa[near] ^ fb[near]) <= MAX_BITS]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links a-b over 0..n-1, as (member, root)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (way, k, fp, piv) sorted by (way, k) in, links between members of a cell out; a run of equal (way, k) is one cell."""

    def work(parts: list[pa.RecordBatch], cut: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).slice(0, cut).combine_chunks()
        way, k, node = (t[c].to_numpy() for c in ("way", "k", "fp"))
        fp = node.view(np.uint64)
        piv = t["piv"].combine_chunks().flatten().to_numpy().view(np.uint8).reshape(len(fp), -1).astype(np.int16)
        new = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (way[1:] != way[:-1]))))
        size = np.diff(np.append(new, len(fp)))
        out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
        for length in np.unique(size):
            at = new[size == length]
            if length <= 16:  # all cells of this size together
                for x in range(length):
                    for y in range(x + 1, length):
                        ok = linked(fp[at + x], fp[at + y], piv[at + x], piv[at + y])
                        out.append((node[at[ok] + x], node[at[ok] + y]))
                continue
            for s in at:
                e = s + length
                by = s + np.argsort(piv[s:e, 0], kind="stable")  # along a pivot, what lies over MAX_BITS ahead is out of reach
                reach = np.searchsorted(piv[by, 0], piv[by, 0] + MAX_BITS, side="right")
                found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
                for row in range(0, length, 64):
                    ends = reach[row : row + 64]
                    count = ends - np.arange(row, row + len(ends)) - 1
                    p = np.repeat(np.arange(row, row + len(ends)), count)
                    q = p + 1 + np.arange(len(p)) - np.repeat(np.cumsum(count) - count, count)
                    p, q = by[p], by[q]
                    ok = linked(fp[p], fp[q], piv[p], piv[q])
                    found.append((p[ok] - s, q[ok] - s))
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    member, root = forest(a, b, int(length))
                    out.append((node[s + member], node[s + root]))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], ["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        way, k = batch["way"].to_numpy(), batch["k"].to_numpy()
        last = int(((way == way[-1]) & (k == k[-1])).sum())  # the last cell may go on in the next batch
        if last == batch.num_rows:
            continue
        total = sum(b.num_rows for b in held)
        yield work(held, total - last)
        held = [batch.slice(batch.num_rows - last)]
    if held:
        yield work(held, sum(b.num_rows for b in held))


def links(prints: DataFrame) -> DataFrame:
    """(a, b): links between fingerprints whose components are those of all pairs at 3 or fewer bits.

    prints: (fp), each once.
    """
    spark, where = prints.sparkSession, ["way", "k"]
    ways = splits(list(range(64)))  # of each way into a cell: the bits that it fixes, and those left
    masks = [as_signed(sum(1 << b for b in fixed)) for fixed, _ in ways]
    tables = prints.withColumn("piv", pivot_table(F.col("fp"), choose_pivots(prints)))
    todo = tables.select("fp", "piv", F.explode(F.array(*[F.struct(F.lit(i).alias("way"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])).alias("c")).select("fp", "piv", "c.*")
    found = []
    while True:
        sizes = stage(todo.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-cells")
        found.append(todo.join(sizes.where(F.col("n") <= CELL).select(*where), where))
        large = sizes.where(F.col("n") > CELL)
        cut_on = sorted(r.way for r in large.select("way").distinct().collect())  # 10, 100 or 1000 ways at most
        if not cut_on:
            break
        deeper = [(old, fixed + more, rest) for old in cut_on for fixed, left in [ways[old]] for more, rest in splits(left)]
        steps = spark.createDataFrame([(old, new, as_signed(sum(1 << b for b in fixed))) for new, (old, fixed, _) in enumerate(deeper)], "way int, new int, mask long")
        members = stage(todo.join(large.select(*where), where).select("fp", "piv", "way"), "simhash-large-cells")
        # ten rows for each way that is cut
        todo = members.join(F.broadcast(steps), "way").select("fp", "piv", F.col("new").alias("way"), F.col("fp").bitwiseAND(F.col("mask")).alias("k"))
        ways = [(fixed, rest) for _, fixed, rest in deeper]
    # cells of different depths never meet: their numbers of ways are kept apart
    cells = None
    for depth, part in enumerate(found):
        part = part.select((F.col("way") + depth * 1_000_000).alias("way"), "k", "fp", "piv")
        cells = part if cells is None else cells.unionByName(part)
    return cells.repartition(*where).sortWithinPartitions(*where).mapInArrow(cell_links, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): every node of the edges with the smallest node it is connected to.

    Large-star and small-star steps in turn: each node's larger neighbours, then its
    smaller ones, are hung on the smallest node around, until only stars are left.
    Every round is checkpointed in the shared folder, in no more files than its edges need;
    there are as many as it takes.
    """
    shared_dir(edges.sparkSession)

    def step(e: DataFrame) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        return small.select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = edges.checkpoint()
    now = mark(edges)
    while True:  # ends, as roots only fall
        edges = step(edges).coalesce(1 + now[0] // EDGES).checkpoint()  # a step never adds edges
        seen, now = now, mark(edges)
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def normal_key(text: Column) -> Column:
    """md5 of a text's words: what texts of the same words in the same order are known by."""
    return F.md5(F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[\\x09-\\x0D ]+", " ")))


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The hashes of a text's distinct shingles, sorted; a shorter text is one shingle, and so is none."""
    blocks = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(blocks)) if blocks else np.array([xxhash.xxh64_intdigest(b"", SEED)], np.uint64)


def band_keys(text: Column, words: int) -> Column:
    """struct<print long, shingles int, bands array<bigint>>: the fingerprint, how many distinct shingles, and a hash of every band of MinHashes."""

    @F.pandas_udf("print long, shingles int, bands array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        flip, odd = (np.array(splitmix(2 * BANDS * ROWS), np.uint64).reshape(2, -1, 1))
        odd = odd | np.uint64(1)
        for texts in batches:
            sizes, out, prints = [], [], []
            for t in texts:
                t = t if isinstance(t, str) else None
                prints.append(fingerprint_of(t, words))
                hashes, low = shingle_set(t, words), None
                for at in range(0, len(hashes), 2048):
                    part = ((hashes[None, at : at + 2048] ^ flip) * odd).min(axis=1)
                    low = part if low is None else np.minimum(low, part)
                sizes.append(len(hashes))
                out.append([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(low.reshape(BANDS, ROWS))])
            yield pd.DataFrame({"print": np.array(prints, np.int64), "shingles": np.array(sizes, np.int32), "bands": out})
        tidy()

    return of(text)


def similar_links(words: int, least: float):
    """Rows (k, i, j, c, root, text) sorted by (k, i, j) in, links between the roots of similar texts out: a spanning forest of each unit's."""

    def alike(x: np.ndarray, y: np.ndarray) -> bool:
        if min(len(x), len(y)) < least * max(len(x), len(y)):
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= least * (len(x) + len(y) - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, members = None, []  # of each member: chunk, root, shingles, and the label of its component
        for batch in batches:
            a, b = [], []
            for k, i, j, c, root, text in zip(*(batch[n].to_pylist() for n in ("k", "i", "j", "c", "root")), batch["text"]):
                if unit != (k, i, j):
                    unit, members = (k, i, j), []
                own, label = shingle_set(text.as_py(), words), root
                for m in members:
                    if m[3] != label and (i == j or m[0] != c) and alike(m[2], own):
                        a.append(max(m[1], root))
                        b.append(min(m[1], root))
                        gone, label = label, m[3]
                        for x in members:
                            if x[3] == gone:
                                x[3] = label
                members.append([c, root, own, label])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        tidy()

    return run


def verified_roots(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, words: int, least: float) -> DataFrame:
    """(node, root): the nodes that links of at least `least` connect with others. nodes: (node, fp, first_id, print, shingles, bands), each once."""
    rows = docs.select(F.col(id_col).alias("first_id"), F.col(text_col).alias("text"))
    cells = nodes.select("node", "shingles", F.posexplode("bands").alias("band", "k"))

    def verify(cells: DataFrame) -> DataFrame:
        """cells: node, root, shingles, k. Buckets whose members have one root are left out, as are those of the same members as another."""
        same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")]
        shared = cells.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"), F.min("root").alias("low"), F.max("root").alias("high"), *same).where("low != high")
        shared = shared.groupBy("n", "s", "x", "y").agg(F.min("k").alias("k")).select("k", chunks_of(F.col("n"), F.col("s")).alias("chunks"))
        chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("c")
        members = stage(cells.join(shared, "k").select("k", "chunks", chunk, "node", "root"), "minhash-members")
        texts = read_texts(members)
        roots = linked(members.select("k", F.col("c").alias("i"), F.col("c").alias("j"), "c", "node", "root"), texts)
        large = members.where("chunks > 1")
        if not large.take(1):
            return roots
        # large buckets: one text of each root so far against those of the others, chunk by chunk
        large = stage(renamed(large, roots), "minhash-large")
        few = large.groupBy("k", "root").agg(F.min("node").alias("node"))
        sizes = few.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
        few = few.join(sizes, "k").select("k", "chunks", chunk, "node", "root").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        then = linked(few.select("k", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "node", "root"), texts)
        roots, large = chained(roots, then), renamed(large, then)
        # and what still isn't one: pairs of chunks, but for those of a single root
        mixed = large.groupBy("k", "c").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        ends = lambda n: mixed.select("k", F.col("c").alias(n), F.col("low").alias(f"{n}_low"), F.col("high").alias(f"{n}_high"))
        pairs = ends("i").join(ends("j"), "k").where("i < j and (i_low != i_high or j_low != j_high or i_low != j_low)").select("k", "i", "j")
        sides = pairs.withColumn("c", F.explode(F.array("i", "j")))
        return chained(roots, linked(large.join(sides, ["k", "c"]).select("k", "i", "j", "c", "node", "root"), texts))

    def chunks_of(n: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(n / CHUNK), F.ceil(shingles / CHUNK_SHINGLES)).cast("int")

    def read_texts(members: DataFrame) -> DataFrame:
        """A written table (node, text) of the members' texts."""
        wanted = stage(members.select("node").distinct().join(nodes.select("node", "fp", "first_id"), "node"), "minhash-wanted", rows=nodes.count())
        few = F.broadcast if wanted.count() <= BROADCAST else (lambda x: x)
        is_it = normal_key(F.col("text")) == F.col("fp")  # rows may share an id
        texts = rows.where("first_id is not null").join(few(wanted), "first_id").where(is_it).select("node", "text")
        nameless = rows.where("first_id is null").select("text", normal_key(F.col("text")).alias("fp")).join(few(wanted.where("first_id is null").select("node", "fp")), "fp")
        return stage(texts.unionByName(nameless.select("node", "text")).dropDuplicates(["node"]), "minhash-texts")

    def linked(units: DataFrame, texts: DataFrame) -> DataFrame:
        """(node, root) of the roots that links within units (k, i, j, c, node, root) connect."""
        units = units.join(texts, "node").select("k", "i", "j", "c", "root", "text")
        return components(units.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(similar_links(words, least), "a long, b long").distinct())

    def renamed(members: DataFrame, roots: DataFrame) -> DataFrame:
        last = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))  # checkpointed, so counted at no cost
        if last.count() <= BROADCAST:
            last = F.broadcast(last)
        return members.join(last, "root", "left").withColumn("root", F.coalesce("last", "root")).drop("last")

    def chained(roots: DataFrame, then: DataFrame) -> DataFrame:
        """(node, root) of both, the second about the roots of the first."""
        return renamed(roots, then).select("node", "root").unionByName(then.join(roots.select("node"), "node", "left_anti"))

    # the fingerprints' components are a band of their own, with keys apart from those of MinHashes
    prints = components(links(nodes.select(F.col("print").alias("fp")).distinct()))
    alike = nodes.join(prints.withColumnRenamed("node", "print"), "print", "left").select("node", "shingles", F.xxhash64(F.lit("simhash"), F.coalesce("root", "print")).alias("k"))
    early = cells.where(F.col("band") < FIRST_BANDS).select("node", "shingles", "k").unionByName(alike)
    first = verify(early.withColumn("root", F.col("node")))
    others = cells.where(F.col("band") >= FIRST_BANDS).join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    then = verify(others).select(F.col("node").alias("root"), F.col("root").alias("last"))  # of roots
    both = nodes.select("node").join(first, "node", "left").withColumn("root", F.coalesce("root", "node")).join(then, "root", "left")
    return both.select("node", F.coalesce("last", "root").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: float | None = None) -> DataFrame:
    """One row for each row of docs: its id, fp, component and component_id.

    fp is the fingerprint, and fingerprints link at 3 or fewer bits; with `least` it is normal_key(), and
    texts link at a Jaccard similarity of at least that between sets of `words`-word shingles. component
    (bigint) is one for each component, within one result.
    """
    in_small_batches(docs.sparkSession)
    first = [F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")]
    if least is None:
        prints = stage(docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), words).alias("fp")), "simhash")
        rows = prints.count()
        nodes = stage(prints.groupBy("fp").agg(*first).withColumn("node", F.col("fp")), "simhash-nodes", rows=rows)
        roots = components(links(nodes.select("fp")))
    else:
        prints = stage(docs.select(F.col(id_col).alias("doc_id"), normal_key(F.col(text_col)).alias("fp"), band_keys(F.col(text_col), words).alias("m")), "minhash")
        nodes = prints.groupBy("fp").agg(*first, F.first("m").alias("m")).select(F.monotonically_increasing_id().alias("node"), "fp", "first_id", "n", "m.*")
        rows = prints.count()
        nodes = stage(nodes, "minhash-nodes", rows=rows)  # a node keeps its number
        roots = verified_roots(docs, nodes, id_col, text_col, words, least)
    rooted = stage(nodes.join(roots, "node", "left").select("fp", "first_id", "n", F.coalesce("root", "node").alias("component")), "simhash-roots", rows=rows)
    names = stage(rooted.groupBy("component").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n")), "simhash-names", rows=rows)
    named = stage(hot_join(rooted.select("fp", "component", F.col("n").alias("rows")), names, "component").select("fp", "component", "component_id", F.col("rows").alias("n")), "simhash-named", rows=rows)
    return hot_join(prints.select("doc_id", "fp"), named, "fp").select(F.col("doc_id").alias(id_col), "fp", "component", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, least: float | None = None) -> DataFrame:
    """docs without near copies: of each component the row of its smallest id stays.

    Of repeated rows with that id, and of a component that has no ids, one row stays.
    """
    found = stage(near_duplicates(docs, id_col, text_col, words, least), "simhash-found")
    first = found.where(F.col(id_col) == F.col("component_id")).groupBy(id_col).agg(F.count(F.lit(1)).alias("__n"))
    kept = docs.join(first, id_col)
    one = kept.where("__n = 1").unionByName(kept.where("__n > 1").dropDuplicates([id_col])).select(*docs.columns)
    bare = found.where("component_id is null").select(F.col("fp").alias("__fp"), F.col("component").alias("__c")).distinct()
    name = fingerprint(F.col(text_col), words) if least is None else normal_key(F.col(text_col))
    lone = docs.where(F.col(id_col).isNull()).withColumn("__fp", name).join(bare, "__fp").dropDuplicates(["__c"])
    return one.unionByName(lone.select(*docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint in hexadecimal and component_id of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

"""Bottom-k sketches of shingle hashes.

A document's shingles are its runs of five lower-cased words (fewer words: the whole
sequence; none: no shingle). The k smallest distinct hashes of its shingles are its
sketch. Sketches merge: the k smallest of two sketches are the sketch of both parts.
From two sketches resemblance is estimated on the k smallest of their union, exactly
so when both have fewer than k hashes; containment follows from it and the counts.

Defined results: a null text is the empty text; two empty sketches have likeness 1,
an empty and another one 0; equal texts have equal sketches; very long texts are hashed
whole. Null ids come first; rows of one id follow each other by a hash of their texts.
"""

from __future__ import annotations

import json
import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let, table

K = 128
SHINGLE = 5
#: Blocks of neighbouring ids for each shuffle partition, when documents are put in order; and keys that are sampled for each.
BLOCKS, SAMPLED = 8, 16
#: Rows of one key, at least, that are dealt out.
HOT = 1000


def sketch(text: Column, k: int = K, words: int = SHINGLE) -> Column:
    """array<bigint>: the k smallest distinct shingle hashes, ascending."""
    tokens = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), "")

    def bottom(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(h) - (words - 1)), lambda i: F.xxhash64(F.slice(h, i, words)))
        hashes = F.when(F.size(h) >= words, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)

    return let(F.transform(tokens, lambda w: F.xxhash64(w)), bottom)


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_all(df: DataFrame, by: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each group, without gathering a group's sketches in one task: hashes are made distinct and ranked."""
    hashes = df.select(*by, F.explode(column).alias("__h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("__h"))
    return hashes.withColumn("__r", rank).where(F.col("__r") <= k).groupBy(*by).agg(F.sort_array(F.collect_list("__h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two shingle sets."""

    def of(both: Column) -> Column:
        return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(both, a), b)) / F.size(both))

    return let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the share of the hash range that k hashes fill."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63) + F.lit(1.0)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K, likeness: Column | None = None) -> Column:
    """Estimated share of a's shingles that b has: |A and B| / |A|, as J / (1 + J) x (|A| + |B|) / |A|. likeness: their resemblance, if known."""
    j, n, m = resemblance(a, b, k) if likeness is None else likeness, distinct_count(a, k), distinct_count(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def as_hex(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(df: DataFrame, order: str, carried: list[str], tie: Column, derived: dict[str, Column] | None = None, blocks: int | None = None) -> DataFrame:
    """df with next_<c> of the row that follows in the order (by `tie` where it is equal), for each carried column; after the last comes the first.

    derived: further carried columns, worked out once the rows are where they belong; they are returned
    too. Columns of df with a new one's name are replaced, all others stay.

    Rows are cut into blocks at keys (order, tie) of a sample of rows and ranked within them, so one
    shuffle of the carried columns does and no task holds all rows; of each block only its first row is
    sent to the block before. Rows of a key that fills more than two blocks are equal in all that is
    carried: they are dealt out at random, and each but the last has such a row next.
    """
    spark, derived = df.sparkSession, derived or {}
    blocks = blocks or BLOCKS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_carried = [*carried, *derived]
    own = [c for c in df.columns if c not in derived and c not in {f"next_{c}" for c in all_carried}]
    taken = set(own) | set(all_carried)
    key, block, salt, ahead = (next(n for n in (f"__{x}" + "_" * i for i in range(99)) if n not in taken) for x in ("key", "block", "salt", "ahead"))

    keyed = df.select(*[F.col(f"`{c}`") for c in own], F.struct(F.col(f"`{order}`").alias("o"), tie.alias("t")).alias(key))
    kind = keyed.schema[key].dataType.simpleString()
    size = max(min(SAMPLED * blocks, 200_000), 2 * blocks)
    chance = min(1.0, size / max(df.count(), 1))
    some = sorted(keyed.select(f"{key}.*").where(F.rand(7) < chance).collect(), key=lambda r: (r.o is not None, r.o, r.t))  # about `size` keys
    each = max(1, len(some) // blocks)
    cuts = {tuple(r) for r in some[each::each]}
    often = Counter(tuple(r) for r in some)
    hot = [k for k, n in often.items() if n >= 2 * each and n / chance >= HOT]
    cuts = sorted(cuts | set(hot), key=lambda k: (k[0] is not None, *k))

    def literal(keys) -> Column:
        return F.from_json(F.lit(json.dumps([{"o": o, "t": t} for o, t in keys], default=str)), f"array<{kind}>")

    # two steps of about the square root of the number of cuts
    width = max(1, math.isqrt(len(cuts)))
    groups = F.from_json(F.lit(json.dumps([[{"o": o, "t": t} for o, t in cuts[i : i + width]] for i in range(0, len(cuts), width)], default=str)), f"array<array<{kind}>>")
    before = lambda keys: F.size(F.filter(keys, lambda c: c <= F.col(key)))
    group = before(literal(cuts[::width]))
    number = let(group, lambda g: F.when(g == 0, F.lit(0)).otherwise((g - 1) * width + before(F.get(groups, g - 1)))) if cuts else F.lit(0)
    is_hot = F.exists(literal(hot), lambda c: c.eqNullSafe(F.col(key))) if hot else F.lit(False)
    keyed = keyed.withColumn(block, (2 * number + F.when(is_hot, 0).otherwise(1)).cast("int"))  # the rows of a hot key before the others of its block

    firsts = keyed.groupBy(block).agg(F.min(key).alias("first"))
    firsts = F.broadcast(firsts.select(F.col(block).alias("b"), "first"))  # 2 x blocks rows at most
    heads = keyed.join(firsts, (F.col(block) == F.col("b")) & F.col(key).eqNullSafe(F.col("first"))).dropDuplicates([block])
    heads = heads.withColumns(derived).select(F.col(block).alias("b"), F.struct(*all_carried).alias("head"))
    around = Window.orderBy("b")
    ids = heads.select("b", F.coalesce(F.lead("b").over(around), F.first("b").over(around)).alias("after"))
    after = ids.join(heads.withColumnRenamed("b", "after"), "after").select("b", "head")

    # so few parts that none of a hot key's is ever empty
    parts = min(max(often[k] for k in hot) // each + 1, int(min(often[k] for k in hot) / chance) // 64) if hot else 1
    spread = F.when(F.col(block) % 2 == 0, F.floor(F.rand(11) * parts)).otherwise(F.lit(0)).cast("int")
    rows = keyed.withColumn(salt, spread).repartition(block, salt).withColumns(derived)
    rank = Window.partitionBy(block, salt).orderBy(key)
    same = F.struct(*[F.col(f"`{c}`") for c in all_carried])
    rows = rows.withColumn(ahead, F.lead(same).over(rank))
    rows = rows.join(F.broadcast(after), F.col(ahead).isNull() & (F.col(salt) == 0) & (F.col(block) == F.col("b")), "left")
    following = F.coalesce(F.col(ahead), F.col("head"), same)
    return rows.select(*[F.col(f"`{c}`") for c in own], *derived, *[following[c].alias(f"next_{c}") for c in all_carried])


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's sketch against that of its edited text and of the next document, and what it tells of the number of its shingles and of the share that the edited text keeps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs, "doc_id", ["text"], F.xxhash64("text"), {"sk": sketch(F.col("text"))})
    cut = F.floor(F.char_length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.char_length("text") - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumn("edited", edited).withColumn("edited_sk", sketch(F.col("edited"))).withColumn("near_edited", resemblance(F.col("sk"), F.col("edited_sk")))
    return rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_hex(F.col("sk")).alias("fingerprint"),
        as_hex(F.col("edited_sk")).alias("edited_fingerprint"),
        "near_edited",
        resemblance(F.col("sk"), F.col("next_sk")).alias("near_next"),
        distinct_count(F.col("sk")).alias("n_shingles"),
        containment(F.col("sk"), F.col("edited_sk"), likeness=F.col("near_edited")).alias("kept_by_edited"),
    )

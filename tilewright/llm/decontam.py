"""Benchmark decontamination with a positional inverted index.

A benchmark item is cut into windows of `size` consecutive words (an item of fewer, but
not none, is one window). The corpus is searched for them in these steps:

1. Every text is cut into words once; a written table holds the words' hashes and their
   number, and the later steps read that.
2. How often each benchmark word occurs is counted over all documents.
3. For the `depth` rarest words of every window, postings (word, document, position)
   are stored: the index.
4. The lists of a window's rarest words, each moved back by the word's offset in the
   window, are intersected, rarest first. What is left are places where a window can
   start.
5. At these few places the words themselves are read from their documents and joined
   with the windows: exact phrase matches, whatever the hashes.

Proximity matches instead ask that all words of a window lie fewer than its size + `slack`
words from an occurrence of its rarest one, in any order. The lists of its two rarest words
are joined by stretches of the text, and where they meet the words around are compared
(by 64-bit hashes) with the window's.

Documents are known to the index by a hash of 96 bits of their text, so copies are
searched once and a text that many rows share makes one document in every join. No row
holds more than a text's places (start, size), one number each. Hashes of benchmark words are
broadcast while they are fewer than TERMS, other tables while they are fewer than
BROADCAST rows; beyond that they are joined by shuffle.

Defined results: a null text has no words; items without words match nothing; a null
item_id counts as an empty one; items of equal words all count; rows that repeat, or
share an id, get a result each; very long texts are searched whole, at every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, let, stage, table

SIZE = 10
DEPTH = 2
#: Words by which a proximity match may be wider than its window, on either side.
SLACK = 3
#: Rows, and hashes of words, that are broadcast at most.
BROADCAST, TERMS = 200_000, 1_000_000
#: What is no part of a word, once A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP), "")


def hashed(words_: Column) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def key_of(text: Column) -> list[Column]:
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.hash(text).alias("k2")]


def small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows. df should be a written table."""
    return F.broadcast(df) if df.count() <= (BROADCAST if limit is None else limit) else df


def windows(items: DataFrame, size: int = SIZE) -> DataFrame:
    """A written table: window (a number), phrase (its words, joined by blanks), size, words (hashes), items (ids as strings, sorted)."""
    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.col("text")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = cut.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, size))).alias("w"))
    named = each.groupBy(F.array_join("w", " ").alias("phrase")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    split = F.split("phrase", " ")
    return stage(named.select(F.monotonically_increasing_id().alias("window"), "phrase", F.size(split).alias("size"), hashed(split).alias("words"), "items"), "windows")


def read_words(docs: DataFrame, text: str = "text", own: list[str] = ()) -> DataFrame:
    """A written table: own (a struct of the columns so named), k1, k2, n_words, words (hashes in order) of every row of docs."""
    parts = docs.select(*([F.struct(*[F.col(f"`{c}`") for c in own]).alias("own")] if own else []), *key_of(F.col(text)), hashed(words(F.col(text))).alias("words"))
    return stage(parts.withColumn("n_words", F.size("words").cast("long")), "words")


def rarest(read: DataFrame, wins: DataFrame, depth: int) -> DataFrame:
    """A written table: window, size, rare: its `depth` rarest (n, offset, term), terms: its different words, rarest first; windows with a word that the corpus lacks are left out."""
    places = wins.select("window", "size", F.posexplode("words").alias("offset", "term"))
    n = wins.count()
    vocabulary = stage(places.select("term").distinct(), "vocabulary", rows=10 * n)
    counts = read.select(F.explode("words").alias("term")).join(small(vocabulary, TERMS), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    known = places.join(counts, "term").groupBy("window", "size").agg(F.array_sort(F.collect_list(F.struct("n", "offset", "term"))).alias("all"))
    return stage(known.where("size(all) = size").select("window", "size", F.slice("all", 1, depth).alias("rare"), F.array_distinct("all.term").alias("terms")), "rarest")


def index(read: DataFrame, rare: DataFrame) -> DataFrame:
    """A written table of postings (term, k1, k2, pos) of the words that are looked up, each once; the two rarest different ones of a window among them."""
    terms = stage(rare.select(F.explode(F.concat("rare.term", F.slice("terms", 1, 2))).alias("term")).distinct(), "terms", rows=10 * rare.count())
    spread = read.select("k1", "k2", F.posexplode("words").alias("pos", "term"))
    return stage(spread.join(small(terms, TERMS), "term").select("term", "k1", "k2", "pos").distinct(), "postings")


def candidates(postings: DataFrame, rare: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, start, size): places where the rarest words of a window stand as it has them."""
    lists = small(rare.withColumn("term", F.col("rare")[0]["term"]))
    found = postings.join(lists, "term").select("size", "rare", "k1", "k2", (F.col("pos") - F.col("rare")[0]["offset"]).alias("start")).where("start >= 0")
    for i in range(1, depth):
        more = F.col("rare")[i]
        deep = found.where(F.size("rare") > i).withColumn("term", more["term"]).withColumn("pos", F.col("start") + more["offset"])
        # a window of fewer words has no further list
        found = deep.join(postings, ["term", "k1", "k2", "pos"]).select(*found.columns).unionByName(found.where(F.size("rare") <= i))
    return found.select("k1", "k2", "start", "size").distinct()


def matches(docs: DataFrame, wins: DataFrame, rare: DataFrame, postings: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(k1, k2, start, end, items): the exact matches in each text of docs (text), end exclusive; a written table."""
    places = candidates(postings, rare, depth).groupBy("k1", "k2").agg(F.collect_list(F.struct("start", "size")).alias("places"))
    places = stage(places, "candidates")
    texts = docs.select("text", *key_of(F.col("text"))).join(small(places.select("k1", "k2")), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).join(places, ["k1", "k2"])
    there = let(words(F.col("text")), lambda w: F.transform("places", lambda p: F.struct(p["start"].alias("start"), (p["start"] + p["size"]).alias("end"), F.array_join(F.slice(w, p["start"] + 1, p["size"]), " ").alias("phrase"))))
    read_there = texts.select("k1", "k2", F.explode(there).alias("p")).select("k1", "k2", "p.*")
    return stage(read_there.join(small(wins).select("phrase", "items"), "phrase").select("k1", "k2", "start", "end", "items"), "matches")


def proximity(read: DataFrame, rare: DataFrame, postings: DataFrame, slack: int = SLACK, size: int = SIZE) -> DataFrame:
    """(k1, k2, pos, window): the rarest word of a window at pos, with every other word of it fewer than its size + slack words away; a written table."""
    reach = size + slack  # the widest
    known = rare.select("window", (F.col("size") + slack).alias("reach"), F.col("terms")[0].alias("term"), F.get("terms", F.lit(1)).alias("second"))
    seeds = postings.join(small(known), "term").select("window", "reach", "second", "k1", "k2", F.col("pos").alias("at"))
    stretch = F.floor(F.col("at") / reach)
    wide = seeds.where("second is not null").withColumn("stretch", F.explode(F.array(stretch - 1, stretch, stretch + 1)))
    second = postings.select(F.col("term").alias("second"), "k1", "k2", "pos", F.floor(F.col("pos") / reach).alias("stretch"))
    met = wide.join(second, ["second", "k1", "k2", "stretch"]).where(F.abs(F.col("pos") - F.col("at")) < F.col("reach"))
    kept = ["window", "k1", "k2", "at"]
    both = stage(met.select(*kept).distinct().unionByName(seeds.where("second is null").select(*kept)), "near-places")
    at = both.select("k1", "k2", "at").distinct().groupBy("k1", "k2").agg(F.collect_list("at").alias("at"))  # places of a text, each once
    texts = read.select("k1", "k2", "words").join(at, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
    around = F.transform("at", lambda a: F.struct(a.alias("at"), F.slice("words", F.greatest(a - reach + 2, F.lit(1)), a + reach - F.greatest(a - reach + 1, F.lit(0))).alias("around"), F.greatest(a - reach + 1, F.lit(0)).alias("base")))
    stretches = texts.select("k1", "k2", F.explode(around).alias("s")).select("k1", "k2", "s.*")
    asked = rare.select("window", (F.col("size") + slack).alias("reach"), "terms")
    low = F.greatest(F.col("at") - F.col("reach") + 1, F.lit(0))
    own = F.slice("around", low - F.col("base") + 1, F.col("at") + F.col("reach") - low)
    near = both.join(stretches, ["k1", "k2", "at"]).join(small(asked), "window").where(F.size(F.array_except("terms", own)) == 0)
    return stage(near.select("k1", "k2", F.col("at").alias("pos"), "window"), "near-matches")


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans (start, end), which are sorted by their start."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contaminated(docs: DataFrame, items: DataFrame, size: int = SIZE, depth: int = DEPTH, slack: int = SLACK, keep: list[str] | None = None) -> DataFrame:
    """docs (text and any other columns; those in `keep` are returned, else all) with n_words, n_hit, items (sorted ids of the items with a match) and n_near (items with a proximity match).

    Columns of docs with these four names are replaced; all others come back as they were.
    """
    own = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "n_hit", "items", "n_near")]
    read, wins = read_words(docs, "text", own), windows(items, size)
    rare = rarest(read, wins, depth)
    postings = index(read, rare)
    key, none = ["k1", "k2"], F.array().cast("array<string>")
    found = matches(docs.select("text"), wins, rare, postings, depth)
    spans = found.select(*key, "start", "end").distinct().groupBy(*key).agg(covered(F.array_sort(F.collect_list(F.struct("start", "end")))).cast("long").alias("n_hit"))
    names = found.select(*key, "items").distinct().select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.array_sort(F.collect_list("item")).alias("items"))
    close = proximity(read, rare, postings, slack, size).select(*key, "window").distinct().join(small(wins).select("window", "items"), "window")
    close = close.select(*key, F.explode("items").alias("item")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("n_near"))
    hits = stage(close.join(spans.join(names, key), key, "left"), "hits")  # an exact match is a near one, too
    out = read.drop("words").join(hits, key, "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("own.*", "n_words", count("n_hit"), F.coalesce("items", none).alias("items"), count("n_near"))


def keep_clean(docs: DataFrame, items: DataFrame, size: int = SIZE, depth: int = DEPTH) -> DataFrame:
    """docs that hold no window of any item."""
    read, wins = read_words(docs), windows(items, size)
    rare = rarest(read, wins, depth)
    found = matches(docs.select("text"), wins, rare, index(read, rare), depth).select("k1", "k2").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), *key_of(F.col("text")))
    return keyed.join(small(stage(found, "contaminated")), ["k1", "k2"], "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every document."""
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (
  SELECT DISTINCT n FROM wins
), spans AS (
  SELECT rid, p, n, array_to_string(w[p:p + n - 1], ' ') AS win
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN sizes)
), hits AS (
  SELECT s.rid, s.p, s.n, w.item FROM spans s JOIN wins w ON s.win = w.win AND s.n = w.n
), places AS (
  SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, p, n FROM hits)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
), spread AS (
  SELECT rid, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d
), counts AS (
  SELECT word, count(*) AS n FROM spread GROUP BY word
), ww AS (
  SELECT win, size, i, word FROM (SELECT win, size, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM (SELECT DISTINCT win, n AS size, string_split(win, ' ') AS ws FROM wins))
), rare AS (
  SELECT win, word FROM (SELECT ww.win, ww.word, row_number() OVER (PARTITION BY ww.win ORDER BY c.n, ww.i) AS rn FROM ww JOIN counts c ON ww.word = c.word) WHERE rn = 1
), seeds AS (
  SELECT s.rid, s.pos, r.win FROM spread s JOIN rare r ON s.word = r.word
), near AS (
  SELECT DISTINCT rid, win FROM (
    SELECT z.rid, z.pos, z.win, v.size, count(DISTINCT v.word) AS met FROM seeds z JOIN (SELECT DISTINCT win, size, word FROM ww) v ON z.win = v.win
    JOIN spread q ON q.rid = z.rid AND q.word = v.word AND abs(q.pos - z.pos) < v.size + {SLACK} GROUP BY z.rid, z.pos, z.win, v.size) m
  WHERE met = (SELECT count(DISTINCT word) FROM ww WHERE ww.win = m.win)
), close AS (
  SELECT rid, count(DISTINCT item) AS n_near FROM near JOIN wins ON near.win = wins.win GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(p.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(i.list, '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated, CAST(coalesce(c.n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN places p ON d.rid = p.rid LEFT JOIN items i ON d.rid = i.rid LEFT JOIN close c ON d.rid = c.rid
"""

"""Queries over the example index, lookups, order and batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import boxes, draws, paths
from ..operators import checks, index, lookup, ordering
from ..operators.index import ExampleIndex
from .geometry import chosen
from .views import CHOSEN, DET, FRAME_H, FRAME_W, box, detections, flat, table, uniform_sql


def example_index(spark, sf) -> ExampleIndex:
    """Frames are orders; an order without strong boxes was scanned and is empty."""
    scanned = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderkey").alias("frame_ord"))
    det = detections(spark, sf).withColumnRenamed("frame", "path")
    return ExampleIndex.build(det, scanned, 0.92, 8.0, 3)


IDX = (
    CHOSEN
    + """, ex AS (
  SELECT row_number() OVER (ORDER BY frame, n) - 1 AS idx, frame, n, x0, y0, x1, y1, score, label FROM chosen JOIN orders ON frame = o_orderkey WHERE n < 3
)"""
)


def enumerate_examples(spark, sf):
    return example_index(spark, sf).examples.select("idx", F.col("path").alias("frame"), "n", *flat(box()))


def enumerate_by_ranges(spark, sf):
    """The same numbers from many small ranges."""
    rows = example_index(spark, sf).examples.drop("idx")
    return index.in_order(rows, ["frame_ord", "n"], chunks=37).select("idx", F.col("path").alias("frame"), "n", *flat(box()))


ENUMERATE = f"WITH {IDX} SELECT idx, frame, n, x0, y0, x1, y1 FROM ex"


def index_stats(spark, sf):
    s = example_index(spark, sf).stats()
    q = [F.round(F.col(f"{a}.{b}"), 6).alias(f"{a}_{b}") for a in ("side", "score") for b in ("min", "p25", "median", "p75", "max")]
    return s.select("examples", "frames_with_boxes", "frames_scanned", F.round("hit_rate", 9).alias("hit_rate"), F.round("boxes_per_hit", 9).alias("boxes_per_hit"), *q)


_Q = lambda e, n: ", ".join(f"round(quantile_cont({e}, {q}), 6) AS {n}_{m}" for q, m in ((0.0, "min"), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (1.0, "max")))
INDEX_STATS = f"""WITH {IDX} SELECT count(*) AS examples, count(DISTINCT frame) AS frames_with_boxes, (SELECT count(*) FROM orders) AS frames_scanned,
  round(count(DISTINCT frame)::DOUBLE / (SELECT count(*) FROM orders), 9) AS hit_rate, round(count(*)::DOUBLE / count(DISTINCT frame), 9) AS boxes_per_hit,
  {_Q("greatest(x1 - x0, y1 - y0)", "side")}, {_Q("score", "score")} FROM ex"""


def label_counts(spark, sf):
    return index.label_counts(example_index(spark, sf).examples)


LABEL_COUNTS = f"WITH {IDX}, c AS (SELECT label, count(*) AS n, min(idx) AS first FROM ex GROUP BY label) SELECT label, n, row_number() OVER (ORDER BY n DESC, first) - 1 AS rank FROM c"


def quartiles_by_label(spark, sf):
    d = detections(spark, sf).groupBy(box()["label"].alias("label")).agg(index.quartiles(boxes.area(box())).alias("q"))
    return d.select("label", *[F.round(F.col(f"q.{n}"), 4).alias(n) for n in ("min", "p25", "median", "p75", "max")])


QUARTILES = f"""WITH {DET} SELECT label, {", ".join(f"round(quantile_cont((x1 - x0) * (y1 - y0), {q}), 4) AS {m}" for q, m in ((0.0, '"min"'), (0.25, "p25"), (0.5, "median"), (0.75, "p75"), (1.0, '"max"')))}
FROM det GROUP BY label"""


def scanned_left_join(spark, sf):
    by = example_index(spark, sf).by_path()
    return by.select(F.col("path").alias("frame"), F.size("boxes").cast("bigint").alias("n"), F.round(F.aggregate("boxes", F.lit(0.0), lambda a, b: a + boxes.area(b)), 4).alias("area"))


SCANNED = f"WITH {IDX} SELECT o_orderkey AS frame, count(idx) AS n, round(coalesce(sum((x1 - x0) * (y1 - y0)), 0)::DOUBLE, 4) AS area FROM orders LEFT JOIN ex ON frame = o_orderkey GROUP BY o_orderkey"


def keep_semi_join(spark, sf):
    keep = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"))
    return example_index(spark, sf).filtered(keep=keep).examples.select("idx", F.col("path").alias("frame"), "n", *flat(box()))


KEEP = f"""WITH {IDX} SELECT row_number() OVER (ORDER BY frame, n) - 1 AS idx, frame, n, x0, y0, x1, y1 FROM ex WHERE frame IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""


def filtered_predicate(spark, sf):
    out = example_index(spark, sf).filtered(0.95, 10.0, 1, predicate=box()["x_min"] >= 100)
    return out.examples.select("idx", F.col("path").alias("frame"), "n", *flat(box()))


FILTERED = f"""WITH {IDX}, k AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY score DESC, (x1 - x0) * (y1 - y0) DESC, n) - 1 AS n, x0, y0, x1, y1 FROM ex
  WHERE x0 >= 100 AND score >= 0.95 AND least(x1 - x0, y1 - y0) >= 10)
SELECT row_number() OVER (ORDER BY frame, n) - 1 AS idx, frame, n, x0, y0, x1, y1 FROM k WHERE n < 1"""


def index_slice(spark, sf):
    return example_index(spark, sf).slice(100, 350).examples.select("idx", F.col("path").alias("frame"), "n")


SLICE = f"WITH {IDX} SELECT idx, frame, n FROM ex WHERE idx >= 100 AND idx < 350"


def frames_in_order(spark, sf):
    f = example_index(spark, sf).frames()
    return f.select(F.col("path").alias("frame"), "first")


FRAMES = f"WITH {IDX} SELECT frame, min(idx) AS first FROM ex GROUP BY frame"


def dedup_keep_last(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    out = lookup.last_of(e, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return out.select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


DEDUP = "SELECT user_id, event_type, event_id, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1"


def render_frames(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "source")
    modality = F.when(F.col("doc_id") % 3 == 0, "lwir").otherwise("vis")
    return d.select("doc_id", F.concat(F.lit("/data/images/full/images/"), "source", F.lit("/"), modality, F.lit("/r."), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"))


FRAMES_SQL = "fr AS (SELECT doc_id, source, CASE WHEN doc_id % 3 = 0 THEN 'lwir' ELSE 'vis' END AS modality, '/data/images/full/images/' || source || '/' || CASE WHEN doc_id % 3 = 0 THEN 'lwir' ELSE 'vis' END || '/r.' || doc_id || '.png' AS path FROM documents)"


def path_parse(spark, sf):
    p = F.col("path")
    r = paths.render_parts(p)
    return render_frames(spark, sf).select("doc_id", r["split"].alias("split"), r["scene"].alias("scene"), r["modality"].alias("modality"), r["stem"].alias("stem"), paths.suffix(p).alias("suffix"), paths.is_image(p).alias("is_image"), paths.example_key(p, F.lit(2)).alias("example"))


PATH_PARSE = f"WITH {FRAMES_SQL} SELECT doc_id, 'full' AS split, source AS scene, modality, 'r.' || doc_id AS stem, '.png' AS suffix, true AS is_image, 'r.' || doc_id || '#2' AS example FROM fr"


def url_path_parse(spark, sf):
    """Names and stems of addresses, query and fragment cut off."""
    u = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    return u.select("page_id", paths.basename(F.col("path")).alias("name"), paths.stem(F.col("path")).alias("stem"), paths.suffix(F.col("path")).alias("suffix"))


URL_PATHS = r"""WITH u AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS p FROM pages), n AS (SELECT page_id, regexp_extract(p, '([^/]*)$', 1) AS name FROM u)
SELECT page_id, name, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '^(.+)\.[^.]+$', 1) ELSE name END AS stem, CASE WHEN regexp_matches(name, '^.+\.[^.]+$') THEN regexp_extract(name, '(\.[^.]+)$', 1) ELSE '' END AS suffix FROM n"""


def metadata_boxes(spark, sf):
    """Labels stand for a renderer's table: toxic for invisible, quality for the category."""
    lab = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    corner = lambda k, m: (F.col("doc_id") * k % m).cast("double")
    meta = lab.select(
        F.concat(F.lit("r."), F.col("doc_id").cast("string")).alias("image_name"), F.lit("full").alias("split"), F.col("source").alias("scene"), F.when(F.col("quality") == 1, "hull").alias("category"),
        corner(7, 500).alias("x_min_tight"), corner(5, 400).alias("y_min_tight"), (corner(7, 500) + 40).alias("x_max_tight"), (corner(5, 400) + 20).alias("y_max_tight"),
        (corner(7, 500) + 1).alias("x_min_tight_lwir"), (corner(5, 400) + 2).alias("y_min_tight_lwir"), (corner(7, 500) + 41).alias("x_max_tight_lwir"), (corner(5, 400) + 22).alias("y_max_tight_lwir"),
        (1 - F.col("toxic")).alias("is_target_visible"), (1 - F.col("toxic")).alias("is_target_visible_lwir"),
    )
    return lookup.metadata_boxes(render_frames(spark, sf), meta).select("path", *flat(box()), box()["label"].alias("label"))


METADATA = f"""WITH {FRAMES_SQL}, m AS (SELECT fr.path, l.quality, (fr.doc_id * 7 % 500)::DOUBLE AS x, (fr.doc_id * 5 % 400)::DOUBLE AS y, CASE WHEN modality = 'lwir' THEN 1 ELSE 0 END AS s
  FROM fr JOIN labels l ON fr.doc_id = l.doc_id WHERE l.toxic = 0)
SELECT path, x + s AS x0, y + 2 * s AS y0, x + 41 + s AS x1, y + 21 + 2 * s AS y1, CASE WHEN quality = 1 THEN 'hull' ELSE 'ship' END AS label FROM m"""


def key_form_lookup(spark, sf):
    """Records named by path, by name or by stem, some twice, for all but every fifth stem; frames find the first that fits best."""
    d = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("s"), F.concat(F.lit("f"), F.floor(F.col("doc_id") / 3).cast("string")).alias("stem"))
    path = F.concat(F.lit("/pool/"), (F.col("doc_id") % 2).cast("string"), F.lit("/"), F.col("stem"), F.lit(".png"))
    key = F.when(F.col("doc_id") % 4 == 0, path).when(F.col("doc_id") % 4 == 1, F.concat("stem", F.lit(".png"))).when(F.col("doc_id") % 4 == 2, F.col("stem"))
    records = d.where("s % 5 <> 4").select(key.alias("key"), F.col("doc_id").alias("key_ord")).where("key is not null")
    return lookup.find_keys(d.select(path.alias("path")).distinct(), records).select("path", "key")


KEY_FORMS = """WITH d AS (SELECT doc_id, doc_id // 3 AS s, doc_id % 2 AS p, 'f' || (doc_id // 3) AS stem FROM documents),
fr AS (SELECT DISTINCT '/pool/' || p || '/' || stem || '.png' AS path, stem || '.png' AS name, stem FROM d),
rec AS (SELECT doc_id AS o, CASE doc_id % 4 WHEN 0 THEN '/pool/' || p || '/' || stem || '.png' WHEN 1 THEN stem || '.png' ELSE stem END AS key, stem, doc_id % 4 AS k FROM d WHERE s % 5 != 4 AND doc_id % 4 < 3),
forms AS (SELECT key, o, 0 AS pr, key AS form FROM rec UNION ALL SELECT key, o, 1, CASE WHEN k < 2 THEN stem || '.png' ELSE stem END FROM rec UNION ALL SELECT key, o, 2, stem FROM rec),
fst AS (SELECT form, key FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY o, pr) AS rn FROM forms) WHERE rn = 1)
SELECT fr.path, coalesce(a.key, b.key, c.key) AS key FROM fr LEFT JOIN fst a ON fr.path = a.form LEFT JOIN fst b ON fr.name = b.form LEFT JOIN fst c ON fr.stem = c.form"""


def pool_stride(spark, sf):
    p = render_frames(spark, sf).select("path")
    return ordering.pool_sample(p, stride=7)


POOL_STRIDE = f"""WITH {FRAMES_SQL}, s AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path FROM fr))
SELECT path, row_number() OVER (ORDER BY path) - 1 AS frame_ord FROM s WHERE i % 7 = 0"""


def pool_limit_md5(spark, sf):
    """Every third frame, a seeded sample of 80 of them, shuffled."""
    return ordering.pool_sample(render_frames(spark, sf).select("path"), 3, 80, 11, True)


POOL_LIMIT = f"""WITH {FRAMES_SQL}, s AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS i FROM (SELECT DISTINCT path FROM fr)),
l AS (SELECT path FROM s WHERE i % 3 = 0 ORDER BY md5('11:' || path), path LIMIT 80) SELECT path, row_number() OVER (ORDER BY md5('11:order:' || path), path) - 1 AS frame_ord FROM l"""


def epoch_order_md5(spark, sf):
    ex = example_index(spark, sf).examples.select("idx")
    return ordering.epoch_order(ex, 5, 0).withColumn("epoch", F.lit(0)).unionByName(ordering.epoch_order(ex, 5, 1).withColumn("epoch", F.lit(1))).select("idx", "pos", "epoch")


EPOCH_ORDER = f"WITH {IDX} SELECT idx, row_number() OVER (ORDER BY md5('5:0:' || idx), idx) - 1 AS pos, 0 AS epoch FROM ex UNION ALL SELECT idx, row_number() OVER (ORDER BY md5('5:1:' || idx), idx) - 1, 1 FROM ex"


def batches(spark, sf):
    return ordering.batches(ordering.epoch_order(example_index(spark, sf).examples.select("idx"), 5, 0), 48, True).select("idx", "batch", "slot")


BATCHES = f"""WITH {IDX}, o AS (SELECT idx, row_number() OVER (ORDER BY md5('5:0:' || idx), idx) - 1 AS pos FROM ex)
SELECT idx, pos // 48 AS batch, pos % 48 AS slot FROM o WHERE (pos // 48 + 1) * 48 <= (SELECT count(*) FROM ex)"""


def virtual_index(spark, sf):
    """Visits of an endless stream over all examples, joined with them; visits far ahead reach later epochs."""
    ex = example_index(spark, sf).examples.select("idx", F.col("path").alias("frame"))
    e = table(spark, sf, "events").select((F.col("event_id") * 977).alias("j"))
    at, epoch = ordering.virtual(F.col("j"), ex.count())
    return e.select("j", at.alias("idx"), epoch.alias("epoch")).join(ex, "idx").select("j", "idx", "epoch", "frame")


VIRTUAL = f"WITH {IDX}, c AS (SELECT count(*) AS total FROM ex) SELECT event_id * 977 AS j, idx, (event_id * 977 // total)::BIGINT AS epoch, frame FROM events CROSS JOIN c JOIN ex ON idx = event_id * 977 % total"


def argminmax_width(spark, sf):
    d = detections(spark, sf).where(box()["score"] >= 0.95)
    first = lambda col: F.struct(col.alias("w"), "frame", "ord")
    w = boxes.width(box())
    low = d.groupBy(box()["label"].alias("label")).agg(F.min(first(w)).alias("lo"), F.min(first(-w)).alias("hi"))
    return low.select("label", F.col("lo.w").alias("min_w"), F.col("lo.frame").alias("min_frame"), (-F.col("hi.w")).alias("max_w"), F.col("hi.frame").alias("max_frame"))


ARGMINMAX = f"""WITH {DET}, r AS (SELECT label, frame, x1 - x0 AS w, row_number() OVER (PARTITION BY label ORDER BY x1 - x0, frame, ln, pk, sk) AS a, row_number() OVER (PARTITION BY label ORDER BY x1 - x0 DESC, frame, ln, pk, sk) AS b FROM det WHERE score >= 0.95)
SELECT l.label, l.w AS min_w, l.frame AS min_frame, h.w AS max_w, h.frame AS max_frame FROM r l JOIN r h ON l.label = h.label WHERE l.a = 1 AND h.b = 1"""


def width_band(spark, sf):
    """No box is as wide as asked, so the nearest one comes."""
    d = chosen(spark, sf, 1).select("frame", boxes.width(box()).alias("width"))
    return ordering.width_band(d, 1000.5, 1001.0).withColumn("asked", F.lit("none")).unionByName(ordering.width_band(d, 196.0, 200.0).withColumn("asked", F.lit("some")))


WIDTH_BAND = f"""WITH {CHOSEN}, w AS (SELECT frame, x1 - x0 AS width FROM chosen WHERE n < 1)
SELECT * FROM (SELECT frame, width, 'none' AS asked FROM w ORDER BY abs(width - 1000.5), frame, width LIMIT 1) UNION ALL SELECT frame, width, 'some' FROM w WHERE width BETWEEN 196 AND 200"""


def hit_rate_by_pool(spark, sf):
    """Share of scanned frames with a box, by pool."""
    i = example_index(spark, sf)
    pool = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), F.col("o_orderpriority").alias("pool"))
    hit = i.scanned.join(i.examples.select("path").distinct().withColumn("hit", F.lit(1)), "path", "left").join(pool, "path")
    return hit.groupBy("pool").agg(F.count(F.lit(1)).alias("frames"), F.count("hit").alias("hits"), F.round(F.count("hit") / F.count(F.lit(1)), 9).alias("rate"))


HIT_RATE = f"""WITH {IDX}, h AS (SELECT DISTINCT frame FROM ex) SELECT o_orderpriority AS pool, count(*) AS frames, count(frame) AS hits, round(count(frame)::DOUBLE / count(*), 9) AS rate FROM orders LEFT JOIN h ON frame = o_orderkey GROUP BY o_orderpriority"""


def union_of_patterns(spark, sf):
    """Two overlapping patterns of one pool: each path once, sorted."""
    p = render_frames(spark, sf)
    return ordering.pool_sample(p.where("path like '%lwir%'").select("path").unionByName(p.where("path like '%src1%'").select("path")))


UNION = f"WITH {FRAMES_SQL} SELECT path, row_number() OVER (ORDER BY path) - 1 AS frame_ord FROM (SELECT path FROM fr WHERE path LIKE '%lwir%' UNION SELECT path FROM fr WHERE path LIKE '%src1%')"


def contract_violations(spark, sf):
    d = detections(spark, sf).withColumn("pk", F.col("ord.pk")).withColumnRenamed("frame", "path")
    nan = F.when(F.col("pk") % 97 == 0, F.lit(float("nan"))).otherwise(box()["x_min"])
    broken = boxes.make(nan, box()["y_min"], F.when(F.col("pk") % 53 == 0, box()["x_min"] - 5).otherwise(box()["x_max"]), box()["y_max"], box()["score"], F.when(F.col("pk") % 41 == 0, F.lit(" ")).otherwise(box()["label"]))
    out = checks.detection_violations(d.withColumn("box", broken), FRAME_W, FRAME_H)
    return out.select(F.col("path").alias("frame"), F.col("ord.ln").alias("ln"), F.col("ord.pk").alias("pk"), F.col("ord.sk").alias("sk"), "rule")


VIOLATIONS = f"""WITH {DET}, b AS (SELECT *, CASE WHEN pk % 53 = 0 THEN x0 - 5 ELSE x1 END AS xe FROM det)
SELECT frame, ln, pk, sk, 'not finite' AS rule FROM b WHERE pk % 97 = 0
UNION ALL SELECT frame, ln, pk, sk, 'degenerate' FROM b WHERE pk % 97 != 0 AND xe - x0 <= 0
UNION ALL SELECT frame, ln, pk, sk, 'outside' FROM b WHERE pk % 97 != 0 AND (x0 < -1 OR y0 < -1 OR xe > 641 OR y1 > 513)
UNION ALL SELECT frame, ln, pk, sk, 'normalised' FROM b WHERE pk % 97 != 0 AND greatest(x0, y0, xe, y1) <= 1.5
UNION ALL SELECT frame, ln, pk, sk, 'label' FROM b WHERE pk % 41 = 0"""


def permutation_check(spark, sf):
    """An epoch's order of all examples has no problem; one with an example twice has."""
    ex = example_index(spark, sf).examples.select("idx")
    n = ex.count()
    order = ordering.epoch_order(ex, 5, 0)
    twice = order.withColumn("idx", F.when(F.col("idx") == 7, F.lit(8)).otherwise(F.col("idx")))
    label = lambda d, name: checks.permutation_problem(d, n).withColumn("case", F.lit(name))
    return label(order, "order").unionByName(label(twice, "twice"))


PERMUTATION = f"WITH {IDX} SELECT count(*) AS rows, count(*) - 1 AS \"distinct\", 0::BIGINT AS low, count(*) - 1 AS high, 'twice' AS \"case\" FROM ex"


def donor_join_md5(spark, sf):
    """Each example gets a donor part, by a draw."""
    donors = index.in_order(table(spark, sf, "part").select("p_partkey", "p_size"), ["p_partkey"], "donor_idx")
    ex = example_index(spark, sf).examples.select("idx", F.col("path").alias("frame"))
    n = donors.count()
    return ex.withColumn("donor_idx", draws.pick(F.lit(n), 3, F.col("idx"), "donor")).join(donors, "donor_idx").select("idx", "frame", "donor_idx", "p_partkey", "p_size")


DONOR = f"""WITH {IDX}, d AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS donor_idx FROM part),
e AS (SELECT idx, frame, floor({uniform_sql("'3:' || idx || ':donor'")} * (SELECT count(*) FROM part))::BIGINT AS donor_idx FROM ex) SELECT idx, frame, e.donor_idx, p_partkey, p_size FROM e JOIN d ON e.donor_idx = d.donor_idx"""


QUERIES = {
    "enumerate_examples": (enumerate_examples, ENUMERATE),
    "enumerate_by_ranges": (enumerate_by_ranges, ENUMERATE),
    "index_stats": (index_stats, INDEX_STATS),
    "label_counts": (label_counts, LABEL_COUNTS),
    "quartiles": (quartiles_by_label, QUARTILES),
    "scanned_left_join": (scanned_left_join, SCANNED),
    "keep_semi_join": (keep_semi_join, KEEP),
    "filtered_predicate": (filtered_predicate, FILTERED),
    "index_slice": (index_slice, SLICE),
    "frames_in_order": (frames_in_order, FRAMES),
    "dedup_keep_last": (dedup_keep_last, DEDUP),
    "path_parse": (path_parse, PATH_PARSE),
    "url_path_parse": (url_path_parse, URL_PATHS),
    "metadata_boxes": (metadata_boxes, METADATA),
    "key_form_lookup": (key_form_lookup, KEY_FORMS),
    "pool_stride": (pool_stride, POOL_STRIDE),
    "pool_limit_md5": (pool_limit_md5, POOL_LIMIT),
    "epoch_order_md5": (epoch_order_md5, EPOCH_ORDER),
    "batches": (batches, BATCHES),
    "virtual_index": (virtual_index, VIRTUAL),
    "argminmax_width": (argminmax_width, ARGMINMAX),
    "width_band": (width_band, WIDTH_BAND),
    "hit_rate_by_pool": (hit_rate_by_pool, HIT_RATE),
    "union_of_patterns": (union_of_patterns, UNION),
    "contract_violations": (contract_violations, VIOLATIONS),
    "permutation_check": (permutation_check, PERMUTATION),
    "donor_join_md5": (donor_join_md5, DONOR),
}

"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

1. Weights. A term of a unit or template weighs tf x (ln((1 + N) / (1 + df)) + 1), N the
   number of files and df of those with the term, copies included.
2. Units. Every line that could reach `least` with a short template is a header, and so is
   each run of such lines; of a licence file (LICENSE, LICENCE, COPYING, NOTICE, with any
   ending) the whole text is a unit too. Which lines could is told by the templates: a
   line's cosine to a template is at most the root of the share of the template's squared
   weight that lies on the line's terms, so it needs a term besides the commonest of the
   template's that together have less than the share least^2 (the gate). Nothing is lost by
   that, and no list of words decides. Equal units are scored once.
3. Scores. The sparse vectors meet in an inverted index of the templates' terms; a unit's
   licence is the template of the highest cosine, if that is at least `least`. Lines and
   runs are held against templates of up to LONG terms, whole licence files against all.
   A file's own licence is that of its best unit (ties: the name that sorts first); a licence
   file's whole text, if it has a licence, outweighs its lines, and a named licence outweighs
   the mere reservation of rights (NOTICE), which many licences begin with.
4. Inheritance. A file without a licence of its own takes that of the nearest directory
   at or above its own that has one. A directory's is that of its licence files (the
   best, ties as above). Directories are resolved once each by joins with their
   ancestors' paths; files then join their directory.

Defined results: a null or empty text has no unit; a null path inherits nothing;
repeated rows are files of their own with equal results; very long texts are read whole, line
by line; without templates nothing has a licence. Templates and directory
licences are broadcast while they are fewer than BROADCAST rows, else they are shuffled.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, let, stage, table

BROADCAST = 100_000
LEAST = 0.6
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"
LICENCE_FILE = r"^(licen[cs]e|copying|notice)(\..*)?$"
#: Most terms of a template that lines are held against.
LONG = 400
#: The licence that gives way to any other.
NOTICE = "Proprietary"

#: licence, a text that announces it
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Released under the ISC License."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved."),
]

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
#: Licences of a few paragraphs, whole.
BODIES = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_END),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
]


def gnu_headers(name: str, title: str, version: str, kind: str) -> list[tuple[str, str]]:
    """The usual header of a GNU licence, with later versions or without."""
    start = f"This {kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {title} as published by the Free Software Foundation; "
    return [(name, f"{start}either version {version} of the License, or (at your option) any later version."), (name, f"{start}version {version} of the License.")]


HEADERS = [
    *gnu_headers("GPL-2.0", "General Public License", "2", "program"), *gnu_headers("GPL-3.0", "General Public License", "3", "program"),
    *gnu_headers("LGPL-2.1", "Lesser General Public License", "2.1", "library"), *gnu_headers("LGPL-3.0", "Lesser General Public License", "3", "library"),
    *gnu_headers("AGPL-3.0", "Affero General Public License", "3", "program"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    *[(f"CC-{x.upper().replace(' ', '-')}-4.0", f"{by} CC {x.upper()} 4.0.") for x in ("by", "by-sa", "by-nc") for by in ("Released under", "This work is licensed under")],
    *[(f"CC-{x}-4.0", f"This work is licensed under a Creative Commons {long} 4.0 International License.") for x, long in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"))],
]
SPDX = [(name, f"SPDX-License-Identifier: {name}{end}") for name in dict.fromkeys(n for n, _ in TEMPLATES + HEADERS if n != "Proprietary") for end in (("", "-only", "-or-later") if "GPL" in name else ("",))]


def long_texts() -> list[tuple[str, str]]:
    """The texts in the folder licences, as their terms. The AGPL's is the GPL's but for its name and section 13, and is made from it."""
    out = []
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = path.read_text(encoding="utf-8").lower()
        out.append((path.stem, text))
        if path.stem == "GPL-3.0":
            out.append(("AGPL-3.0", re.sub(r"gnu\s+general\s+public", "gnu affero general public", text)))
    return [(name, " ".join(re.findall(TERM, text))) for name, text in out]


TEMPLATES += [*BODIES, *HEADERS, *SPDX, *long_texts()]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(TERM), F.lit(0))


def weighted_templates(files: DataFrame, templates: DataFrame, least: float) -> tuple[DataFrame, DataFrame, Column, list[str]]:
    """Written tables of the templates' weights (template, licence, long, term, weight) and of all terms (term, df), the idf as an expression of df, and the gate."""
    n = files.count()
    df = stage(files.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")), "licence-terms")
    idf = F.log(F.lit(1.0 + n) / (1 + F.coalesce("df", F.lit(0)))) + 1
    numbered = templates.select(F.xxhash64("licence", "text").alias("template"), "licence", terms(F.col("text")).alias("terms")).distinct()
    counts = numbered.select("template", "licence", (F.size("terms") > LONG).alias("long"), F.explode("terms").alias("term")).groupBy("template", "licence", "long", "term").agg(F.count(F.lit(1)).alias("tf"))
    index = stage(counts.join(df, "term", "left").select("template", "licence", "long", "term", (F.col("tf") * idf).alias("weight"), F.coalesce("df", F.lit(0)).alias("df")), "template-index", rows=1000 * templates.count())
    square = F.col("weight") * F.col("weight")
    upto = Window.partitionBy("template").orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    share = F.sum(square).over(upto) / F.sum(square).over(Window.partitionBy("template"))
    gate = index.where("not long").withColumn("share", share).where(F.round("share", 9) >= round(least * least, 9)).select("term").distinct()
    return index, df, idf, sorted(r.term for r in gate.collect())  # the templates' terms at most


def units(files: DataFrame, gate: list[str]) -> DataFrame:
    """(file, unit, key, body): the texts of each file that are held against templates, the md5 they are known by, and whether they are a whole licence file; files: file, path, text."""
    name = F.element_at(F.split(ascii_lower(F.coalesce("path", F.lit(""))), "/"), -1)
    low = files.select("file", name.rlike(LICENCE_FILE).alias("whole"), ascii_lower(F.col("text")).alias("low"))
    passed = F.array(*[F.lit(t) for t in gate]).cast("array<string>")
    marked = F.transform(F.split("low", "\r?\n"), lambda x: F.when(F.arrays_overlap(F.regexp_extract_all(x, F.lit(TERM), F.lit(0)), passed), F.trim(x)).otherwise(F.lit("")))

    def found(marked: Column) -> Column:
        lines = F.filter(marked, lambda x: x != "")
        # runs of such lines stand between empty ones
        runs = F.filter(F.transform(F.split(F.array_join(marked, "\n"), "\n\n+"), lambda x: F.trim(F.regexp_replace(x, "\n", " "))), lambda x: x != "")
        return F.when(F.size(lines) > 0, F.concat(lines, runs)).otherwise(F.array().cast("array<string>"))

    whole = F.when(F.col("whole"), F.array(F.trim("low"))).otherwise(F.array().cast("array<string>"))
    body = F.when(F.col("whole"), F.md5(F.trim("low"))).alias("body")
    parts = low.select("file", body, F.explode(F.array_distinct(F.concat(let(marked, found), whole))).alias("unit")).where("unit != ''").withColumn("key", F.md5("unit"))
    return parts.withColumn("body", F.coalesce(F.col("key") == F.col("body"), F.lit(False)))


def scored(texts: DataFrame, index: DataFrame, df: DataFrame, idf: Column) -> DataFrame:
    """(key, licence, score): the best template of each unit, a NOTICE only where there is no other at LEAST. texts: key, unit, whole."""
    bag = texts.select("key", "whole", F.explode(terms(F.col("unit"))).alias("term")).groupBy("key", "whole", "term").agg(F.count(F.lit(1)).alias("tf"))
    few = (lambda x: F.broadcast(x)) if index.count() <= BROADCAST else (lambda x: x)
    weighed = stage(bag.join(df, "term").select("key", "whole", "term", (F.col("tf") * idf).alias("w")), "unit-weights")
    lengths = index.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("template_norm"))
    norms = weighed.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(few(index.drop("df")), "term").where(F.col("whole") | ~F.col("long")).groupBy("key", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    cosine = F.round(F.col("dot") / F.col("norm") / F.col("template_norm"), 6)
    return dots.join(norms, "key").join(few(lengths), "template").groupBy("key", "licence").agg(F.max(cosine).alias("score"))


def directory(path: Column) -> Column:
    """The path without its last part; '' at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path.isNotNull(), F.lit("")))


def scan(files: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """files (path, text and others) with licence, score, origin (own, inherited or null) and origin_dir; clashing columns are replaced."""
    new = ("licence", "score", "origin", "origin_dir")
    own = [c for c in files.columns if c not in new]
    name = F.xxhash64(F.coalesce("path", F.lit("")), F.coalesce("text", F.lit("")))  # with the path below, what tells files apart
    keyed = files.select(F.struct(*own).alias("row"), name.alias("file"), F.col("path"), F.col("text"))
    index, df, idf, gate = weighted_templates(keyed, templates, least)
    parts = stage(units(keyed.select(F.struct("file", "path").alias("file"), "path", "text"), gate).distinct(), "licence-units")
    texts = stage(parts.groupBy("key").agg(F.min("unit").alias("unit"), F.max("body").alias("whole")), "licence-texts")
    fits = scored(texts, index, df, idf).where(F.col("score") >= least)
    rank = F.struct((F.col("licence") == NOTICE).alias("notice"), (-F.col("score")).alias("s"), "licence")
    known = stage(fits.groupBy("key").agg(F.min(rank).alias("b")), "licence-scores")
    few = F.broadcast(known) if known.count() <= BROADCAST else known
    found = parts.select("file", "key", "body").join(few, "key")
    found = found.groupBy("file").agg(F.min(F.struct("b.notice", ~F.col("body"), "b.s", "b.licence")).alias("b"))
    found = stage(found.select("file", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")), "file-licences")

    base = F.element_at(F.split(ascii_lower(F.col("file.path")), "/"), -1)
    owners = found.where(base.rlike(LICENCE_FILE)).groupBy(directory(F.col("file.path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    owners = stage(owners.select("dir", F.col("b.licence").alias("licence"), (-F.col("b.s")).alias("score")), "directory-licences")
    dirs = keyed.select(directory(F.col("path")).alias("dir")).where("dir is not null").distinct()
    steps = F.split("dir", "/")
    above = dirs.select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.struct(i.alias("depth"), F.when(i == 0, F.lit("")).otherwise(F.array_join(F.slice(steps, F.lit(1), i), "/")).alias("up")))).alias("a")).select("dir", "a.depth", F.col("a.up").alias("up"))
    held = F.broadcast(owners) if owners.count() <= BROADCAST else owners
    heirs = above.distinct().join(held.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("licence", "score", "up"), "depth").alias("d"))
    heirs = stage(heirs, "inherited-licences")

    out = keyed.select("row", F.struct("file", "path").alias("file"), directory(F.col("path")).alias("dir"))
    out = out.join(found, "file", "left").join(heirs, "dir", "left")
    mine = F.col("licence").isNotNull()
    return out.select(
        "row.*",
        F.coalesce("licence", "d.licence").alias("licence"), F.coalesce("score", "d.score").alias("score"),
        F.when(mine, "own").when(F.col("d").isNotNull(), "inherited").alias("origin"), F.when(~mine, F.col("d.up")).alias("origin_dir"),
    )


def document_path(doc_id: Column, source: Column) -> Column:
    """Documents have no paths: source/<id div 4096>/<id div 64>/<id>.txt, and every 64th id is its directory's LICENSE, every 4096th that of the one above."""
    top, sub = F.floor(doc_id / 4096).cast("string"), F.floor(doc_id / 64).cast("string")
    upper = F.concat_ws("/", F.coalesce(source, F.lit("none")), top)
    return F.when(doc_id % 4096 == 0, F.concat(upper, F.lit("/LICENSE"))).when(doc_id % 64 == 0, F.concat_ws("/", upper, sub, F.lit("LICENSE"))).otherwise(F.concat_ws("/", upper, sub, F.concat(doc_id.cast("string"), F.lit(".txt"))))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path, licence, score, origin, origin_dir of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), document_path(F.col("doc_id"), F.col("source"))).alias("path"))
    templates = spark.createDataFrame(TEMPLATES, "licence string, text string")
    return scan(docs, templates).select("doc_id", "path", "licence", "score", "origin", "origin_dir")


_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = rf"""
WITH f AS (
  SELECT doc_id, {_LOW.format("coalesce(text, '')")} AS low,
         CASE WHEN doc_id % 4096 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 4096) || '/LICENSE'
              WHEN doc_id % 64 = 0 THEN coalesce(source, 'none') || '/' || (doc_id // 4096) || '/' || (doc_id // 64) || '/LICENSE'
              ELSE coalesce(source, 'none') || '/' || (doc_id // 4096) || '/' || (doc_id // 64) || '/' || doc_id || '.txt' END AS path
  FROM documents
), d AS (
  SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, ends_with(path, '/LICENSE') AS whole FROM f
), df AS (
  SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(low, '{TERM}'))) AS term FROM d) GROUP BY term
), total AS (
  SELECT count(*) AS total FROM d
), t(template, licence, text) AS (
  VALUES {", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(TEMPLATES))}
), ts AS (
  SELECT template, licence, regexp_extract_all({_LOW.format("text")}, '{TERM}') AS terms FROM t
), tt AS (
  SELECT template, licence, len(terms) > {LONG} AS long, unnest(terms) AS term FROM ts
), ti AS (
  SELECT template, licence, long, tt.term, coalesce(any_value(df), 0) AS df, count(*) * (ln((1 + any_value(total)) / (1 + coalesce(any_value(df), 0))::DOUBLE) + 1) AS w
  FROM tt LEFT JOIN df ON tt.term = df.term CROSS JOIN total GROUP BY template, licence, long, tt.term
), gate AS (
  SELECT list(DISTINCT term) AS g FROM (
    SELECT term, sum(w * w) OVER (PARTITION BY template ORDER BY df DESC, term ROWS UNBOUNDED PRECEDING) / sum(w * w) OVER (PARTITION BY template) AS share FROM ti WHERE NOT long)
  WHERE round(share, 9) >= {round(LEAST * LEAST, 9)}
), l AS (
  SELECT doc_id, whole, low, i, CASE WHEN list_has_any(regexp_extract_all(line, '{TERM}'), g) THEN trim(line) ELSE '' END AS line
  FROM (SELECT doc_id, whole, low, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM (SELECT doc_id, whole, low, string_split_regex(low, '\r?\n') AS ls FROM d)) CROSS JOIN gate
), grp AS (
  SELECT doc_id, i, line, sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM l
), parts AS (
  SELECT doc_id, unit, max(body) AS body FROM (
    SELECT doc_id, line AS unit, false AS body FROM l WHERE line != ''
    UNION SELECT doc_id, trim(string_agg(line, ' ' ORDER BY i)), false FROM grp WHERE line != '' GROUP BY doc_id, g
    UNION SELECT doc_id, trim(low), true FROM d WHERE whole AND trim(low) != '')
  GROUP BY doc_id, unit
), texts AS (
  SELECT unit, max(body) AS whole FROM parts GROUP BY unit
), bag AS (
  SELECT unit, whole, term, count(*) AS tf FROM (SELECT unit, whole, unnest(regexp_extract_all(unit, '{TERM}')) AS term FROM texts) GROUP BY unit, whole, term
), tn AS (
  SELECT template, sqrt(sum(w * w)) AS norm FROM ti GROUP BY template
), ui AS (
  SELECT unit, whole, bag.term, tf * (ln((1 + total) / (1 + df)::DOUBLE) + 1) AS w FROM bag JOIN df ON bag.term = df.term CROSS JOIN total
), un AS (
  SELECT unit, sqrt(sum(w * w)) AS norm FROM ui GROUP BY unit
), cs AS (
  SELECT ui.unit, ti.template, ti.licence, round(sum(ui.w * ti.w) / any_value(un.norm) / any_value(tn.norm), 6) AS score
  FROM ui JOIN ti ON ui.term = ti.term JOIN un ON ui.unit = un.unit JOIN tn ON ti.template = tn.template WHERE ui.whole OR NOT ti.long GROUP BY ui.unit, ti.template, ti.licence
), best AS (
  SELECT unit, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY licence = '{NOTICE}', score DESC, licence) AS rn FROM cs WHERE score >= {LEAST}) WHERE rn = 1
), own AS (
  SELECT doc_id, licence, score FROM (SELECT p.doc_id, b.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY licence = '{NOTICE}', body DESC, score DESC, licence) AS rn FROM parts p JOIN best b ON p.unit = b.unit) WHERE rn = 1
), dl AS (
  SELECT dir, licence, score FROM (SELECT d.dir, o.licence, o.score, row_number() OVER (PARTITION BY d.dir ORDER BY score DESC, licence) AS rn FROM d JOIN own o ON d.doc_id = o.doc_id WHERE d.whole) WHERE rn = 1
), heirs AS (
  SELECT doc_id, licence, score, up FROM (
    SELECT d.doc_id, dl.licence, dl.score, dl.dir AS up, row_number() OVER (PARTITION BY d.doc_id ORDER BY length(dl.dir) DESC) AS rn
    FROM d JOIN dl ON d.dir = dl.dir OR starts_with(d.dir, dl.dir || '/')) WHERE rn = 1
)
SELECT d.doc_id, d.path, coalesce(o.licence, h.licence) AS licence, coalesce(o.score, h.score) AS score,
       CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN h.doc_id IS NOT NULL THEN 'inherited' END AS origin,
       CASE WHEN o.doc_id IS NULL THEN h.up END AS origin_dir
FROM d LEFT JOIN own o ON d.doc_id = o.doc_id LEFT JOIN heirs h ON d.doc_id = h.doc_id
"""

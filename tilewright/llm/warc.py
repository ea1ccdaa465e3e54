"""WARC archives: writing with revisits, reading back, and a merged index of captures.

Writing. Every capture becomes a WARC/1.1 record: a `response` with its payload, or,
where a later capture (larger id) has the same payload of at least MIN_REVISIT bytes, a
`revisit` that refers to the last such capture and has no payload. Records end with
CRLF CRLF, so Spark's own text writer, told to end its lines so, writes well-formed
archives to any file system that Spark reaches; its commit protocol keeps the files of
lost or repeated tasks out. Archives hold about ARCHIVE_MB each: pages far larger than
the mean go to archives of their own, so none has over WIDE x ARCHIVE_MB and two records.

Reading. Each archive is parsed by its Content-Length fields and yields the records
and a run of index entries (key, timestamp, id, archive, offset) sorted locally: a
capture run.

Index. The runs are cut at common key ranges of about RANGE entries, and in each range the
cut runs are merged by a loser tree by URL key, timestamp and id. Ranges follow one another,
so the whole is a globally ordered capture history; a URL with a third of all captures is
spread over ranges by its timestamps, equal captures by their places in the archives.

Defined results: a null html is an empty payload; a null url is kept as an empty target;
a null id has the first timestamp, can neither be referred to nor refer, and its capture is
a response. Repeated rows are records of their own; of rows with the largest id
of a payload the first by url is the response, of equal ones any. Very long pages are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import UPPER, shared_dir, stage, stage_path, table

MIN_REVISIT = 1000
#: Size of an archive, about; and how many times that at most, unless it is one record.
ARCHIVE_MB, WIDE = 16, 8
#: Bytes of a record besides its payload and url, about.
HEAD = 700
#: Index entries that a task merges, about.
RANGE = 100_000
#: Rows of the table of repeated payloads that are broadcast at most.
BROADCAST = 100_000
END = "\r\n\r\n"
#: Captures without a time of their own are one second apart by id, from this one on.
EPOCH = 1_704_067_200
URN = "urn:capture:"


def url_key(url: Column) -> Column:
    """com,example,www)/path?query of a URL, its host lower-cased."""
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), "^[^/?#]*?://", "")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, UPPER.lower())
    tail = F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail)


def captures(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) with payload, digest, refers_to (null for responses)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    # sha1 alone is read here; the payloads move only if there are too many repeated ones to broadcast
    repeated = stage(rows.where(f"bytes >= {MIN_REVISIT} and page_id is not null").groupBy("digest", "bytes").agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "bytes", "last"), "payloads")
    lookup = F.broadcast(repeated) if repeated.count() <= BROADCAST else repeated
    out = rows.join(lookup, ["digest", "bytes"], "left")
    return out.withColumn("refers_to", F.when(F.col("page_id") < F.col("last"), F.col("last"))).drop("last")


def settle_ties(rows: DataFrame) -> DataFrame:
    """Of several rows with the id that others refer to, all but one revisit it as well: the first by url stays."""
    name = ["page_id", "digest", "bytes"]
    tied = rows.where(F.col("bytes") >= MIN_REVISIT).groupBy(*name).agg(F.count(F.lit(1)).alias("n")).where("n > 1 and page_id is not null")
    tied = stage(tied.select(*name), "tied-captures")
    n = tied.count()
    if not n:
        return rows
    met = F.broadcast(tied) if n <= BROADCAST else tied
    # written with a number for each row, as equal rows can't be told apart otherwise
    late = stage(rows.join(met, name, "left_semi").withColumn("m", F.monotonically_increasing_id()), "tied-rows")
    first = late.groupBy(*name).agg(F.min(F.struct("url", "m")).alias("f")).select(F.col("f.m").alias("m"), F.lit(True).alias("first"))
    late = late.join(first, "m", "left").withColumn("refers_to", F.when(F.col("first").isNull(), F.coalesce("refers_to", "page_id")).otherwise(F.col("refers_to")))
    return rows.join(met, name, "left_anti").unionByName(late.select(*rows.columns))


def record(rows: DataFrame) -> Column:
    """The text of a record, without the CRLF CRLF that ends it."""
    revisit = F.col("refers_to").isNotNull()
    url = F.regexp_replace(F.coalesce("url", F.lit("")), "[\r\n]", "")
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n")
    body = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    name = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    second = F.lit(EPOCH) + F.coalesce(F.pmod("page_id", F.lit(1 << 32)), F.lit(0))
    pair = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    clock = [pair(second % 86400 / 3600), F.lit(":"), pair(second % 3600 / 60), F.lit(":"), pair(second % 60)]
    stamp = F.concat(F.date_from_unix_date(F.floor(second / 86400).cast("int")).cast("string"), F.lit("T"), *clock, F.lit("Z"))
    refers = F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{URN}"), F.col("refers_to").cast("string"), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"))).otherwise(F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), name,
        F.lit(">\r\nWARC-Date: "), stamp,
        F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nX-URL-Key: "), F.regexp_replace(url_key(F.col("url")), "[\r\n]", ""),
        F.lit("\r\n"), refers,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nX-Payload-Length: "), F.col("bytes").cast("string"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(body).cast("string"),
        F.lit(END), body,
    )


def size_groups(sizes: dict[int, tuple[int, int]], archive: int) -> list[tuple[float, float, int]]:
    """(over, up to, records an archive) by the size of a record; sizes: for each power of two the number of records up to it and their bytes.

    Records up to WIDE times the mean go together, larger ones by powers of WIDE, so an archive
    has at most WIDE x `archive` bytes, or one record.
    """
    n, total = (sum(x[i] for x in sizes.values()) for i in (0, 1))
    over, up_to, out = -1.0, max(1.0, WIDE * total / max(n, 1)), []
    while True:
        if not out or any(2.0**p > over and 2.0 ** (p - 1) <= up_to for p in sizes):
            out.append((over, up_to, max(1, int(archive * WIDE / up_to))))
        if up_to >= 2.0 ** max(sizes, default=0):
            return out
        over, up_to = up_to, up_to * WIDE


def write_archives(pages: DataFrame, path: str, archive_mb: int = ARCHIVE_MB) -> None:
    """pages (page_id, url, html) as WARC files under path."""
    size = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit(""))) * 2 + HEAD
    power = F.ceil(F.log2(size)).cast("int").alias("power")
    sizes = {r.power: (r.n, r.total) for r in pages.select(power, size.alias("size")).groupBy("power").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).collect()}  # 32 rows at most
    rows = settle_ties(captures(pages))
    size = F.col("bytes") + F.octet_length(F.coalesce("url", F.lit(""))) * 2 + HEAD
    for over, up_to, records in size_groups(sizes, archive_mb << 20):
        some = rows.where((size > over) & (size <= up_to)) if len(sizes) else rows
        some.select(record(some).alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records).text(path)


@dataclass
class Record:
    headers: dict[str, str]
    payload: bytes
    offset: int
    size: int


def parse(data: bytes) -> Iterator[Record]:
    """The records of an archive, found by their lengths; raises ValueError where it isn't one."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:end].decode("utf-8").split("\r\n")[1:]
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        block = end + 4
        stop = block + int(headers["Content-Length"])
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where it says")
        body = data.find(b"\r\n\r\n", block, stop) + 4
        yield Record(headers, data[body:stop], at, stop + 4 - at)
        at = stop + 4


ENTRY = "run string, url_key string, stamp string, page_id long, offset long, size long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The capture runs of the archives under path: index entries, each archive's sorted by (url_key, stamp, page_id).

    The digest and length of a response are taken from the payload that was read, and
    must be those of its header.
    """

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def ident(name: str | None) -> int | None:
            digits = (name or "").strip("<>").removeprefix(URN)
            return int(digits) if digits else None

        for batch in batches:
            for run, content in zip(batch["path"], batch["content"]):
                rows = []
                for r in parse(content):
                    h = r.headers
                    digest, size = h["WARC-Payload-Digest"].removeprefix("sha1:"), int(h["X-Payload-Length"])
                    if h["WARC-Type"] == "response":
                        got = hashlib.sha1(r.payload).hexdigest(), len(r.payload)
                        if got != (digest, size):
                            raise ValueError(f"the payload of {h['WARC-Record-ID']} isn't what its header says")
                        digest, size = got
                    rows.append((run, h["X-URL-Key"], h["WARC-Date"], ident(h["WARC-Record-ID"]), r.offset, r.size, h["WARC-Target-URI"], h["WARC-Type"], digest, size, ident(h.get("WARC-Refers-To"))))
                rows.sort(key=lambda x: (x[1].encode(), x[2], -1 if x[3] is None else x[3]))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])
                for c in ("page_id", "refers_to"):
                    out[c] = out[c].astype("Int64")
                yield out

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInPandas(entries, ENTRY)


class LoserTree:
    """Merges sorted runs: the loser of each match stays in its node, the winner is at the top."""

    def __init__(self, runs: list[list], key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.n = 1
        while self.n < len(runs):
            self.n *= 2
        self.node = [-1] * self.n
        self.top = self._play(1)

    def _head(self, run: int):
        """The next key of a run; past its end, or for no run, nothing is larger."""
        if run < 0 or run >= len(self.runs) or self.at[run] >= len(self.runs[run]):
            return (1,)
        return (0, self.key(self.runs[run][self.at[run]]), run)

    def _play(self, node: int) -> int:
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        winner, self.node[node] = (a, b) if self._head(a) <= self._head(b) else (b, a)
        return winner

    def __iter__(self):
        while True:
            run = self.top
            if self._head(run) == (1,):
                return
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node = (run + self.n) // 2
            while node:
                if self._head(self.node[node]) < self._head(run):
                    run, self.node[node] = self.node[node], run
                node //= 2
            self.top = run


def merge_runs(entries: DataFrame, ranges: int | None = None) -> DataFrame:
    """A written table: entries with position, their place in the globally sorted capture history (by URL key, timestamp, id, run, offset).

    A range has about RANGE entries, whatever their number.
    """
    spark = entries.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE))
    names = entries.columns

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list] = {}
        for batch in batches:  # the part of each run in this range, already in order
            batch = batch.astype(object).where(batch.notna(), None)
            for row in batch.itertuples(index=False, name=None):
                runs.setdefault(row[0], []).append(row)
        where = {c: i for i, c in enumerate((*names, "range"))}
        k, s, p = where["url_key"], where["stamp"], where["page_id"]
        tree = LoserTree([runs[r] for r in sorted(runs)], lambda row: (row[k].encode(), row[s], -1 if row[p] is None else row[p]))
        out = []
        for place, row in enumerate(tree):
            out.append((*row, place))
            if len(out) == 10_000:
                yield frame(out)
                out = []
        if out:
            yield frame(out)

    def frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*names, "range", "place"])
        for c in ("page_id", "refers_to"):
            out[c] = out[c].astype("Int64")
        return out

    order = ["url_key", "stamp", F.col("page_id").asc_nulls_first()]
    cut = entries.repartitionByRange(ranges, *order, "run", "offset").sortWithinPartitions("run", *order, "offset").withColumn("range", F.spark_partition_id())
    history = stage(cut.mapInPandas(merged, f"{ENTRY}, range int, place long"), "capture-history")
    counts = history.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return history.join(F.broadcast(starts), "range").withColumn("position", F.col("start") + F.col("place")).select(*names, "position")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC, read back and merged: page_id, payload_bytes, payload_digest, record_type, refers_to, and each capture's url_key, stamp and position in the history."""
    shared_dir(spark)
    path = stage_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    history = merge_runs(stage(read_archives(spark, path), "capture-runs"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "stamp", "position")


SQL = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages
), last AS (
  SELECT html, max(page_id) AS last FROM p GROUP BY html
), cut AS (
  SELECT page_id, regexp_replace(coalesce(url, ''), '^[^/?#]*?://', '') AS rest FROM p
), named AS (
  SELECT page_id, regexp_replace(array_to_string(list_reverse(string_split(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '.')), ',')
         || ')' || regexp_extract(rest, '^[^/?#]*([^#]*)', 1), '[\r\n]', '', 'g') AS url_key,
         strftime(make_timestamp((1704067200 + page_id % 4294967296) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp
  FROM cut
)
SELECT p.page_id, p.payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.payload_bytes >= 1000 AND p.page_id < l.last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.payload_bytes >= 1000 AND p.page_id < l.last THEN l.last END AS refers_to,
       n.url_key, n.stamp, row_number() OVER (ORDER BY n.url_key, n.stamp, p.page_id) - 1 AS position
FROM p JOIN last l ON p.html = l.html JOIN named n ON p.page_id = n.page_id
"""

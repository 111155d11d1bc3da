"""WARC archives with revisit records, and the merge of their capture indexes.

Pages become records of archive files that Spark's text sink writes (any file system, committed as a
whole). Read back, each file yields a run of index entries sorted by URL key and timestamp, and the
runs are written. An external merge puts them together: entries are dealt to ranges of the key, of a
bounded number of entries each, and each range merges its pieces of the runs with a loser tree, so that
ranges in order hold the capture histories in order.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import arrow_groups, bounded, importable, materialize, table, work_path

#: Payloads with fewer bytes are never revisited.
REVISIT_BYTES = 0
#: Records of an archive file at most, and entries that a task merges in the mean at most.
ARCHIVE_RECORDS, RANGE_ROWS = 10_000, 200_000
#: Seconds since 1970 of the capture with id 0; captures are a second apart, within the years 1 to 9999 that a date has room for.
FIRST_CAPTURE = 1_704_067_200
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
BASE32_HEX, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRIES = "run string, url_key string, ts string, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
CRLF = "\r\n"


def base32_sha1(text: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of the text in UTF-8."""
    digest = F.sha1(F.encode(text, "UTF-8"))
    groups = F.concat(*(F.lpad(F.conv(F.substring(digest, at, 5), 16, 32), 4, "0") for at in range(1, 41, 5)))
    return F.translate(groups, BASE32_HEX, BASE32)


def write_warc(pages: DataFrame, out: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = REVISIT_BYTES) -> None:
    """Writes a WARC record per row of pages to gzip-compressed archive files of ARCHIVE_RECORDS at most in the folder `out`.

    * Of rows with equal payloads of at least min_bytes bytes the one with the largest id is a
      response and the others are revisits that refer to it; all others are responses. Null payloads
      and urls are empty. Rows that repeat the largest id are each responses; a null id is written
      as an empty one and is a revisit unless all ids of its payload are null.
    * To find the responses only digests and ids are shuffled. One payload may be that of a third of
      all rows; ids are pre-aggregated, and the join that hands the response's id back has plain
      exchanges on both sides, which Spark splits where they are skewed. Payloads then move at most
      once, by id and digest, to meet the ids they refer to.
    * The date of a record is as many seconds after FIRST_CAPTURE as its id says; ids beyond the years 1 to 9999 have the first or the
      last second of these, and are put in order by the id itself.
    * Payloads may have any length. An empty table gives no records; other columns are not read.
    """
    spark = pages.sparkSession
    payload, url = F.coalesce(F.col(payload_col), F.lit("")), F.coalesce(F.col(url_col), F.lit(""))
    keys = work_path(spark, "warc-digests")
    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.octet_length(payload).cast("bigint").alias("bytes"), base32_sha1(payload).alias("digest"))
    rows.write.parquet(keys)
    rows = spark.read.schema(rows.schema).parquet(keys)
    found = work_path(spark, "warc-responses")
    rows.groupBy("digest").agg(F.max("id").alias("first")).write.parquet(found)
    firsts = spark.read.schema("digest string, first long").parquet(found)
    revisits = work_path(spark, "warc-revisits")
    older = rows.where(F.col("bytes") >= min_bytes).join(firsts, "digest").where((F.col("id") < F.col("first")) | (F.col("id").isNull() & F.col("first").isNotNull()))
    older.select(F.coalesce("id", F.lit(-1)).alias("id"), F.col("id").isNull().alias("none"), "digest", "first").distinct().write.parquet(revisits)
    older = spark.read.schema("id long, none boolean, digest string, first long").parquet(revisits)

    page = pages.select(F.col(id_col).cast("bigint").alias("id"), url.alias("url"), payload.alias("payload"), base32_sha1(payload).alias("digest"))
    page = page.withColumns({"key": F.coalesce("id", F.lit(-1)), "none": F.col("id").isNull()})
    older = older.select(F.col("id").alias("key"), "none", "digest", "first")
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    second = F.lit(FIRST_CAPTURE) + F.least(F.greatest(F.coalesce("id", F.lit(0)), F.lit(FIRST_SECOND - FIRST_CAPTURE)), F.lit(LAST_SECOND - FIRST_CAPTURE))
    seconds_of = lambda unit: F.lpad(F.pmod(F.floor(second / unit), F.lit(24 if unit == 3600 else 60)).cast("string"), 2, "0")
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(second / 86_400).cast("int"))  # a date has no zone
    date = F.concat(F.lpad(F.year(day).cast("string"), 4, "0"), F.date_format(day, "-MM-dd'T'"), seconds_of(3600), F.lit(":"), seconds_of(60), F.lit(":"), seconds_of(1), F.lit("Z"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length("payload"), F.lit(CRLF * 2))
    is_revisit = F.col("first").isNotNull()
    block = F.concat(http, F.when(is_revisit, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(is_revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), number("id"), F.lit(f">{CRLF}WARC-Date: "), date,
        F.lit(f"{CRLF}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(is_revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: <urn:page:"), number("first"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "), F.octet_length(block), F.lit(CRLF * 2),
    )
    record = F.concat(head, block, F.lit(CRLF)).alias("value")  # the sink's line end closes the record
    page.join(older, ["key", "none", "digest"], "left").select(record).write.option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", ARCHIVE_RECORDS).text(out)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an uncompressed WARC stream."""
    at = 0
    while line := stream.readline():
        size = len(line)
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            size += len(line)
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        length = int(headers["content-length"])
        block, end = stream.read(length), stream.read(4)
        if len(block) < length or end != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut short")
        size += len(line) + length + 4
        yield at, size, headers, block
        at += size


class _Inflated(io.RawIOBase):
    """The contents of a gzip file in memory, inflated as they are read."""

    def __init__(self, raw: bytes):
        self.rest, self.z = raw, zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            if self.z.eof:
                if not self.z.unused_data:
                    return 0
                self.rest, self.z = self.z.unused_data, zlib.decompressobj(31)
            data = self.z.decompress(self.rest, len(buffer))
            self.rest = self.z.unconsumed_tail
            if data or (not self.rest and not self.z.eof):
                buffer[: len(data)] = data
                return len(data)


def url_key(url: str) -> str:
    """Sortable key: host labels from the right, then path and query, in lower case."""
    try:
        parts = urlsplit(url.lower())
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def read_warc(spark: SparkSession, out: str) -> DataFrame:
    """Index entries of all records in the archives of `out`; each file is one run, sorted by (url_key, ts, page_id).

    Size and digest of a response come from its payload, those of a revisit from its headers. offset and
    length are those in the inflated archive. A folder without archives gives no entries; a record
    that is cut short is an error. A task holds one archive, inflated record by record.
    """
    importable(spark)
    names = [c.split()[0] for c in ENTRIES.split(", ")]
    schema = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in ENTRIES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = []
                for offset, length, headers, block in records(io.BufferedReader(_Inflated(content.as_py()), 1 << 16)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, size, digest = headers["warc-type"], len(payload), headers["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "revisit":
                        size = int(http.rpartition(b"Content-Length: ")[2])
                    else:
                        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    url, ts = headers["warc-target-uri"], "".join(c for c in headers["warc-date"] if c.isdigit())
                    rows.append((path, url_key(url), ts, _page(headers["warc-record-id"]), url, size, digest, kind, _page(headers.get("warc-refers-to")), offset, length))
                rows.sort(key=lambda r: (r[1], r[2], -1 if r[3] is None else r[3]))
                for at in range(0, len(rows), 5000):
                    columns = zip(*rows[at : at + 5000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(out).select("path", "content")
    return files.mapInArrow(bounded(run), ENTRIES)


class LoserTree:
    """Merges k sorted iterators; each inner node keeps the loser of its match, the winner moves up."""

    DONE = (1,)

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [self._next(i) for i in range(len(runs))]
        self.nodes = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._replay(i)

    def _next(self, i: int) -> tuple:
        """The head of run i with its number to break ties; greater than any other when the run is over."""
        row = next(self.runs[i], None)
        return self.DONE if row is None else (0, row[0], i, row)

    def _replay(self, i: int) -> None:
        at = (i + len(self.runs)) // 2
        while at:
            if self.nodes[at] < 0:  # the first to arrive waits for its opponent
                self.nodes[at] = i
                return
            if self.heads[self.nodes[at]] < self.heads[i]:
                i, self.nodes[at] = self.nodes[at], i
            at //= 2
        self.nodes[0] = i

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and (head := self.heads[self.nodes[0]]) is not self.DONE:
            yield head[3]
            i = self.nodes[0]
            self.heads[i] = self._next(i)
            self._replay(i)


def merge_runs(entries: DataFrame, parts: int | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The entries of all runs in global order of (url_key, ts, page_id), with `part`, `place` and `position`.

    Ranges are cut on all three columns, run and offset, so that one URL with a third of all captures
    still spreads over many ranges, and there are so many that a range has about range_rows entries
    at most: that is what a task holds, whatever the number of runs. `part` numbers the ranges in order;
    `place` counts from 0 within a range, `position` over all. Null ids come first; entries that tie
    are in order of their runs. No entries give an empty result.
    """
    importable(entries.sparkSession)
    order = ["url_key", "ts", "page_id"]
    entries = materialize(entries, "capture-runs")
    if parts is None:
        parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // range_rows))
    ranged = entries.repartitionByRange(parts, *order, "run", "offset")
    names = [c.split()[0] for c in ENTRIES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [t for _, t in arrow_groups(batches, "run")]

        def rows(t: pa.Table) -> Iterator[tuple]:
            for b in t.to_batches():
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield (r[1], r[2], -1 if r[3] is None else r[3]), r

        place, held = 0, []
        for _, row in LoserTree([rows(t) for t in pieces]):
            held.append((*row, place))
            place += 1
            if len(held) == 5000:
                yield _columns(held)
                held = []
        if held:
            yield _columns(held)

    def _columns(held: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64() if c.endswith("long") else pa.string() for c in ENTRIES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), [*types, pa.int64()], strict=True)], [*names, "place"])

    merged = ranged.sortWithinPartitions("run", *order).mapInArrow(bounded(run), ENTRIES + ", place long").withColumn("part", F.spark_partition_id())
    merged = materialize(merged, "captures")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")  # a row for each range
    starts = merged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    return merged.join(F.broadcast(starts), "part").withColumn("position", F.col("before") + F.col("place")).drop("before")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, reads the archives back and merges their indexes."""
    out = work_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return merge_runs(read_warc(spark, out)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "position")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS digest, lower(regexp_replace(coalesce(url, ''), '[\r\n]', '', 'g')) AS url,
         strftime(make_timestamp((1704067200 + least(greatest(coalesce(page_id, 0), -62135596800 - 1704067200), 253402300799 - 1704067200)) * 1000000), '%Y%m%d%H%M%S') AS ts
  FROM pages
), u AS (
  SELECT *, regexp_replace(regexp_replace(regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host,
         regexp_extract(url, '^(?:[a-z][a-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(url, '^[^?#]*[?]([^#]*)', 1) AS query
  FROM p
), k AS (
  SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END AS url_key FROM u
), f AS (
  SELECT *, row_number() OVER (ORDER BY url_key, ts, page_id NULLS FIRST) - 1 AS position, max(page_id) OVER (PARTITION BY html) AS first, CAST(unhex(digest) AS BIT)::VARCHAR AS bits FROM k
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_sum(list_transform(range(5), lambda b: CAST(substr(bits, CAST(i * 5 + b + 1 AS BIGINT), 1) AS INTEGER) * CAST(16 >> CAST(b AS INTEGER) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to, url_key, ts, position
FROM f
"""

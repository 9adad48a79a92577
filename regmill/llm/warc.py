"""WARC archives of pages, and a capture index merged from locally sorted runs.

Writing: one record a page, the HTML in UTF-8 behind an HTTP head (null: an empty payload). Of records whose
payloads are equal and have at least `least` bytes, the one with the largest page id is a response and the
others revisit it; all else, null ids included, is a response, and so is each of several rows that share the
largest id. Spark's text writer writes the archives, so they may lie in any store. Line breaks and blanks in
URLs are percent-encoded; a null URL leaves the header out. Record ids hold the page id and the row's place, so
those of rows without an id, or with one id, differ. An empty table gives one empty archive; other columns are not looked at.

Reading: archives are parsed by their Content-Length headers; digests and lengths of responses are those of the
payload that was read, revisits carry them in their headers. Every archive yields one run of captures, sorted by
URL key, time and page id, and numbered in that order.

Merging: runs are cut at common range boundaries, as many as the number of captures asks for; the pieces of a range, of
bounded size, keep the order of their runs, and a k-way loser tree merges them.
A URL that holds many captures is cut by time too. The result is globally ordered by (part, place).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import scratch
from .common import cut, keyed

ARCHIVE_BYTES = 32 << 20
#: Captures that one task merges, about.
ROWS_PER_RANGE = 100_000
END = "\r\n\r\n"
#: Captures without a time of their own are dated from here, one second for each page id.
EPOCH = "2020-01-01 00:00:00"
CAPTURE = (
    "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "url string, url_key string, captured_at string, archive string, offset long, length long"
)
COLUMNS = [x.split()[0] for x in CAPTURE.split(", ")]
#: A capture of a run has its place in the run's order too.
RUN = CAPTURE + ", in_run long"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32: 160 bits are four groups of eight digits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.upper(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _head(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")


def write(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Archives of pages (page_id, url, html) in a new folder, of about archive_bytes each, or one record if that is larger.

    Records are written by size classes of four to one, each with as many records a file as fit; no page is moved.
    """
    pages, place = keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")))
    rows = pages.select("page_id", "url", "html", F.concat_ws("-", *place).alias("place"), F.octet_length("html").cast("long").alias("bytes"), base32_sha1(F.col("html").cast("binary")).alias("digest"))
    known = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.count("*").alias("n"), F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "place"))).alias("first"))
    copied = cut(known.where("n > 1 AND first IS NOT NULL").drop("n"), "copied")
    linked = rows.join(copied, ["digest", "bytes"], "left").withColumn("revisit", F.coalesce(F.col("page_id") < F.col("first.page_id"), F.lit(False)))
    urn = lambda ident, at: F.concat(F.lit("<urn:page:"), F.coalesce(ident.cast("string"), F.lit("")), F.lit(":"), at, F.lit(">"))
    url = F.col("url")
    for char in "\r\n\t ":
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    when = F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.coalesce(F.col("page_id"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(F.col("revisit"), "").otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response"), F.lit("\r\n"),
        _head("WARC-Record-ID", urn(F.col("page_id"), F.col("place"))), _head("WARC-Date", when), _head("WARC-Target-URI", url),
        _head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _head("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("first.page_id"), F.col("first.place")))),
        _head("WARC-Profile", F.when(F.col("revisit"), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        F.lit("Content-Type: application/http;msgtype=response\r\n"), _head("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"),
    )
    # the page, and what stands around it
    kind = F.floor(F.log(4.0, F.col("bytes") + F.coalesce(F.octet_length("url"), F.lit(0)) + 700)).cast("int")
    kinds = sorted(r[0] for r in pages.select(F.floor(F.log(4.0, F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) + 700)).cast("int")).distinct().collect())  # sixteen at most
    for k in kinds or [5]:
        per_file = max(1, archive_bytes // 4 ** (k + 1))
        some = linked.where(kind == k).withColumn("block", block).select(F.concat(head, F.col("block")).alias("value"))
        some.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", per_file).text(folder)


def url_key(url: str) -> str:
    """Host labels reversed, then the rest: captures of a site stand together."""
    found = re.match(r"(?s)[^:/?#]+://([^/?#]*)([^#]*)", url)
    if not found:
        return url.lower()
    host, port = (found[1].rpartition("@")[2].lower().split(":", 1) + [""])[:2]
    labels = host.removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + (found[2] or "/").lower()


_BLANK_LINE = re.compile(rb"\r\n\r\n")


def records(data: bytes | memoryview) -> Iterator[tuple[int, int, dict[str, str], memoryview]]:
    """Offset, length, headers and block of each record of an archive, of which nothing is copied but the headers."""
    view, at = memoryview(data), 0
    while at < len(view):
        head_end = _BLANK_LINE.search(view, at).start()
        lines = bytes(view[at:head_end]).decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = head_end + 4
        end = start + int(headers["content-length"])
        yield at, end + 4 - at, headers, view[start:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):[-\d]*>", urn or "")
    return int(found[1]) if found else None


def _order(row: tuple) -> tuple:
    """URL key, time, page id; null ids first."""
    return row[6], row[7], row[0] is not None, row[0] or 0


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted run of each archive."""
    for b in batches:
        for path, content in zip(b.column("path"), b.column("content"), strict=True):
            rows = []
            for offset, length, h, block in records(memoryview(content.as_buffer())):
                http_end = _BLANK_LINE.search(block)
                http, payload = block[: http_end.start()], block[http_end.end() :]
                revisit = h["warc-type"] == "revisit"
                size = int(re.search(rb"(?i)content-length: (\d+)", http)[1]) if revisit else len(payload)
                digest = h["warc-payload-digest"].removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
                url = h.get("warc-target-uri")
                rows.append((_page(h.get("warc-record-id")), size, digest, h["warc-type"], _page(h.get("warc-refers-to")), url, url_key(url or ""), h["warc-date"], path.as_py(), offset, length))
            rows.sort(key=_order)
            columns = zip(*rows, strict=True) if rows else [[]] * len(COLUMNS)
            typed = {c: pa.array(list(v), pa.int64() if c in ("page_id", "payload_bytes", "refers_to", "offset", "length") else pa.string()) for c, v in zip(COLUMNS, columns, strict=True)}
            yield pa.record_batch(typed | {"in_run": pa.array(range(len(rows)), pa.int64())})


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives in a folder, one sorted run for each archive."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(_captures, RUN)


class LoserTree:
    """Merges sorted sequences: inner nodes hold the losers of their matches, so the next winner costs one path."""

    def __init__(self, runs: list[Sequence], key):
        self.runs, self.key, self.k = runs, key, max(1, len(runs))
        self.at = [0] * self.k
        self.heads = [self._head(i) for i in range(self.k)]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._play(i, building=True)

    def _head(self, i: int) -> tuple:
        """Ends sort last; equal keys go by run."""
        run = self.runs[i] if i < len(self.runs) else []
        return (0, self.key(run[self.at[i]]), i) if self.at[i] < len(run) else (1, (), i)

    def _play(self, i: int, building: bool = False) -> None:
        winner, node = i, (i + self.k) // 2
        while node:
            if self.tree[node] < 0 and building:
                self.tree[node] = winner
                return
            if self.heads[self.tree[node]] < self.heads[winner]:
                winner, self.tree[node] = self.tree[node], winner
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[i := self.tree[0]][0] == 0:
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            self._play(i)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One range, about ROWS_PER_RANGE captures: its pieces of the runs lie behind one another, and are merged by their places."""
    table = pa.Table.from_batches(list(batches)).combine_chunks() if (batches := list(batches)) else None
    if table is None or not table.num_rows:
        return
    runs = table.column("archive").combine_chunks().dictionary_encode().indices.to_numpy()
    starts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), table.num_rows]
    url, time, page = (table.column(c).combine_chunks() for c in ("url_key", "captured_at", "page_id"))

    def key(i: int) -> tuple:
        """URL key, time, page id; null ids first."""
        ident = page[i].as_py()
        return url[i].as_py(), time[i].as_py(), ident is not None, ident or 0

    merged = iter(LoserTree([range(a, b) for a, b in itertools.pairwise(starts)], key))
    at = 0
    while chunk := list(itertools.islice(merged, 10_000)):
        (out,) = table.take(pa.array(chunk)).combine_chunks().to_batches()
        yield pa.record_batch({c: out.column(c) for c in (*COLUMNS, "part")} | {"place": pa.array(range(at, at + len(chunk)), pa.int64())})
        at += len(chunk)


def merge(captures: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """All runs as one history, ordered by URL key, time and page id: columns of captures, part, place."""
    runs = cut(captures, "runs")
    order = [F.asc("url_key"), F.asc("captured_at"), F.asc_nulls_first("page_id")]
    ranges = runs.repartitionByRange(max(1, -(-runs.count() // rows_per_range)), *order).withColumn("part", F.spark_partition_id())
    # a piece of a run comes in the order in which the run was sorted; only the merge compares captures
    return ranges.sortWithinPartitions("archive", "in_run").mapInArrow(_merged, CAPTURE + ", part int, place long")


def archive_and_index(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and merge their index."""
    spark = pages.sparkSession
    folder = scratch(spark, "warc")
    write(pages, folder, least)
    return merge(read(spark, folder))

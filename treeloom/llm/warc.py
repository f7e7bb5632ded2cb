"""WARC archives and an external merge of their capture index.

Spark's text writer lays the records down, the blank lines after a record
being its line separator.  Each archive file is streamed back and becomes one
locally sorted run of captures; runs are dealt by ranges of (URL key,
timestamp) of bounded size and each task merges its slices with a loser tree,
so that the captures of all tasks together are in global order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, drop_written, shared_path

#: Payloads below this size are never revisits.
REVISIT_BYTES = 1000
#: Records of an archive file; its captures, without payloads, are sorted in memory.
FILE_RECORDS = 20_000
#: Captures that a task merges, about.
MERGE_ROWS = 200_000
#: Captures are dated within so many seconds.
DATE_SPAN = 1 << 32
END = "\r\n\r\n"


class LoserTree:
    """Merge sorted iterables: each inner node keeps the loser of its match, the winner goes up."""

    def __init__(self, runs: list[Iterable], key: Callable) -> None:
        self.runs = [iter(r) for r in runs]
        self.key = key
        self.k = len(self.runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._climb(run)

    def _beats(self, a: int, b: int) -> bool:
        """Run ``a`` comes before run ``b``; an ended run loses, equal keys go by run."""
        x, y = self.keys[a], self.keys[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _climb(self, run: int) -> None:
        node, winner = (run + self.k) // 2, run
        while node:
            held = self.losers[node]
            if held < 0:
                self.losers[node] = winner
                return
            if self._beats(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator:
        while self.k and self.heads[self.winner] is not None:
            run = self.winner
            yield self.heads[run]
            self.heads[run] = head = next(self.runs[run], None)
            self.keys[run] = None if head is None else self.key(head)
            self._climb(run)


def url_key(url: str) -> str:
    """Host labels in reverse order, then the path and query in lower case; scheme, ``www.``, port and fragment go."""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:].lower()
    host = host.rpartition("@")[2].partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (path or "/")


def classify(pages: DataFrame, threshold: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, n_bytes, digest, keep: of equal payloads of ``threshold`` bytes, ``keep`` is the largest page_id."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("n_bytes", F.octet_length("html").cast("long")).withColumn("digest", F.sha1("html"))
    first = rows.filter(F.col("n_bytes") >= threshold).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("keep"), F.count("*").alias("c")).filter("c > 1").drop("c")
    return rows.join(first, (F.col("digest") == F.col("d")) & (F.col("n_bytes") >= threshold), "left").drop("d")


def write_warc(pages: DataFrame, path: str, threshold: int = REVISIT_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into archive files below ``path``.

    The payload is the html in UTF-8, a null as no bytes.  Of equal payloads of
    at least ``threshold`` bytes the largest page_id is a response and the
    others are revisits of it without a payload; rows that repeat that page_id
    too are responses each.  A null url is stored as ``about:blank``, control
    characters and spaces in a url as ``%20``.  Captures are dated by page_id
    modulo ``DATE_SPAN``, in seconds since 2000-01-01, a null page_id as 0; the
    id itself is in the record id.  Files are compressed; offsets are those of
    their content.
    """
    rows = classify(pages, threshold)
    revisit = F.col("keep").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("keep"), F.lit(False))
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(DATE_SPAN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), name,
        F.lit(">\r\nWARC-Target-URI: "), F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\x00-\x20\x7f]", "%20"),
        F.lit("\r\nWARC-Date: "), date,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("keep").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, block).alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", file_records).option("compression", "gzip").text(path)


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[int, int, dict[str, str], bytes, int]]:
    """Records of an archive that comes in pieces: offset, length, headers, payload, declared payload length.

    Not more than a record and a piece are held.
    """
    source, held, at = iter(pieces), bytearray(), 0

    def more() -> None:
        piece = next(source, None)
        if piece is None:
            raise ValueError(f"the record at byte {at} has no end")
        held.extend(piece)

    def head(start: int) -> int:
        """End of the lines that begin at ``start`` of what is held."""
        while (cut := held.find(b"\r\n\r\n", start)) < 0:
            more()
        return cut

    while True:
        if not held:
            piece = next(source, None)
            if piece is None:
                return
            held.extend(piece)
            continue
        cut = head(0)
        lines = held[:cut].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start = cut + 4
        end = start + int(headers["content-length"])
        while len(held) < end + 4:
            more()
        body = head(start) + 4
        declared = int(bytes(held[start:body]).lower().partition(b"content-length: ")[2].partition(b"\r\n")[0])
        if body > end or held[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} has no end")
        yield at, end, headers, bytes(held[body:end]), declared
        at += end + 4
        del held[: end + 4]


_CDX = "url_key string, captured_at long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, offset long, length long"
_NAMES = [x.split()[0] for x in _CDX.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in _CDX.split(", ")]


def _order(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def _captures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of each archive file as a sorted run; rows are the file and its pieces, in order."""

    def page(text: str) -> int | None:
        return None if text.endswith(":none>") else int(text.rpartition(":")[2][:-1])

    def run(name: str, pieces: Iterable[bytes]) -> Iterator[pa.RecordBatch]:
        rows = []
        for offset, length, headers, payload, declared in parse_warc(pieces):
            digest = headers["warc-payload-digest"].removeprefix("sha1:")
            kind = headers["warc-type"]
            if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != declared):
                raise ValueError(f"payload of the record at byte {offset} of {name} is damaged")
            when = int(datetime.strptime(headers["warc-date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
            refers = page(headers["warc-refers-to"]) if kind == "revisit" else None
            rows.append((url_key(headers["warc-target-uri"]), when, page(headers["warc-record-id"]), declared, digest, kind, refers, name, offset, length))
        rows.sort(key=_order)
        for at in range(0, len(rows), 10_000):
            yield _batch(rows[at : at + 10_000])

    pieces = ((name, value + b"\r\n\r\n") for batch in batches for name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    for name, of_file in groupby(pieces, lambda piece: piece[0]):
        yield from run(name, (value for _, value in of_file))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of the archive files below ``path``; those of a file are in order.

    Files are streamed, cut where the writer's separator stands; a compressed file is not split.
    """
    lines = spark.read.format("text").option("lineSep", END).option("pathGlobFilter", "*.txt.gz").load(path)
    return lines.select(F.col("_metadata.file_name").alias("run"), F.col("value").cast("binary").alias("value")).mapInArrow(_captures, _CDX)


def _merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(row[7], []).append(row)
    out = []
    for row in LoserTree(list(runs.values()), _order):
        out.append(row)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in global order of URL key, timestamp and page_id.

    Ranges are of whole keys with timestamp, page and place, so the captures of
    one busy URL spread over as many tasks as they need; a task has about
    ``MERGE_ROWS``.
    """
    tasks = max(1, math.ceil(runs.count() / MERGE_ROWS))  # from the footers of the checkpoint
    tasks = max(tasks, min(runs.rdd.getNumPartitions(), runs.sparkSession.sparkContext.defaultParallelism))
    ordered = runs.repartitionByRange(tasks, "url_key", "captured_at", "page_id", "run", "offset")
    return ordered.sortWithinPartitions("run", "url_key", "captured_at", F.coalesce("page_id", F.lit(-1)), "offset").mapInArrow(_merge, _CDX)


def capture_histories(pages: DataFrame, path: str | None = None, threshold: int = REVISIT_BYTES) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and return their merged index.

    One row for each page row, ordered by URL key and timestamp: page_id,
    payload_bytes and payload_digest (of the full payload), record_type,
    refers_to, url_key, captured_at, and run, offset and length of the record.
    The archives stay below ``path``; without one they go to the shared folder
    and are deleted when they have been read.  Other columns are not read.  No rows give no rows.
    """
    spark = pages.sparkSession
    at = path or shared_path(spark, "warc")
    write_warc(pages, at, threshold)
    runs = checkpoint(read_runs(spark, at), "runs")
    if path is None:
        drop_written(spark, at)
    return merge_runs(runs)

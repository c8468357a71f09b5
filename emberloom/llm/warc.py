"""WARC archives with a merged external index.

Writing: one record for each capture. Of equal payloads the capture with the largest ``page_id`` is a response
and the others are revisits that name it. Which payloads repeat is found from digests alone, pre-aggregated; a
table of the repeated ones (usually small) then meets the captures, by broadcast only while Spark's own size
threshold allows it and otherwise by a join that splits hot keys. Spark's text writer puts the records into
files on any file system: its line separator is the blank line that ends a WARC record. An archive is bounded by
bytes: ordinary captures (up to ``LARGE`` bytes) go ``RECORDS_PER_FILE`` to a file, and larger ones as many to a file
as the largest of them allows within ``FILE_BYTES``.

Reading: an archive is parsed by the lengths in its headers. The captures of one archive, sorted by URL key and
time, are a run. Runs are written, dealt out by ranges of (URL key, time, id), so that a URL with very many
captures is spread by time, and within each range a loser tree merges the runs' sorted parts; a task holds its range
as Arrow batches and makes Python rows of a few captures of each run at a time. The ranges in order are the capture
histories of the whole crawl.

Defined cases: a null html is an empty payload; empty payloads repeat each other like any; a null url has an
empty key; rows with a null ``page_id`` are responses unless an equal payload has an id; rows repeated with the
same id and payload are all responses (or revisits of the same capture); other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberloom.llm import scratch

RECORDS_PER_FILE = 1_000
LARGE = 1 << 20
FILE_BYTES = 1 << 27
#: Rows that the merge makes of a run at a time.
HEAD_ROWS = 256
NAME = "urn:capture:page:"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_of_hex(hexed: Column) -> Column:
    """Base32 of 40 hexadecimal digits: 40 bits at a time are 8 characters."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def records(pages: DataFrame) -> DataFrame:
    """``record``: the text of each capture's WARC record, without the blank lines after it."""
    own = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    own = own.withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    repeated = own.groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    repeated = scratch.stash(repeated, "repeated")
    joined = own.join(repeated, "sha", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    crlf = "\r\n"
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    minutes = F.coalesce("page_id", F.lit(0)).cast("long")  # the table has no times: a minute from the one before it
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(minutes / 1440).cast("int")).cast("string")
    clock = [F.lpad(x.cast("string"), 2, "0") for x in (F.floor(F.pmod(minutes, F.lit(1440)) / 60), F.pmod(minutes, F.lit(60)))]
    at = F.concat(day, F.lit("T"), clock[0], F.lit(":"), clock[1], F.lit(":00Z"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{crlf}Content-Type: text/html; charset=utf-8{crlf}Content-Length: "), F.octet_length("payload").cast("string"), F.lit(crlf * 2))
    block = F.when(again, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{crlf}WARC-Type: "), F.when(again, "revisit").otherwise("response"),
        F.lit(f"{crlf}WARC-Record-ID: <{NAME}"), name,
        F.lit(f">{crlf}WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""),
        F.lit(f"{crlf}WARC-Date: "), at,
        F.lit(f"{crlf}WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha")),
        F.when(again, F.concat(F.lit(f"{crlf}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{crlf}WARC-Refers-To: <{NAME}"), F.col("first").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{crlf}Content-Type: application/http; msgtype=response{crlf}Content-Length: "), F.octet_length("block").cast("string"),
        F.lit(crlf * 2),
    )
    return joined.withColumn("block", block).select(F.concat(head, F.col("block")).alias("record"))


def write_archives(pages: DataFrame, path: str) -> None:
    """Write the records of all captures under ``path``; no file holds more than about ``FILE_BYTES`` bytes."""
    made, size = records(pages), F.octet_length("record")
    held = F.octet_length(F.coalesce("html", F.lit(""))) + F.octet_length(F.coalesce("url", F.lit("")))
    most = pages.select(held.alias("n")).where(F.col("n") > LARGE).agg(F.max("n")).first()[0]

    def write(rows: DataFrame, per_file: int) -> None:
        rows.write.mode("append").option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)

    if most is None:
        write(made, RECORDS_PER_FILE)
    else:  # a record is its URL and payload and some hundred bytes
        write(made.where(size <= LARGE + 65_536), RECORDS_PER_FILE)
        write(made.where(size > LARGE + 65_536), max(1, FILE_BYTES // (most + 65_536)))


def url_key(url: str) -> str:
    """The host's labels reversed, then the path, in lower case: captures of a site sort together."""
    m = re.match(r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^#]*)", url)
    if not m:
        return url.lower()
    host = re.sub(r":\d*$", "", m[1].lower()).rstrip(".")
    host = host[4:] if host.startswith("www.") else host
    return ",".join(reversed(host.split("."))) + ")" + (m[2].lower() or "/")


def parse_archive(data: bytes):
    """(headers, block, offset, length) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        start, size = end + 4, int(headers["Content-Length"])
        yield headers, data[start : start + size], at, start + size - at
        at = start + size + 4


def _page(name: str) -> int | None:
    value = name.strip("<>").removeprefix(NAME)
    return None if value == "none" else int(value)


def capture(headers: dict, block: bytes) -> tuple:
    """(urlkey, timestamp, page_id, payload_bytes, payload_digest, record_type, refers_to) of one record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    told, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
    size = int(re.search(rb"(?i)content-length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != told):
        raise ValueError(f"{headers['WARC-Record-ID']}: the payload is not as its headers say")
    refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
    return url_key(headers["WARC-Target-URI"]), re.sub(r"\D", "", headers["WARC-Date"]), _page(headers["WARC-Record-ID"]), size, told, kind, refers


_INDEX = "run string, urlkey string, timestamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, length long"
_TYPES = [pa.int64() if c.endswith("long") else pa.string() for c in _INDEX.split(", ")]
_NAMES = [c.split()[0] for c in _INDEX.split(", ")]


def _batch(rows: list[tuple], types: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def sort_key(row: tuple) -> tuple:
    """URL key, time, id (null first) and place: the order of capture histories."""
    return row[1], row[2], row[3] is not None, row[3] or 0, row[0], row[8]


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """The captures of all archives under ``path``; those of one archive are a sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")

    def run(batches):
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(file, *capture(h, block), at, n) for h, block, at, n in parse_archive(data.as_py())]
                for r in range(0, len(rows := sorted(rows, key=sort_key)), 10_000):
                    yield _batch(rows[r : r + 10_000], _TYPES, _NAMES)

    return files.select("path", "content").mapInArrow(run, _INDEX)


class LoserTree:
    """Merges sorted runs. Each inner node holds the loser of its match; the winner is replayed from its leaf."""

    def __init__(self, runs: list, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.size = len(runs)
        self.heads = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._beats(a, b) else (b, a)
        self.winner = winners[1] if self.size > 1 else 0

    def _beats(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        return ka is not None and (kb is None or (ka, a) < (kb, b))

    def __iter__(self):
        while self.size and self.heads[self.winner] is not None:
            w = self.winner
            yield self.heads[w]
            self.heads[w] = head = next(self.runs[w], None)
            self.keys[w] = None if head is None else self.key(head)
            node = (w + self.size) // 2
            while node:
                if self._beats(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merge(runs: DataFrame) -> DataFrame:
    """All captures in order: by ``part``, then ``place`` in it. A range holds a part of every run, and fits in a
    task as any shuffle partition does."""

    def rows_of(pieces: list[pa.RecordBatch]):
        for piece in pieces:
            for at in range(0, len(piece), HEAD_ROWS):
                yield from zip(*(c.to_pylist() for c in piece.slice(at, HEAD_ROWS).columns), strict=True)

    def run(batches):
        part, found = TaskContext.get().partitionId(), {}
        for batch in batches:
            at = 0
            for name, n in zip(*_stretches(batch.column(0)), strict=True):
                found.setdefault(name, []).append(batch.slice(at, n))
                at += n
        out = []
        for place, row in enumerate(LoserTree([rows_of(x) for x in found.values()], sort_key)):
            out.append((*row, part, place))
            if len(out) == 10_000:
                yield _batch(out, [*_TYPES, pa.int64(), pa.int64()], [*_NAMES, "part", "place"])
                out = []
        if out:
            yield _batch(out, [*_TYPES, pa.int64(), pa.int64()], [*_NAMES, "part", "place"])

    order = ["urlkey", "timestamp", "page_id"]
    dealt = runs.repartitionByRange(*order).sortWithinPartitions("run", *order, "offset")
    return dealt.mapInArrow(run, _INDEX + ", part long, place long")


def _stretches(names: pa.Array) -> tuple[list[str], list[int]]:
    """The values of a sorted column and how many rows each has."""
    counts = names.value_counts()
    return counts.field(0).to_pylist(), counts.field(1).to_pylist()


def histories(pages: DataFrame) -> DataFrame:
    """Write the archives of all captures, read them back, and merge their index."""
    spark = pages.sparkSession
    path = scratch.new_path(spark, "archives")
    write_archives(pages, path)
    return merge(scratch.stash(index_runs(spark, path), "runs"))


#: The query's rows by the definition.
HISTORIES_SQL = """
with page as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as h from pages),
whole as (
  select *, list_transform([0, 1, 2, 3], lambda g: cast('0x' || substr(h, g * 10 + 1, 10) as bigint)) as v,
    max(page_id) over (partition by h) as newest from page)
select page_id, cast(strlen(payload) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((v[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31) + 1 as bigint), 1)), '') as payload_digest,
  case when newest = page_id then 'response' else 'revisit' end as record_type,
  case when newest <> page_id then newest end as refers_to
from whole
"""

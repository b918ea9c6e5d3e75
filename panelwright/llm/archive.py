"""Legacy web archives: ARC files read by their own version's header lines and rewritten as WARC.

An ARC file names its version and field list in a ``filedesc`` record; every
record is one header line and a body of the declared length.  Conversion
gives each record what WARC asks for beyond that: a record id, an ISO date, a
record type and digests.  Payloads seen before become revisit records.

Files are written with the text writer: a record is one value and the record
separator is the line separator, gzip over the file.  They are read whole with
the binary reader; ``RECORDS_PER_FILE`` bounds them.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import sent_by_value, written
from panelwright.session import scratch_path

sent_by_value(__name__)

RECORDS_PER_FILE = 2_000
MIN_REVISIT_BYTES = 100
# Fixed values of the two ARC versions: field names of a header line.
FIELDS = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FIRST_DATE = datetime(2001, 1, 1, tzinfo=timezone.utc)


def _filedesc(version: int, name: str) -> bytes:
    block = b"%d 0 %s\n%s\n" % (version, b"panelwright", FIELDS[version])
    head = f"filedesc://{name} 0.0.0.0 20010101000000 text/plain ".encode()
    if version == 2:
        head += f"200 - - 0 {name} ".encode()
    return head + b"%d\n" % len(block) + block


def _arc_record(version: int, name: str, page_id: int | None, url: str | None, html: str | None) -> bytes:
    body = (html or "").encode("utf-8", "surrogatepass")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"Content-Length: {len(body)}\r\n"
    if page_id is not None:
        http += f"X-Page-Id: {page_id}\r\n"
    body = http.encode() + b"\r\n" + body
    date = (_FIRST_DATE + timedelta(seconds=(page_id or 0) % (20 * 365 * 86_400))).strftime("%Y%m%d%H%M%S")
    # A header line is split at spaces.
    where = re.sub(r"\s", "%20", url or "") or "urn:none"
    head = f"{where} 0.0.0.0 {date} text/html "
    if version == 2:
        head += f"200 - - 0 {name} "
    return head.encode("utf-8", "surrogatepass") + b"%d\n" % len(body) + body


def write_arc(pages: DataFrame) -> str:
    """Write pages as gzip ARC files, version 1 and 2 by turns of the task; returns the folder."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        version, n = 1 + task % 2, 0
        for batch in batches:
            out = []
            for page_id, url, html in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = f"pages-{task:06d}-{n // RECORDS_PER_FILE:04d}.arc"
                if n % RECORDS_PER_FILE == 0:
                    # The writer starts a file at just these rows.
                    out.append(_filedesc(version, name))
                    n += 1
                out.append(_arc_record(version, name, page_id, url, html))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    path = scratch_path(pages.sparkSession, "arc")
    narrow = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write_records(narrow.mapInArrow(records, "value binary"), path, "\n")
    return path


def _write_records(values: DataFrame, path: str, separator: str) -> None:
    """Bytes go through as they are: a binary value cast to string is not decoded."""
    text = values.select(F.col("value").cast("string").alias("value"))
    text.write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC file, the ``filedesc`` ones left out.

    Fields are taken by the list of the ``filedesc`` record in force; without
    one by the number of fields.  A line that is no header, or declares more
    than there is, is skipped, and reading goes on at the next line.
    """
    fields, at = None, 0
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            return
        parts = data[at:end].rstrip(b"\r").split(b" ")
        names = fields if fields and len(fields) == len(parts) else next((f.split() for f in FIELDS.values() if f.count(b" ") + 1 == len(parts)), None)
        size = int(parts[-1]) if names and parts[-1].isdigit() else -1
        if size < 0 or end + 1 + size > len(data):
            at = end + 1
            continue
        body, at = data[end + 1 : end + 1 + size], end + 1 + size
        if data[at : at + 1] == b"\n":
            at += 1
        if parts[0].startswith(b"filedesc://"):
            listed = body.split(b"\n")
            fields = listed[1].split() if len(listed) > 1 else None
            continue
        record = dict(zip(names, parts, strict=True))
        http, gap, payload = body.partition(b"\r\n\r\n") if body.startswith(b"HTTP/") else (b"", b"", body)
        yield {
            "url": record[b"URL"].decode("utf-8", "replace"),
            "ip": record[b"IP-address"].decode("ascii", "replace"),
            "date": _iso(record[b"Archive-date"].decode("ascii", "replace")),
            "http": http + gap,
            "payload": payload,
            "page_id": _page_id(http),
            "digest": hashlib.sha256(payload).hexdigest(),
        }


def _iso(date: str) -> str:
    """Digits of an archive date, 14 of them or fewer, as an ISO time; unreadable dates are the epoch."""
    full = (date + "00000101000000"[len(date) :])[:14] if len(date) >= 4 else ""
    try:
        return datetime.strptime(full, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def _page_id(http: bytes) -> int | None:
    found = re.search(rb"(?im)^X-Page-Id: (-?\d+)\r?$", http)
    return int(found[1]) if found else None


_ARC_ROW = "url string, ip string, date string, http binary, payload binary, page_id long, digest string"


def read_arc(spark, path: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found: list[dict] = []
                for record in parse_arc(gzip.decompress(content.as_py())):
                    found.append(record)
                    if len(found) == 256:
                        yield _arc_batch(found)
                        found = []
                if found:
                    yield _arc_batch(found)

    return _files(spark, path).mapInArrow(rows, _ARC_ROW)


def _arc_batch(found: list[dict]) -> pa.RecordBatch:
    kinds = {"http": pa.binary(), "payload": pa.binary(), "page_id": pa.int64()}
    names = ["url", "ip", "date", "http", "payload", "page_id", "digest"]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], kinds.get(n, pa.string())) for n in names], names=names)


def _record_id(page_id: int | None, url: str, date: str) -> str:
    """The same record has the same id whenever it is converted."""
    name = f"page:{page_id}" if page_id is not None else f"record:{date}:{url}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>"


def _warc_record(url: str, ip: str, date: str, http: bytes, payload: bytes, page_id: int | None, digest: str, first: int | None) -> bytes:
    revisit = first is not None and first != page_id
    block = http if revisit else http + payload
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, url, date)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-IP-Address: {ip}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, '', '')}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block


def convert(spark, arc_path: str) -> str:
    """Rewrite ARC files as WARC files; returns the folder.

    Which record holds a payload is settled on digests alone: only payloads
    that occur twice or more are joined back, by digest.
    """
    records = read_arc(spark, arc_path)
    sizes = written(records.select("digest", "page_id", F.length("payload").alias("n")), "arc-digests")
    again = sizes.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    again = written(again.where(F.col("n") > 1).select("digest", "first"), "arc-repeated")
    joined = records.join(again, "digest", "left").select("url", "ip", "date", "http", "payload", "page_id", "digest", "first")

    def warcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_warc_record(*row) for row in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    path = scratch_path(spark, "warc")
    _write_records(joined.mapInArrow(warcs, "value binary"), path, "\r\n\r\n")
    return path


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """``(headers, block)`` of each record, by the declared lengths; header names in lower case."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start = end + 4
        at = start + int(head["content-length"])
        yield head, data[start:at]
        at += 4


def read_warc(spark, path: str) -> DataFrame:
    """One row per response and revisit: ids, type, size and digest of the full payload; a response's digest is computed anew."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_id", "record_type", "refers", "payload_bytes", "payload_digest", "digest_ok"]
        for batch in batches:
            for content in batch.column(0):
                out = []
                for head, block in parse_warc(gzip.decompress(content.as_py())):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    kind, stated = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    length = re.search(rb"(?im)^Content-Length: (\d+)\r?$", http)
                    own = hashlib.sha256(payload).hexdigest() if kind == "response" else stated
                    size = len(payload) if kind == "response" else int(length[1])
                    out.append((_page_id(http), head["warc-record-id"], kind, head.get("warc-refers-to"), size, own, own == stated))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
                columns = list(zip(*out, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return _files(spark, path).mapInArrow(
        rows, "page_id long, record_id string, record_type string, refers string, payload_bytes long, payload_digest string, digest_ok boolean"
    )


def result(pages: DataFrame) -> DataFrame:
    """Pages written as ARC, converted to WARC and read back.

    A null html is an empty payload, a null url the name ``urn:none``.  A null
    page id takes part as a revisit of a record that has one; rows that repeat
    the smallest id of their payload are all responses.
    """
    spark = pages.sparkSession
    back = written(read_warc(spark, convert(spark, write_arc(pages))), "warc-rows")
    first = back.where((F.col("record_type") == "response") & F.col("page_id").isNotNull())
    first = first.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d")).distinct()
    revisits = back.where(F.col("record_type") == "revisit").select("refers").distinct()
    targets = written(first.join(revisits, "refers", "left_semi").select("refers", "refers_to").distinct(), "warc-targets")
    return back.join(targets, "refers", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, count(*) OVER (PARTITION BY payload_digest) AS n FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND n > 1 AND page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {MIN_REVISIT_BYTES} AND n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to, true AS digest_ok
FROM f
"""

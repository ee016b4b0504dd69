"""Legacy ARC archives to WARC.

ARC files (versions 1 and 2) are parsed record by record from their header lines
and declared lengths; WARC records get synthesised identifiers, timestamps, types
and digests. Heads and payloads are bytes throughout, whatever their encoding. Files
are written by Spark's text writer, one row a file of bounded size (bytes cast to a
string, which it writes as they are), and read whole by Spark's binary reader, so any
store that Spark reaches will do. A file is decompressed as a stream; one record is
in memory at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partition_id, slices, table

#: The header fields of the two ARC versions.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER = "X-Page-Id"
#: A file ends with the record that brings it to so many bytes; one record is never cut.
FILE_BYTES = 16 << 20
#: Field of a revisit record (an extension, which readers may ignore): the size of the payload that it leaves out.
PAYLOAD_BYTES = "X-Payload-Bytes"


def _clean(url: str | None, key: object) -> str:
    """A URL fit for a header line: white space and controls are escaped; none is named by its key."""
    return re.sub(r"[\s\x00-\x1f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{key}"


def arc_version_block(version: int, date: str, name: str) -> str:
    body = f"{version} 0 skarn\n{ARC_TITLES[version]}\n"
    extra = " 200 - - 0 " + name if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{extra} {len(body.encode())}\n{body}"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, offset: int, name: str) -> bytes:
    extra = f" 200 - - {offset} {name}" if version == 2 else ""
    return f"{url} {ip} {date} {mime}{extra} {len(body)}\n".encode("utf-8", "surrogatepass") + body


def read_arc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record after the version block.

    The version is what the version block's first line says; a field line is split
    from its right end, so a URL with blanks stays whole. A record that is shorter
    than declared, or a line that doesn't fit the version, is an error.
    """
    version = 1
    first = True
    while line := stream.readline():
        if not line.strip():
            continue
        text = re.sub("[\udc80-\udcff]", lambda m: f"%{ord(m[0]) - 0xDC00:02X}", line.decode("utf-8", "surrogateescape")).rstrip("\r\n")  # bytes that aren't UTF-8 are escaped
        if first:
            version = 2 if len(text.split(" ")) >= len(ARC_FIELDS[2]) else 1
        names = ARC_FIELDS[version]
        parts = text.rsplit(" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"not an ARC version {version} header: {text[:200]!r}")
        fields = dict(zip(names, parts, strict=True))
        n = int(fields["length"])
        body = stream.read(n)
        if len(body) != n:
            raise ValueError(f"record of {fields['url'][:200]} ends early")
        if first and fields["url"].startswith("filedesc:"):
            declared = body.split(b" ", 1)[0].strip()
            version = int(declared) if declared in (b"1", b"2") else version
        else:
            yield fields | {"version": str(version)}, body
        first = False


def split_http(body: bytes) -> tuple[str, bytes]:
    """The HTTP head (empty if there is none), as Latin-1, which keeps its bytes, and the payload."""
    if body[:5] != b"HTTP/":
        return "", body
    m = re.search(rb"\r?\n\r?\n", body)
    return (body[: m.end()].decode("latin-1"), body[m.end() :]) if m else (body.decode("latin-1"), b"")


def http_field(head: str, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)[ \t]*\r?$", head)
    return m[1] if m else None


def warc_id(*parts: object) -> str:
    """An identifier that follows from what it names, so a task that runs again writes the same."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def warc_date(arc: str) -> str:
    """14 digits, or their first few, to ISO 8601; what isn't a date becomes the epoch."""
    d = re.sub(r"\D", "", arc)[:14]
    if len(d) < 4:
        d = "1970"
    d += "00000101000000"[len(d) :] if len(d) < 8 else "0" * (14 - len(d))
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def b32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """Without the two line ends after the block, which the writer adds."""
    fields = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", "sha1:" + b32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass") + block


def read_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name with the version under "", block) of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:80]!r}")
        fields = {"": line.strip().decode()}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError(f"record {fields.get('warc-record-id')} ends early")
        yield fields, block


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("path", "content")


def _stream(content: bytes) -> BinaryIO:
    raw = io.BytesIO(content)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw


def _write(df: DataFrame, path: str, end: str) -> None:
    """A file a row."""
    df.write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("lineSep", end).text(path)


class Roll:
    """Joins records to files of bounded size, each with a head of its own."""

    def __init__(self, head: Callable[[str], bytes], kind: str, end: bytes, most: int) -> None:
        self.head, self.kind, self.end, self.most, self.count = head, kind, end, most, 0
        self.start()

    def start(self) -> None:
        self.name = f"part-{partition_id():05d}-{self.count:05d}.{self.kind}"
        self.records = [self.head(self.name)]
        self.size = len(self.records[0]) + len(self.end)

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        self.records.append(record)
        self.size += len(record) + len(self.end)
        if self.size >= self.most:
            yield self.file()

    def file(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([self.end.join(self.records)], pa.binary())], names=["value"])  # the writer adds the last end
        self.count += 1
        self.start()
        return out

    def rest(self) -> Iterator[pa.RecordBatch]:
        if len(self.records) > 1:
            yield self.file()


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000") -> None:
    """Legacy archives, of versions 1 and 2 by turns, with a row of ``pages`` (page_id, url, html) a record. Without rows there are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = 1 + partition_id() % 2
        roll = Roll(lambda name: arc_version_block(version, date, name).encode(), "arc", b"\n", FILE_BYTES)
        for batch in slices(batches, 256):
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                body = (html or "").encode("utf-8", "surrogatepass")
                own = "" if key is None else f"{PAGE_HEADER}: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n"
                yield from roll.add(arc_record(version, _clean(url, key), "0.0.0.0", date, "text/html", head.encode() + body, roll.size, roll.name))
        yield from roll.rest()

    _write(pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "value binary").select(F.col("value").cast("string")), path, "\n")


ARC_ROWS = "page_id long, place string, url string, date string, mime string, head string, payload binary, size long, sha1 string"


def arc_rows(files: DataFrame, with_payload: bool) -> DataFrame:
    """The records of ARC files (path, content): page_id, place (its file and number there), url, date, mime, HTTP head, payload, its size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string()]
            names = [x.split()[0] for x in ARC_ROWS.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in slices(batches, 1):
            rows, size = [], 0
            file = batch.column(0)[0].as_py().rsplit("/", 1)[-1]
            for number, (fields, body) in enumerate(read_arc(_stream(batch.column(1)[0].as_py()))):
                head, payload = split_http(body)
                key = http_field(head, PAGE_HEADER)
                digest = hashlib.sha1(payload).hexdigest()
                rows.append((None if key is None else int(key), f"{file}:{number}", fields["url"], fields["date"], fields["mime"], head, payload if with_payload else None, len(payload), digest))
                size += len(payload) * with_payload
                if len(rows) >= 1024 or size > 8 << 20:
                    yield out()
                    rows, size = [], 0
            if rows:
                yield out()

    return files.mapInArrow(run, ARC_ROWS)


def convert(arcs: DataFrame, path: str, min_bytes: int = 1000) -> None:
    """Writes the records of ARC files as WARC: of equal payloads of at least ``min_bytes`` bytes the largest page_id is the response.

    Only digests and sizes are grouped; payloads meet their digest's decision in one
    join, which is split where a digest is frequent. Records without an id are responses.
    """
    keeper = (
        arc_rows(arcs, False).where(F.col("size") >= min_bytes).groupBy("sha1", "size")
        .agg(F.max("page_id").alias("keeper"), F.max_by("url", "page_id").alias("keeper_url"), F.max_by("date", "page_id").alias("keeper_date"), F.count("*").alias("copies"))
        .where("copies > 1").drop("copies")
    )
    rows = arc_rows(arcs, True).join(keeper, ["sha1", "size"], "left")
    rows = rows.select("page_id", "place", "url", "date", "mime", "head", "payload", "size", "sha1", "keeper", "keeper_url", "keeper_date")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        info = b"software: skarn\r\nformat: WARC File Format 1.1\r\n"
        head = lambda name: warc_record("warcinfo", [("WARC-Record-ID", warc_id(name)), ("WARC-Date", warc_date("")), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], info)
        roll = Roll(head, "warc", b"\r\n\r\n", FILE_BYTES)
        for batch in slices(batches, 256):
            for key, place, url, date, mime, http, payload, size, sha1, keeper, k_url, k_date in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = warc_id(url, date, place) if key is None else warc_id(url, date, key)
                fields = [("WARC-Record-ID", own), ("WARC-Date", warc_date(date)), ("WARC-Target-URI", url), ("WARC-Payload-Digest", "sha1:" + b32(sha1))]
                fields.append(("Content-Type", "application/http; msgtype=response" if http else mime))
                if key is None or keeper is None or key == keeper:
                    yield from roll.add(warc_record("response" if http else "resource", fields, http.encode("latin-1") + payload))
                else:
                    fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", warc_id(k_url, k_date, keeper)), ("WARC-Refers-To-Target-URI", k_url), ("WARC-Refers-To-Date", warc_date(k_date)), (PAYLOAD_BYTES, str(size))]
                    yield from roll.add(warc_record("revisit", fields, http.encode("latin-1")))
        yield from roll.rest()

    _write(rows.mapInArrow(run, "value binary").select(F.col("value").cast("string")), path, "\r\n\r\n")


def warc_rows(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, record_id, refers_to_id of the response, resource and revisit records.

    A payload that is present must have the digest its record declares; a revisit's
    size is what its record says, else what its HTTP head does, else unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = []
            for fields, block in read_warc(_stream(batch.column(1)[0].as_py())):
                kind = fields["warc-type"]
                if kind not in ("response", "resource", "revisit"):
                    continue
                head, payload = split_http(block)
                key = http_field(head, PAGE_HEADER)
                digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"record {fields['warc-record-id']} has another payload than declared")
                said = fields.get(PAYLOAD_BYTES.lower()) or http_field(head, "Content-Length") or ""
                size = len(payload) if kind != "revisit" else int(said) if said.isdigit() else None
                rows.append((None if key is None else int(key), size, digest, kind, fields["warc-record-id"], fields.get("warc-refers-to")))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, record_id string, refers_to_id string")


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as ARC, converted to WARC and read back.

    A null html is an empty payload, a null url is named after its page; a page
    without an id comes back without one, as a response. No pages give no rows.
    """
    scratch = Scratch(spark, "archive")
    write_arc(table(spark, sf_dir, "pages"), scratch.path("arc"))
    convert(_files(spark, scratch.path("arc")), scratch.path("warc"))
    rows = scratch.write(warc_rows(_files(spark, scratch.path("warc"))), "read")
    named = rows.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to")).distinct()
    out = rows.join(named, "refers_to_id", "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
     q AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d FROM p),
     r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d, n) ELSE page_id END AS k FROM q)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN k = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k = page_id THEN NULL ELSE k END AS refers_to
FROM r
"""

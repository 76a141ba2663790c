"""Legacy archive converter: ARC files become WARC files, which are read back by declared lengths.

An ARC file opens with a version block, which names its version and the fields of a record's header line; version
1 has five fields, version 2 ten. Records are found by the header line and the length it declares, never by what
the content looks like. For each a WARC record is made up: an identifier (a UUID from the record's own facts, so
reruns agree), a W3C timestamp from the 14 digits, a type from the scheme and content type, SHA-1 digests of block
and payload in base 32. Of equal payloads of at least ``least`` bytes the record with the largest key is kept as
response and the others become revisits of it, without payload.

WARC files are written by Spark's own text writer, a record a row with the blank lines between records as line
separator: the bytes go through Hadoop's file systems and its commit protocol, so any shared folder does and lost
executors leave nothing half written. Files hold at most ``per_file`` records and are read whole.

Equal payloads are found by digest and length, added up before they are shuffled; the table of those that occur
more than once is broadcast if it is proven small, else joined by digest (Spark splits the skewed side).

Edge cases: null html is an empty payload; a null url becomes ``urn:page:`` and its id, blanks in urls are escaped;
null ids stay null, and a null id is never the largest unless all are null, when nothing is a revisit; rows
that repeat the largest id are responses all; an empty table gives no rows; a file cut short or with a header that
can't be read is an error.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import cut, fits, scratch, table

FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
KEY = "X-Page-Id"
END = "\r\n\r\n"
RECORD = "key long, url string, ip string, date string, type string, digest string, n long, content binary"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    type: str
    content: bytes
    more: dict[str, str] = field(default_factory=dict)


def arc_volume(records: list[ArcRecord], version: int = 1, name: str = "volume.arc") -> bytes:
    """The bytes of an ARC file."""
    fields = FIELDS[version]
    block = f"{version} 0 frameloom\n{' '.join(fields)}\n".encode()
    head = ["filedesc://" + name, "0.0.0.0", "19960101000000", "text/plain"] + (["200", "-", "-", "0", name] if version == 2 else [])
    out = [" ".join([*head, str(len(block))]).encode() + b"\n" + block]
    at = len(out[0])
    for r in records:
        line = [r.url, r.ip, r.date, r.type]
        if version == 2:
            line += [r.more.get("Result-code", "200"), r.more.get("Checksum", "-"), r.more.get("Location", "-"), str(at), name]
        piece = b"\n" + " ".join([*line, str(len(r.content))]).encode() + b"\n" + r.content
        out.append(piece)
        at += len(piece)
    return b"".join(out) + b"\n"


def arc_records(data: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file of version 1 or 2, without the version block."""
    fields, at = FIELDS[1], 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "surrogateescape").rstrip("\r")
        parts = line.split(" ")
        first = line.startswith("filedesc:")
        names = fields if not first else FIELDS.get({5: 1, 10: 2}.get(len(parts), 0), fields)
        if end < 0 or len(parts) < len(names) or not parts[-1].isdigit():
            raise ValueError(f"no ARC header at byte {at}: {line[:120]!r}")
        extra = len(parts) - len(names)  # blanks within a url
        parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
        got = dict(zip(names, parts))
        length = int(got["Archive-length"])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            raise ValueError(f"ARC record at byte {at} declares {length} bytes and has {len(content)}")
        at = end + 1 + length
        if first:
            version, _, rest = content.partition(b"\n")
            named = rest.partition(b"\n")[0].decode().split()
            fields = named if named and named[-1] == "Archive-length" else FIELDS[int(version.split()[0])]
            continue
        yield ArcRecord(got["URL"], got.get("IP-address", "0.0.0.0"), got["Archive-date"], got.get("Content-type", "application/octet-stream"), content, {k: got[k] for k in names if k in ("Result-code", "Checksum", "Location")})


def http_parts(url: str, content: bytes) -> tuple[bytes, bytes]:
    """(HTTP header with its blank line, payload); no header for other schemes, but where the page's key in it says that we wrote it."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    fetched = url.lower().startswith(("http://", "https://", "urn:page:"))
    for gap in (b"\r\n\r\n", b"\n\n"):
        head, sep, body = content.partition(gap)
        if sep and (fetched or header_field(head, KEY) is not None):
            return head + sep, body
    return (content, b"") if fetched else (b"", content)


def header_field(head: bytes, name: str) -> str | None:
    m = re.search(rf"(?im)^{re.escape(name)}:[ \t]*(.*?)[ \t]*\r?$".encode(), head)
    return m[1].decode("utf-8", "replace") if m else None


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(url: str, date: str, digest: str, key: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{url}|{date}|{digest}|{key}'.encode('utf-8', 'surrogateescape')).digest()[:16], version=5)}>"


def iso_date(date: str) -> str:
    d = (date + "00000000000000")[:14] if date.isdigit() and len(date) >= 4 else "19700101000000"
    month, day = (x if x != "00" else "01" for x in (d[4:6], d[6:8]))
    return f"{d[:4]}-{month}-{day}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, content_type: str, head: bytes) -> tuple[str, str]:
    """WARC-Type and Content-Type of what was fetched."""
    if head:
        return "response", "application/http; msgtype=response"
    return "resource", "text/dns" if url.lower().startswith("dns:") else content_type or "application/octet-stream"


def warc_record(url: str, ip: str, date: str, content_type: str, content: bytes, digest: str, key: int | None, target: int | None = None, target_url: str | None = None, target_date: str | None = None) -> bytes:
    """A WARC record without the blank lines after it. target: key, url and date of the response that it revisits."""
    head, payload = http_parts(url, content)
    kind, mime = warc_type(url, content_type, head)
    payload_digest = "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()
    named = [("WARC-Type", kind if target is None else "revisit"), ("WARC-Record-ID", record_id(url, date, digest, key)), ("WARC-Date", iso_date(date)), ("WARC-Target-URI", url)]
    if ip != "0.0.0.0":
        named.append(("WARC-IP-Address", ip))
    block = content
    if target is not None:
        block = head
        named += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(target_url, target_date, digest, target)), ("WARC-Refers-To-Target-URI", target_url), ("WARC-Refers-To-Date", iso_date(target_date)), ("WARC-Refers-To-Key", str(target)), ("WARC-Payload-Length", str(len(payload)))]
    named += [("WARC-Payload-Digest", payload_digest), ("WARC-Block-Digest", sha1_32(block)), ("Content-Type", mime), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named) + "\r\n").encode("utf-8", "surrogateescape") + block


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(fields in lower case, block) of a WARC file's records."""
    at, view = 0, memoryview(data)
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for line in data[at:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]:
            k, _, v = line.partition(":")
            fields[k.strip().lower()] = v.strip()
        n = int(fields["content-length"])
        if len(data) < end + 4 + n + 4 or data[end + 4 + n : end + 8 + n] != b"\r\n\r\n":
            raise ValueError(f"WARC record at byte {at} isn't as long as declared")
        yield fields, view[end + 4 : end + 4 + n]
        at = end + 8 + n


def converted(volumes: Iterator[bytes], content: bool) -> Iterator[pa.RecordBatch]:
    """What is needed of each record of ARC volumes, a batch a volume."""
    for v in volumes:
        rows = []
        for r in arc_records(v):
            head, payload = http_parts(r.url, r.content)
            key = header_field(head, KEY)
            rows.append((int(key) if key else None, r.url, r.ip, r.date, r.type, hashlib.sha1(payload).hexdigest(), len(payload), r.content if content else None))
        columns = zip(*rows) if rows else [[]] * 8
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary()))], ["key", "url", "ip", "date", "type", "digest", "n", "content"])


def convert_arc(volumes: DataFrame, content: bool = True) -> DataFrame:
    """volumes(content binary), whole ARC files -> a row a record."""
    return volumes.mapInArrow(lambda bs: converted((x.as_py() for b in bs for x in b.column(0)), content), RECORD)


def pages_as_arc(batches: Iterator[pa.RecordBatch], version: int, date: str, most: int = 4 << 20) -> Iterator[bytes]:
    """ARC volumes of about most bytes of (page_id, url, html) rows, a fetched document a page."""
    held, total = [], 0
    for b in batches:
        for page, url, html in zip(*(c.to_pylist() for c in b.columns)):
            body = (html or "").encode("utf-8", "surrogatepass")
            key = f"{KEY}: {'' if page is None else page}\r\n"  # empty for a null id: it tells that the header is ours
            head = f"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(body)}\r\n\r\n".encode()
            name = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{c:02X}" for c in m[0].encode()), url) if url else f"urn:page:{page}"
            held.append(ArcRecord(name, "0.0.0.0", date, "text/html", head + body))
            total += len(body) + 300
            if total >= most:
                yield arc_volume(held, version)
                held, total = [], 0
    if held:
        yield arc_volume(held, version)


def write_warc(records: DataFrame, path: str, least: int = 1000, per_file: int = 5000, digests: DataFrame | None = None) -> None:
    """Writes the records (as of convert_arc) as WARC files of at most per_file records. digests: the same rows, if they come cheaper without content."""
    light = (records if digests is None else digests).where(F.col("n") >= least)
    again = cut(light.groupBy("digest", "n").agg(F.max(F.struct("key", "url", "date")).alias("first"), F.count("*").alias("c")).where("c > 1 and first.key is not null").select("digest", "n", "first"))
    again = F.broadcast(again) if fits(again, 400) else again
    records = records.join(again, ["digest", "n"], "left")
    target = F.when(F.col("key").isNull() | (F.col("key") != F.col("first.key")), F.col("first"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(*row) for row in zip(*(c.to_pylist() for c in b.columns))], pa.binary())], ["value"])

    rows = records.select("url", "ip", "date", "type", "content", "digest", "key", *[target[c].alias(f"target_{c}") for c in ("key", "url", "date")]).mapInArrow(made, "value binary")
    rows.select(F.col("value").cast("string")).write.mode("overwrite").option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row a record of the WARC files in path; digest and length are those of the payload read, for revisits as declared."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                out = []
                for f, block in warc_records(x.as_py()):
                    block = bytes(block)
                    url, kind = f.get("warc-target-uri", ""), f.get("warc-type", "")
                    head, body = http_parts(url, block)
                    key, to = header_field(head, KEY), f.get("warc-refers-to-key")
                    if kind == "revisit":
                        digest, n = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex(), int(f["warc-payload-length"])
                    else:
                        digest, n = hashlib.sha1(body).hexdigest(), len(body)
                        if "warc-payload-digest" in f and base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex() != digest:
                            raise ValueError(f"the payload of {f.get('warc-record-id')} isn't what its digest says")
                    out.append((f.get("warc-record-id"), kind, url, f.get("warc-date"), int(key) if key else None, n, digest, int(to) if to else None, body if payload and kind != "revisit" else None))
                if out:
                    types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["record_id", "record_type", "url", "date", "key", "payload_bytes", "payload_digest", "refers_to", "payload"])

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").cast("binary"))
    return files.mapInArrow(rows, "record_id string, record_type string, url string, date string, key long, payload_bytes long, payload_digest string, refers_to long, payload binary")


def archive_pages(pages: DataFrame, path: str, least: int = 1000, version: int = 2, date: str = "20010203040506") -> None:
    """pages(page_id, url, html) as ARC volumes, converted to WARC files in path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    # files are read whole, so they hold some 64 MB of pages before they are packed
    mean = rows.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 600)).first()[0] or 600
    records = [rows.mapInArrow(lambda bs, c=c: converted(pages_as_arc(bs, version, date), c), RECORD) for c in (True, False)]
    write_warc(records[0], path, least, int(max(1, min(5000, (64 << 20) // mean))), records[1])


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    archive_pages(table(spark, sf_dir, "pages"), path)
    back = read_warc(spark, path, payload=False)
    return back.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes < 1000 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM m
"""

QUERIES = {"op2_warc": op2_warc}
ORACLES = {"op2_warc": ORACLE}

"""WARC archives: a writer through Spark's own sink, and a splittable reader.

The writer makes one gzip member per record. Members are written by the text sink as raw bytes, so a lost task is
simply run again and only committed files count; the sink's line separator is an empty gzip member, which readers skip.

The reader deals byte ranges of the files over tasks. A task looks for the gzip magic in its range, takes a place for the
start of a member only if the header there decodes to a WARC record, and owns the records that start in its range, reading on
beyond it for the last one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.llm.common import col

MAGIC = b"\x1f\x8b\x08"
#: The separator of the sink: a gzip member without content.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
RANGE_BYTES = 16 << 20
READ_BYTES = 1 << 20
#: Times and types are fixed, so the same table gives the same bytes.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value) -> str:
    return "" if value is None else " ".join(str(value).split())


def record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(payload)).encode() + b"\r\n\r\n"
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{_one_line(page)}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http;msgtype=response",
        *([f"WARC-Refers-To: <urn:page:{_one_line(refers_to)}>", f"WARC-Profile: {REVISIT_PROFILE}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def revisits(pages: DataFrame, id_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """id, url-less digest rows: for every page the id of the response that holds its payload.

    Of equal payloads of at least ``min_bytes`` the largest id is the response; ids that are null never are one while another is there.
    """
    small = pages.select(col(id_col).alias("id"), F.sha1(F.coalesce(col(html_col), F.lit("")).cast("binary")).alias("digest"),
                         F.octet_length(F.coalesce(col(html_col), F.lit(""))).alias("bytes"))
    return small.filter(F.col("bytes") >= min_bytes).groupBy("digest", "bytes").agg(F.max("id").alias("holder"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> None:
    """Archives of all pages under ``path``; the payload is the html in UTF-8, a null one is empty.

    Where several pages have one payload of at least ``min_bytes``, the page with the largest id is a response and the others
    revisit it; rows that share that largest id are all responses. Extra columns are not read, an empty table writes no record.
    """
    # the few digests that occur more than once; joined to the pages by digest, a hot one is split by adaptive execution
    held = revisits(pages, id_col, html_col, min_bytes)
    html = F.coalesce(col(html_col), F.lit(""))
    rows = pages.select(col(id_col).alias("id"), col(url_col).alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).alias("bytes"))
    rows = rows.join(held.select("digest", "bytes", "holder"), ["digest", "bytes"], "left").select(
        "id", "url", "html", "holder", (F.col("holder").isNotNull() & ~F.col("id").eqNullSafe(F.col("holder"))).alias("revisit"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, urls, holders, flags = (b.column(k).to_pylist() for k in (0, 1, 3, 4))
            out = [gzip.compress(record(i, u, h.as_py(), r, f), 4, mtime=0) for i, u, h, r, f in zip(ids, urls, b.column(2).cast(pa.binary()), holders, flags)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["member"])

    raw = rows.mapInArrow(members, "member binary").select(F.col("member").cast("string").alias("value"))
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).text(path)


def byte_ranges(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, size, start) of every range of every file under a folder, about one for each task; contents are not read here."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")))
    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return ranges.repartition(max(1, ranges.count()), "path", "start")


class Member:
    """One gzip member being decoded from a file."""

    def __init__(self, file, at: int):
        self.file, self.at, self.inflate, self.open = file, at, zlib.decompressobj(31), True

    def read(self, chunk: int = READ_BYTES) -> bytes:
        """More decoded bytes; empty at the end of the member."""
        while self.open:
            self.file.seek(self.at)
            data = self.file.read(chunk)
            if not data:
                raise EOFError("the file ends inside a member")
            out = self.inflate.decompress(data)
            if self.inflate.eof:
                self.open = False
                self.at += len(data) - len(self.inflate.unused_data)
            else:
                self.at += len(data)
            if out:
                return out
        return b""


def _header(member: Member) -> tuple[dict[str, str], bytes] | None:
    """The WARC header of a member and the bytes behind it; None if it has none."""
    data = b""
    while b"\r\n\r\n" not in data:
        if len(data) >= 5 and not data.startswith(b"WARC/"):
            return None
        more = member.read(8192)
        if not more:
            return None
        data += more
    if not data.startswith(b"WARC/"):
        return None
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = (line.partition(b":") for line in head.split(b"\r\n")[1:])
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in fields}, rest


def _payload(member: Member, rest: bytes, length: int) -> tuple[bytes, bytes]:
    """HTTP header and payload of a record whose block has ``length`` bytes."""
    parts, size = [rest], len(rest)
    while size < length:
        more = member.read()
        if not more:
            raise EOFError("the record ends before its block")
        parts.append(more)
        size += len(more)
    head, _, payload = b"".join(parts)[:length].partition(b"\r\n\r\n")
    while member.read():  # the end of the member, which checks its sum
        pass
    return head, payload


def read_range(file, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(WARC fields, HTTP header, payload) of the records that start in [start, end)."""
    at = start
    while at < end:
        # the next magic that starts inside the range
        file.seek(at)
        data = file.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        if hit < 0 or at + hit >= end:
            if len(data) < len(MAGIC):
                return
            at += max(1, len(data) - len(MAGIC) + 1)
            continue
        at += hit
        member = Member(file, at)
        try:
            found = _header(member)
            if found is None:
                raise EOFError("no record")
            fields, rest = found
            http, payload = _payload(member, rest, int(fields.get("content-length", "0")))
        except (zlib.error, EOFError, ValueError):
            at += 1  # bytes that only look like a member, or an empty one
            continue
        yield fields, http, payload
        at = member.at


FIELDS = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def _id(value: str | None) -> str | None:
    return value.removeprefix("<urn:page:").removesuffix(">") or None if value else None


def read(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """One row per record under ``path``; digests and lengths of responses are taken from the payload as read.

    A revisit has a null payload, and the digest and length that its headers give for the full one. Files must lie
    where pyarrow can open them (a local or shared folder, S3, GCS, HDFS).
    """

    def run(batches):
        for b in batches:
            for name, size, start in zip(*(b.column(k).to_pylist() for k in range(3))):
                system, inner = fs.FileSystem.from_uri(name)
                rows, held = [], 0
                with system.open_input_file(inner) as file:
                    for fields, http, payload in read_range(file, size, start, min(size, start + range_bytes)):
                        revisit = fields.get("warc-type") == "revisit"
                        length = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
                        rows.append({
                            "record_id": _id(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri") or None,
                            "refers_to": _id(fields.get("warc-refers-to")),
                            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base32_sha1(payload),
                            "payload_bytes": length if revisit else len(payload), "payload": payload if with_payload and not revisit else None,
                        })
                        held += len(payload) if with_payload else 200
                        if held >= READ_BYTES * 8:
                            yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return byte_ranges(spark, path, range_bytes).mapInArrow(run, FIELDS)


SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

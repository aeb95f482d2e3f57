"""WARC archives: write them as one gzip stream, normalise to one gzip member per record, read back by index.

Archives are binary rows of tables in the folder that the cluster shares, each of bounded size, so no
executor needs another one's disk. The normaliser inflates a whole-file stream once, in pieces, cuts it
into records by their lengths, writes every record as its own member and lists where each one lies.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.llm.common import materialize

#: Bytes of records after which an archive is closed (one record may be longer), compression level, and the date of all records.
ARCHIVE_BYTES, LEVEL, DATE = 4 << 20, 4, "2024-01-01T00:00:00Z"
#: Payloads of at least so many bytes may be revisits.
REVISIT_BYTES = 0
PAGE_URN = "urn:lexforge:page:"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 16


def plan_records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, html, digest (hex SHA-1 of the payload) and refers_to: the smallest page_id with that payload, for the others.

    Digests are counted first, with map-side combine, and only those of several pages are joined back.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1(F.col("html").cast("binary")))
    first = p.where(F.octet_length("html") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    first = first.where("first != last").select(F.col("digest").alias("d"), "first")
    return p.join(first, p["digest"] == first["d"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def header_value(v: str) -> str:
    """A header line can't hold control characters: they are percent-coded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in v)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{PAGE_URN}{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{PAGE_URN}{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(records: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives (content binary, records long), each one gzip stream, of plan_records()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed() -> pa.RecordBatch:
            parts.append(z.flush())
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary()), pa.array([n], pa.int64())], ["content", "records"])

        z, parts, size, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                data = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), base64.b32encode(bytes.fromhex(digest.as_py())).decode(), refers_to.as_py())
                parts.append(z.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    yield closed()
                    z, parts, size, n = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), [], 0, 0
        if n:
            yield closed()

    return records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "content binary, records long")


class WarcError(ValueError):
    """A stream that isn't WARC, or is cut off."""


def inflate(data: bytes) -> Iterator[bytes]:
    """The plain bytes of a gzip file of one or many members, in pieces."""
    z, begun = zlib.decompressobj(31), False
    for at in range(0, len(data), PIECE):
        rest = data[at : at + PIECE]
        while rest:
            begun = True
            out = z.decompress(rest, PIECE)
            if out:
                yield out
            if z.eof:
                rest, z, begun = z.unused_data, zlib.decompressobj(31), False
            else:
                rest = z.unconsumed_tail
    while begun and not z.eof:
        out = z.decompress(b"", PIECE)
        if not out and not z.eof:
            raise WarcError("cut-off gzip stream")
        yield out


def parse_head(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise WarcError("no WARC version line")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def cut_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) of a plain WARC stream; at most one record and one piece are held."""
    buffer = bytearray()
    for piece in pieces:
        buffer += piece
        while (end := buffer.find(b"\r\n\r\n")) >= 0:
            head = parse_head(bytes(buffer[:end]))
            whole = end + 4 + int(head["content-length"]) + 4
            if len(buffer) < whole:
                break
            yield head, bytes(buffer[:whole])
            del buffer[:whole]
    if buffer.strip():
        raise WarcError("cut-off record")


INDEX = "array<struct<record_id:string,record_type:string,offset:bigint,length:bigint,digest:string>>"


def normalise(archives: DataFrame) -> DataFrame:
    """Archives (content, index, error): every record a gzip member of its own, the index in the order of the file.

    A file that isn't gzip or WARC, or is cut off, gives its whole records and the error. Null files give none.
    """
    kind = pa.list_(pa.struct([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("digest", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item in batch.column(0):
                out, index, at, error = [], [], 0, None
                try:
                    for head, data in cut_records(inflate(item.as_py() or b"")):
                        z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = z.compress(data) + z.flush()
                        out.append(member)
                        index.append({"record_id": head.get("warc-record-id"), "record_type": head.get("warc-type"), "offset": at, "length": len(member), "digest": head.get("warc-payload-digest")})
                        at += len(member)
                except (WarcError, zlib.error, KeyError, ValueError) as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([b"".join(out)], pa.binary()), pa.array([index], kind), pa.array([error], pa.string())], ["content", "index", "error"])

    return archives.select("content").mapInArrow(run, f"content binary, index {INDEX}, error string")


def page_of(urn: str | None) -> int | None:
    return int(urn[len(PAGE_URN) + 1 : -1]) if urn and urn.startswith(f"<{PAGE_URN}") else None


def read_back(normal: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, intact of every record, each inflated by its index entry.

    intact: a response's payload has the length and digest that its headers say; null for a revisit.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"

    def one(member: bytes) -> tuple:
        data = zlib.decompress(member, 31)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = parse_head(head)
        http, _, tail = rest.partition(b"\r\n\r\n")
        said = dict(line.decode().lower().split(": ", 1) for line in http.split(b"\r\n")[1:])
        n, digest, kind, intact = int(said["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], None
        if kind == "response":
            payload = tail[: int(fields["content-length"]) - len(http) - 4]
            intact = len(payload) == n and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest
        return page_of(fields.get("warc-record-id")), fields.get("warc-target-uri"), n, digest, kind, page_of(fields.get("warc-refers-to")), intact

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, index in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(content.as_buffer())
                rows = [one(data[e["offset"] : e["offset"] + e["length"]]) for e in index.as_py()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in schema.split(", ")])

    return normal.select("content", "index").mapInArrow(run, schema)


def archive_pages(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write pages as whole-file gzip WARCs, normalise these, and read the records back by index.

    Nulls: a null html is an empty payload; a null url leaves out its header; a null page_id is never
    a response that others refer to unless no page with that payload has one, and stays null. Rows
    that repeat a page_id have the same type. Empty tables give no archives and no rows. Other columns are not read.
    """
    spark = pages.sparkSession
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    archives = materialize(write_archives(plan_records(pages, revisit_bytes)), "warc")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # archives are megabytes each
    try:
        normal = materialize(normalise(archives), "warc-normal")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return read_back(normal)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p),
d AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1) AS x FROM g)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (((x[5 * i // 4 + 1] * 16 + coalesce(x[5 * i // 4 + 2], 0)) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = f OR f IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> f THEN f END AS refers_to,
       CASE WHEN page_id = f OR f IS NULL THEN true END AS intact
FROM d
"""

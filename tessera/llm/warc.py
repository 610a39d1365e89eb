"""WARC files: a writer with revisit records, and a splittable reader."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import new_path, saved, table

MAGIC = b"\x1f\x8b\x08"
LEVEL = 6
#: Bytes of a file after which the next one is begun, of a range that one task scans, and of one read.
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 1 << 30, 8 << 20, 1 << 18
#: Tasks of a read at most; each then has several ranges.
MOST_TASKS = 100_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORD = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, first: the smallest page_id of equal payloads of at least
    `least` bytes where a payload repeats, else null. Only digests are grouped; pages aren't shuffled
    if the table of repeated digests is below Spark's threshold for broadcasts."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    digest = F.sha1(F.encode(body, "UTF-8"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), digest.alias("sha"))
    again, _ = saved(rows.where(F.col("payload_bytes") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    return rows.join(again, "sha", "left")


def _record(page_id, url, body: bytes, sha: str, first) -> bytes:
    digest = b32encode(bytes.fromhex(sha)).decode()
    revisit = first is not None and page_id is not None and page_id != first
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if revisit else http + body
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_warc(pages: DataFrame, uri: str, least: int = 0) -> DataFrame:
    """Writes a gzip member for each row below `uri`; returns the manifest (path, bytes, records), itself kept there.

    Of rows with equal payloads of at least `least` bytes, that with the smallest page_id is a response, and the
    others revisit it; rows that repeat that page_id are responses, as are all rows without page_id.
    Null html is an empty payload. A task that is run again writes new files; the manifest names those
    of the tasks that succeeded, and only these are read. uri is a place that pyarrow's file systems can open
    from every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(uri)
        store.create_dir(top, recursive=True)
        out, done, size, count, name = None, [], 0, 0, ""
        for b in batches:
            for page_id, url, html, sha, first in zip(*(b.column(k).to_pylist() for k in ("page_id", "url", "html", "sha", "first")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, count = store.open_output_stream(f"{top}/{name}", compression=None), 0, 0
                member = _record(page_id, url, html.encode(), sha, first)
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{uri}/{name}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{uri}/{name}", size, count))
        for path, n, records in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [n], "records": [records]})

    rows = typed(pages, least).select("page_id", "url", "html", "sha", "first")
    return saved(rows.mapInArrow(run, MANIFEST), "manifest")[0]


class _Source:
    """Bytes of a file by position, a few reads held."""

    def __init__(self, file) -> None:
        self.file, self.at, self.held, self.size = file, 0, b"", file.size()

    def take(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, READ_BYTES))
        return self.held[at - self.at : at - self.at + n]


def _member(src: _Source, at: int) -> tuple[bytes, int] | None:
    """The data of the member at `at` and the position after it; None unless it is a WARC record, whole and sound."""
    unpack, parts, first = zlib.decompressobj(31), [], b""
    try:
        while not unpack.eof:
            data = src.take(at, READ_BYTES)
            if not data:
                return None
            got = unpack.decompress(data)
            at += len(data) - len(unpack.unused_data)
            parts.append(got)
            if len(first) < 7:
                first += got[:7]
                if not b"WARC/1.".startswith(first[:7]):
                    return None
    except zlib.error:
        return None
    return (b"".join(parts), at) if first[:7] == b"WARC/1." else None


def members(src: _Source, start: int, end: int) -> Iterator[bytes]:
    """Records whose first byte is in [start, end). From start, the gzip magic is looked for and candidates are
    validated by decoding them; after a record, the next begins where it ended."""
    at, known = start, False
    while at < end:
        if not known:
            data = src.take(at, min(READ_BYTES, end - at + len(MAGIC) - 1))
            k = data.find(MAGIC)
            if k < 0:
                at += max(1, len(data) - len(MAGIC) + 1)
                continue
            at += k
            if at >= end:
                return
        found = _member(src, at)
        if found is None:
            at, known = at + 1, False
            continue
        yield found[0]
        at, known = found[1], True


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    ident = lambda x: None if x is None or x == "<urn:page:None>" else int(x[len("<urn:page:") : -1])
    digest, kind = fields["WARC-Payload-Digest"].partition(":")[2], fields["WARC-Type"]
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    if kind == "response" and (len(body) != length or b32encode(hashlib.sha1(body).digest()).decode() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: its payload isn't what its digest says")
    return {"page_id": ident(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload": body if kind == "response" else None, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": ident(fields.get("WARC-Refers-To"))}


def read_warc(manifest: DataFrame, split: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files that a manifest (path, bytes) names, however many tasks share a file. A range that
    begins within a record skips it; a record belongs to the range that its first byte is in. Ranges are dealt out evenly to a
    task each, up to MOST_TASKS of them; the number is given, as AQE would join tasks whose input is a few bytes of range. A file of no bytes has no record; no rows: no
    rows; other columns of the manifest are not read."""
    tasks = manifest.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0]
    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long"))).alias("start")).select("path", "start", F.least(F.col("start") + split, "bytes").alias("end"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for r in b.to_pylist():
                store, path = fs.FileSystem.from_uri(r["path"])
                with store.open_input_file(path) as file:
                    held, size = [], 0
                    for data in members(_Source(file), r["start"], r["end"]):
                        held.append(parse_record(data))
                        size += len(data)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    return ranges.repartition(max(1, min(int(tasks or 0), MOST_TASKS))).mapInArrow(run, RECORD)


def op2_warc(spark, sf_dir: str) -> DataFrame:
    """Pages written as WARC and read back: of equal payloads, that of the smallest page_id is the response. Null html is an empty payload;
    rows that repeat a page_id give as many records; a null page_id is a response; no rows: no rows."""
    manifest = write_warc(table(spark, sf_dir, "pages"), new_path(spark, "warc"))
    return read_warc(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT sha, min(page_id) AS first FROM p GROUP BY sha),
b AS (SELECT p.page_id, octet_length(encode(p.body)) AS payload_bytes, f.first,
  array_to_string(list_transform(range(0, 8), lambda k: array_to_string(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(p.sha, CAST(5 * k + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * j AS BIGINT)) & 31 AS INTEGER), 1)), '')), '') AS payload_digest
  FROM p JOIN f USING (sha))
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM b
"""

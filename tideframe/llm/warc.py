"""WARC archives with the index first: each record's file, offset, length, URL and digest are written as it is, and
selected records are fetched by sorted byte ranges that are read together where they lie close.

Archives are files of gzip members, one a record, below a shared folder. A task names its files by a fresh id, and only
the files of the attempt that succeeded are in the (written) index, so a repeated task leaves at most unused files.
Folders are opened with pyarrow.fs: file, hdfs, s3 and gs addresses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import keyed_join, shared_folder, written

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, record_type string, refers_to long, file string, offset long, length long, payload_digest string"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_INDEX_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("payload_digest", pa.string())])
_RECORD_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    for a, b in (("s3a://", "s3://"), ("s3n://", "s3://")):
        uri = b + uri.removeprefix(a) if uri.startswith(a) else uri
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri.removeprefix("file:"))


def digest32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record as a gzip member: a response, or a revisit (the HTTP head alone) if refers_to is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> dict:
    """The columns of RECORD from one gzip member. Length and digest of a response are computed from its payload; those
    of a revisit are what its HTTP head and its WARC head say of the full payload."""
    raw = zlib.decompress(member, 31)
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    http_end = block.index(b"\r\n\r\n")
    page = lambda x: int(x[10:-1]) if x and x != "<urn:page:>" else None
    out = {"page_id": page(head["WARC-Record-ID"]), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"], "refers_to": page(head.get("WARC-Refers-To", ""))}
    if out["record_type"] == "response":
        payload = block[http_end + 4 :]
        return out | {"payload_bytes": len(payload), "payload_digest": digest32(payload), "payload": payload}
    said = dict(x.split(": ", 1) for x in block[:http_end].decode().split("\r\n")[1:])
    return out | {"payload_bytes": int(said["Content-Length"]), "payload_digest": head["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}


def write_archives(df: DataFrame, page_id: str, url: str, payload: str, folder: str | None = None, least: int = 0, date: str = "1970-01-01T00:00:00Z", file_bytes: int = 1 << 28) -> DataFrame:
    """Writes a record per row and returns the index (a written table, columns of INDEX).

    Of rows with equal payloads of at least ``least`` bytes, that with the largest id is the response, and the others are
    revisits of it; smaller payloads are all responses. Null payloads are empty, a null url leaves the header out, control
    characters of a url are percent-encoded. Rows that repeat the largest id with the same payload are all responses. A
    null id is below all others, and a group of null ids alone is all responses. No row gives no file.
    """
    spark = df.sparkSession
    folder = folder or shared_folder(spark)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), body.alias("payload"), F.sha1(body).alias("_sha1"))
    # one payload can be on a third of all pages; groups of equal payloads are counted before they are joined back
    groups = rows.groupBy("_sha1").agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = written(groups.select(F.col("_sha1").alias("_key"), "_last"))
    rows = keyed_join(rows, groups, [("_sha1", "_key")], F.xxhash64("page_id", "url"))
    refers = F.when((F.octet_length("payload") >= least) & F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last")), F.col("_last"))
    rows = rows.select("page_id", "url", "payload", refers.alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                found: list[dict] = []
                ids, urls, refs = (batch.column(i).to_pylist() for i in (0, 1, 3))
                for i, body in enumerate(batch.column(2)):
                    body = body.as_py()
                    if out is None or at >= file_bytes:
                        if out is not None:
                            out.close()
                        system.create_dir(root, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    digest = digest32(body)
                    member = record_bytes(ids[i], urls[i], body, digest, refs[i], date)
                    out.write(member)
                    found.append({"page_id": ids[i], "url": urls[i], "record_type": "response" if refs[i] is None else "revisit", "refers_to": refs[i], "file": name, "offset": at, "length": len(member), "payload_digest": digest})
                    at += len(member)
                yield pa.RecordBatch.from_pylist(found, schema=_INDEX_ARROW)
        finally:
            if out is not None:
                out.close()

    index = written(rows.mapInArrow(write, INDEX))
    return index.withColumn("file", F.concat(F.lit(folder + "/"), "file"))


def read_records(index: DataFrame, with_payload: bool = True, gap: int = 1 << 16, most: int = 1 << 23, chunk: int = 1 << 23) -> DataFrame:
    """The records that the rows of an index name (columns of RECORD; payload null unless asked for).

    Rows are dealt by ranges of file and offset, a task for each ``chunk`` bytes to be read, and sorted by offset. Records not more than ``gap`` bytes apart
    are read at once, up to ``most`` bytes or one record. Rows named twice are read once and returned twice.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = index.select("file", "offset", "length").repartitionByRange(max(1, -(-int(total) // chunk)), "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, pa.NativeFile] | None = None
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(rows):
                name, start, length = rows[i]
                end, j = start + length, i + 1
                while j < len(rows) and rows[j][0] == name and rows[j][1] <= end + gap and max(end, rows[j][1] + rows[j][2]) - start <= most:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if opened is None or opened[0] != name:
                    system, path = open_folder(name)
                    if opened is not None:
                        opened[1].close()
                    opened = name, system.open_input_file(path)
                data = opened[1].read_at(end - start, start)
                found = [parse_record(data[a - start : a - start + n]) for _, a, n in rows[i:j]]
                if not with_payload:
                    for x in found:
                        x["payload"] = None
                yield pa.RecordBatch.from_pylist(found, schema=_RECORD_ARROW)
                i = j
        if opened is not None:
            opened[1].close()

    return parts.mapInArrow(read, RECORD)

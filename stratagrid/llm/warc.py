"""WARC archives: a writer that gives each record its own gzip member, and a sequential reader.

Of records with equal payloads (compared by their SHA-256) of at least min_bytes, that with the largest page_id
is a response and the others revisit it; a null page_id is below all others, and rows that repeat the largest
are all responses. A null body is an empty payload. Archives are files in the shared folder. Each try of a task
writes files of its own, and only the files of tries that ended are listed in the manifest, which the reader
goes by. An empty input gives no archive and no record. Bodies of any length are one record each. Columns may
have any names; only those of the id, the address and the body are looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shared_dir, spread_join

#: Bytes of an archive after which a new one is begun, and bytes that the reader takes at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 16
LEVEL, DATE = 4, "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary"


class Damaged(ValueError):
    """An archive that breaks the format or a digest."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record or "")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, not yet compressed. A revisit has the payload's digest and length, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    """data as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes

    @property
    def revisit(self) -> bool:
        return self.headers["warc-type"] == "revisit"


def members(source: BinaryIO, chunk: int = CHUNK) -> Iterator[bytes]:
    """The content of one gzip member after another, read and decompressed in chunks."""
    z, parts, data = zlib.decompressobj(31), [], b""
    begun = False
    while True:
        data = data or source.read(chunk)
        if not data:
            if begun:
                raise Damaged("the last member is cut off")
            return
        begun = True
        try:
            parts.append(z.decompress(data))
        except zlib.error as e:
            raise Damaged(str(e)) from e
        data = b""
        if z.eof:
            data = z.unused_data
            yield b"".join(parts)
            z, parts, begun = zlib.decompressobj(31), [], False


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def parse(data: bytes) -> Record:
    """One record, framed by its content length and held against its digests."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or not lines[0].startswith(b"WARC/1."):
        raise Damaged("no WARC header")
    headers = _fields(lines[1:])
    n = int(headers.get("content-length", -1))
    if n < 0 or len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise Damaged("the block is not as long as said")
    block = rest[:n]
    if headers.get("warc-block-digest", "sha1:" + digest(block)) != "sha1:" + digest(block):
        raise Damaged("the block's digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    found = Record(headers, _fields(http.split(b"\r\n")[1:]), payload)
    if not found.revisit and headers.get("warc-payload-digest", "sha1:" + digest(payload)) != "sha1:" + digest(payload):
        raise Damaged("the payload's digest differs")
    return found


def read(source: BinaryIO, chunk: int = CHUNK) -> Iterator[Record]:
    return map(parse, members(source, chunk))


def typed(pages: DataFrame, page_id: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, keep: the page whose payload a revisit has, or null for a response."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(body), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("key", F.sha2("payload", 256))
    several = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).filter("n > 1")
    several = materialise(several, "repeated")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    return spread_join(rows, several.select("key", "keep"), ["key"], several.select("key", "n"), "left").select("page_id", "url", "payload", F.when(revisit, F.col("keep")).alias("keep"))


def write(pages: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, **columns) -> DataFrame:
    """Write archives of pages into folder, one below the shared one by default; the manifest: path, records."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = fs.FileSystem.from_uri(folder)
        store.create_dir(at)
        done, out, n, size = [], None, 0, 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    path = f"{at}/{uuid.uuid4().hex}.warc.gz"
                    out, n, size = store.open_output_stream(path, compression=None), 0, 0
                data = member(record(row[0], row[1], row[2], row[3], row[3] is not None))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        names = [f"{folder.rstrip('/')}/{p.rpartition('/')[2]}" for p, _ in done]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return materialise(typed(pages, **columns).mapInArrow(run, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of all archives of the manifest; a revisit's payload is null, its length and digest are not."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(path)
                rows, n = [], 0
                with store.open_input_stream(at, compression=None) as source:
                    for r in read(source):
                        n += 1
                        h = r.headers
                        rows.append((page_of(h["warc-record-id"]), h["warc-target-uri"], h["warc-type"], h["warc-payload-digest"].removeprefix("sha1:"), int(r.http["content-length"]), page_of(h.get("warc-refers-to")), None if r.revisit else r.payload))
                        if len(rows) == 500:
                            yield batch_of(rows)
                            rows = []
                if n != records:
                    raise Damaged(f"{path} has {n} records, not {records}")
                if rows:
                    yield batch_of(rows)

    archives = max(1, min(manifest.count(), 100_000))
    return manifest.select("path", "records").repartition(archives).mapInArrow(run, RECORD)


def report(pages: DataFrame) -> DataFrame:
    """Each page's record, as it was read back from the archives."""
    return read_archives(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

"""WARC archives: one gzip member per record, written and read back sequentially on the executors.

``write`` marks copies first: of records with equal payloads of at least ``min_revisit`` bytes the one with the largest id is
the ``response``, the others are ``revisit`` records without payload (rows that share that largest id are all responses).
Only digests and ids are shuffled for that, and only digests with copies are kept. Each task then appends its records to
archives of about ``archive_bytes`` in a shared folder; names hold the attempt, and only names of finished tasks are listed,
so a repeated task does no harm.

``read`` opens each listed archive once and decompresses it in pieces: a gzip member is a record, its header ends at the
first empty line, ``Content-Length`` frames its block, and the digest of a response's payload is verified. A member that
breaks these rules raises an error that names the archive and the record.

Null html is an empty payload, a null url an empty target, a null id the record name ``null`` (read back as null). Repeated
rows give a record each. Line ends in a url are percent-encoded. An empty table writes no archive and reads no row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, with_columns_checked

NAME = "urn:page:"
DATE = "2024-01-01T00:00:00Z"
READ_BYTES = 1 << 18


def open_folder(uri: str):
    """(file system, path) of a folder; ``file:/x`` and plain paths are local or mounted on all machines."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def record(page, url: str | None, payload: bytes, digest: str, refers) -> bytes:
    """The gzip member of one record; ``refers`` is a tuple with the other's id for a revisit, else None."""
    name = lambda i: f"<{NAME}{'null' if i is None else i}>"
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    block = http if refers is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {name(page)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
            f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {name(refers[0])}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + block + b"\r\n\r\n") + z.flush()


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time, reading a piece of the file at a time."""
    z, parts, data = zlib.decompressobj(31), [], b""
    fresh = True
    while True:
        if not data:
            data = stream.read(READ_BYTES)
            if not data:
                break
        parts.append(z.decompress(data))
        fresh, data = False, z.unused_data
        if z.eof:
            yield b"".join(parts)
            z, parts, fresh = zlib.decompressobj(31), [], True
    if not fresh:
        raise ValueError("the last gzip member is cut off")


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def parse(member: bytes) -> tuple:
    """(id, payload bytes, payload digest, type, refers to) of one record; an error where it is not well formed."""
    head, found, rest = member.partition(b"\r\n\r\n")
    h = fields(head)
    if not found or not h[""].startswith("WARC/1."):
        raise ValueError("no WARC header")
    size = int(h["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block of {h.get('warc-record-id')} does not end after {size} bytes")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    kind, label = h["warc-type"], h["warc-payload-digest"]
    digest = base64.b32decode(label.removeprefix("sha1:")).hex()
    n = int(fields(http)["content-length"])
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {h.get('warc-record-id')} does not match its length or digest")
    ident = lambda v: None if v is None or v.strip("<>") == NAME + "null" else int(v.strip("<>").removeprefix(NAME))
    return ident(h["warc-record-id"]), n, digest, kind, ident(h.get("warc-refers-to"))


def write(pages: DataFrame, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          min_revisit: int = 1000, archive_bytes: int = 64 << 20) -> DataFrame:
    """Write the archives and return their listing (archive, records)."""
    with_columns_checked(pages, id_col, url_col, html_col)
    p = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    copies = scratch.write(
        p.where(F.octet_length("payload") >= min_revisit).groupBy(F.col("digest").alias("d"))
        .agg(F.max("page").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    marked = p.join(copies, F.col("digest") == F.col("d"), "left").select(
        "page", "url", "payload", "digest", "first",
        (F.col("d").isNotNull() & ~F.col("page").eqNullSafe(F.col("first"))).alias("copy"))
    folder = scratch.path("warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(folder)
        context = TaskContext.get()
        stem = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, name, n, files = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["archive", "records"])

        for batch in batches:
            for page, url, payload, digest, first, copy in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    store.create_dir(base, recursive=True)
                    name, files, n = f"{stem}-{files:04d}.warc.gz", files + 1, 0
                    out = store.open_output_stream(name, compression=None)
                out.write(record(page, url, payload, digest, (first,) if copy else None))
                n += 1
                if out.tell() >= archive_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    listing = marked.mapInArrow(run, "archive string, records long")
    return scratch.write(listing, "listing").withColumn("folder", F.lit(folder))


def read(listing: DataFrame) -> DataFrame:
    """The records of the listed archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, count, folder in zip(*(c.to_pylist() for c in batch.columns)):
                store, _ = open_folder(folder)
                rows: list[tuple] = []
                seen = 0
                with store.open_input_stream(name, compression=None) as stream:
                    for member in members(stream):
                        try:
                            rows.append(parse(member))
                        except (KeyError, ValueError) as bad:
                            raise ValueError(f"{name}, record {seen}: {bad}") from bad
                        seen += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if seen != count:
                    raise ValueError(f"{name} holds {seen} records instead of {count}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    spread = listing.select("archive", "records", "folder").repartition(max(1, min(listing.count(), 20_000)))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")

"""Chunked record table over WARC archives.

A page is a record; its payload is cut into rows (record, chunk number,
chunk) before it reaches a worker, and the writer streams those rows into a
gzip member of the archive, so neither side holds a second whole payload.  The
reader streams an archive back into the same chunk rows; each row carries the
SHA-1 digest of the payload up to and with its chunk, so the last row's digest
is the payload's.  Digests written in the headers and digests of the streamed
bytes are compared on both ways.

Archives are written with a temporary name and renamed when complete; the
manifest that Spark commits names the archives of the successful attempts only,
so a lost executor's leftovers are never read.

Of records with equal payloads (SHA-1 and length) of at least ``min_bytes``
bytes, those with the smallest page_id are ``response`` and the others
``revisit`` records, which refer to that page_id and hold no payload.  A NULL
html is an empty payload; repeated rows are records of their own (rows that
share the smallest page_id are all responses); a NULL page_id is never the
smallest unless there is no other, and then all are responses; control
characters in a url are percent-encoded.  An empty table gives no archives and
no rows.  Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, stored
from dunegrid.session import materialize

HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
CHUNK_SCHEMA = ("archive string, record_id string, page_id long, url string, record_type string, refers_to long, "
                "payload_bytes long, payload_digest string, chunk_no int, is_last boolean, chunk_bytes long, "
                "running_digest string, chunk binary")
READ_BYTES = 1 << 18


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_table(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload (binary), sha1 (hex), payload_bytes, record_type, refers_to, number.

    What is a revisit is decided on (page_id, sha1, payload_bytes) alone, with
    partial aggregates, and joined back by all three, so equal payloads never
    meet in a task.  ``number`` tells repeated rows apart (the same on a retry).
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.monotonically_increasing_id().alias("number"))
    rows = rows.withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keys = materialize(rows.select("page_id", "sha1", "payload_bytes"), "warc-digests")
    shared = (keys.groupBy("sha1", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
              .filter((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes)).drop("n"))
    revisits = keys.distinct().join(shared, ["sha1", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
    revisits = materialize(revisits.filter("first_id IS NOT NULL").select(
        F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("payload_bytes").alias("_bytes"), "first_id"),
        "warc-revisits")
    both = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("sha1") == F.col("_sha1"))
                     & (F.col("payload_bytes") == F.col("_bytes")), "left")
    revisit = F.col("first_id").isNotNull()
    return both.select("page_id", "url", F.when(revisit, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
                       "sha1", "payload_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                       F.col("first_id").alias("refers_to"), "number")


def chunk_rows(records: DataFrame, chunk_bytes: int = 1 << 18) -> DataFrame:
    """One row per chunk, a record's chunks in a row; an empty payload is one
    empty chunk.  Chunk numbers are exploded and each row cuts its own chunk."""
    last = F.greatest(F.lit(0), F.ceil(F.octet_length("payload") / chunk_bytes) - 1).cast("int")
    rows = records.select("*", (last + 1).alias("n_chunks"), F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    return rows.withColumn("chunk", F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1,
                                                F.lit(chunk_bytes))).drop("payload")


def record_id(r: dict) -> str:
    """A record's id from its page, payload and number: the same when a task is run again."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r['page_id']} {r['sha1']} {r['payload_bytes']} {r['number']} {r['url']}"))


def _header(r: dict, block: int, record_id: str) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", r["url"] or "")
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <urn:uuid:{record_id}>",
             "WARC-Date: 2000-01-01T00:00:00Z", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(r['sha1']))}",
             f"X-Payload-Bytes: {r['payload_bytes']}"]
    if r["url"] is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if r["page_id"] is not None:
        lines.append(f"X-Page-Id: {r['page_id']}")
    if r["record_type"] == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"X-Refers-To-Page-Id: {r['refers_to']}"]
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode()


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, chunk_bytes: int = 1 << 18) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as gzip WARC archives below
    ``path``; returns the stored manifest (archive, records)."""
    prepare(pages.sparkSession)
    chunks = chunk_rows(record_table(pages, min_bytes), chunk_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        name = f"{root}/{uuid.uuid4().hex}.warc.gz"
        out, records, digest, gz = None, 0, None, None
        for r in (r for b in batches for lo in range(0, b.num_rows, 32) for r in b.slice(lo, 32).to_pylist()):
            if out is None:
                out = store.open_output_stream(name + ".part", compression=None)
            if r["chunk_no"] == 0:
                gz, digest, records = zlib.compressobj(3, zlib.DEFLATED, 31), hashlib.sha1(), records + 1
                kept = r["record_type"] == "response"
                head = HTTP_HEAD.format(r["payload_bytes"]).encode() if kept else b""
                block = len(head) + (r["payload_bytes"] if kept else 0)
                out.write(gz.compress(_header(r, block, record_id(r)) + head))
            digest.update(r["chunk"])
            out.write(gz.compress(r["chunk"]))
            if r["chunk_no"] == r["n_chunks"] - 1:
                if kept and digest.hexdigest() != r["sha1"]:
                    raise ValueError(f"page {r['page_id']}: streamed chunks do not make up the payload")
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out is not None:
            out.close()
            store.move(name + ".part", name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())],
                                             names=["archive", "records"])

    return stored(chunks.mapInArrow(write, "archive string, records long"), "warc-manifest", pages.count(), 5_000)


class _Member:
    """Reads gzip members' bytes as one stream."""

    def __init__(self, f):
        self.f, self.gz, self.buffer, self.raw = f, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(READ_BYTES)
                if not self.raw:  # what the decompressor still holds
                    got = self.gz.decompress(b"", READ_BYTES)
                    self.buffer += got
                    return bool(got)
            got = self.gz.decompress(self.raw, READ_BYTES)
            if self.gz.eof:
                self.raw, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            else:
                self.raw = self.gz.unconsumed_tail
            if got:
                self.buffer += got
                return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.buffer:
            if not self.more():
                return None
        got, _, self.buffer = self.buffer.partition(mark)
        return got

    def take(self, n: int) -> bytes:
        while not self.buffer and n:
            if not self.more():
                raise ValueError("archive ends inside a record")
        got, self.buffer = self.buffer[:n], self.buffer[n:]
        return got


def _records(f, archive: str, chunk_bytes: int, with_data: bool) -> Iterator[dict]:
    stream = _Member(f)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{archive}: not a WARC record")
        h = dict(x.split(": ", 1) for x in lines[1:])
        left, digest, n = int(h["Content-Length"]), hashlib.sha1(), 0
        if left:
            http = stream.until(b"\r\n\r\n")
            left -= len(http) + 4
        base = {"archive": archive, "record_id": h["WARC-Record-ID"], "url": h.get("WARC-Target-URI"),
                "page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None, "record_type": h["WARC-Type"],
                "refers_to": int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None,
                "payload_bytes": int(h["X-Payload-Bytes"]), "payload_digest": h["WARC-Payload-Digest"][5:]}
        while True:
            want = chunk_bytes if left > chunk_bytes else left
            parts, got = [], 0
            while got < want:
                parts.append(stream.take(want - got))
                got += len(parts[-1])
                digest.update(parts[-1])
            left -= got
            running = base32_sha1(digest.copy().digest())
            if not left and h["WARC-Type"] == "response" and running != base["payload_digest"]:
                raise ValueError(f"{archive}: record {base['record_id']} does not match its digest")
            yield base | {"chunk_no": n, "is_last": not left, "chunk_bytes": got, "running_digest": running,
                          "chunk": b"".join(parts) if with_data else None}
            n += 1
            if not left:
                break
        if stream.until(b"\r\n\r\n") != b"":
            raise ValueError(f"{archive}: bytes after a record's block")


def read_chunks(manifest: DataFrame, path: str, chunk_bytes: int = 1 << 18, with_data: bool = True,
                last_only: bool = False) -> DataFrame:
    """Chunk rows (CHUNK_SCHEMA) of the manifest's archives; ``last_only``
    keeps each record's last row, which carries the whole payload's digest."""
    prepare(manifest.sparkSession)
    names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
    arrow = pa.schema([("archive", pa.string()), ("record_id", pa.string()), ("page_id", pa.int64()),
                       ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                       ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("chunk_no", pa.int32()),
                       ("is_last", pa.bool_()), ("chunk_bytes", pa.int64()), ("running_digest", pa.string()),
                       ("chunk", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(path)
        for b in batches:
            for archive in b.column("archive").to_pylist():
                rows, held = [], 0
                with store.open_input_stream(archive, compression=None) as f:
                    for r in _records(f, archive, chunk_bytes, with_data):
                        if last_only and not r["is_last"]:
                            continue
                        rows.append(r)
                        held += len(r["chunk"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    archives, records = manifest.agg(F.count(F.lit(1)), F.coalesce(F.sum("records"), F.lit(0))).first()
    rows = manifest.select("archive").repartition(max(1, archives)).mapInArrow(read, CHUNK_SCHEMA).select(*names)
    return rows.coalesce(max(1, -(-records // 5_000)))


def round_trip(pages: DataFrame, path: str, min_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back, one row per page."""
    manifest = write_archives(pages, path, min_bytes)
    last = read_chunks(manifest, path, with_data=False, last_only=True)
    return last.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

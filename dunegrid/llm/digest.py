"""Quartile bucket digests of whole texts.

Byte triplets (bytes 0, 3 and 7 of a sliding window, so that a triplet spans
words rather than a language's common syllables) are hashed into ``BUCKETS``
counters.  Each counter becomes two bits, its quartile among the text's
counters; a length code (eighths of an octave of the UTF-8 length) comes first.
Two digests differ by the sum of their quartile differences over the sum of the
larger quartiles (0 to 1), plus a small bounded share for the length; likeness
is 1 minus that difference.

A NULL text is empty.  The empty text has a digest of its own, like itself and
unlike all others.  Rows follow each other by doc_id (NULL first), then by the
text's hash, so repeated rows are each other's neighbours.  The only row of a
table is its own neighbour; an empty table gives no rows.  Other columns are
not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, stored, text_or_empty

BUCKETS = 1024
TRIPLET = (0, 3, 7)
BLOCK = 1 << 20
LENGTH_CAP, LENGTH_SHARE = 32, 0.03


def _counts(data: bytes) -> np.ndarray:
    span = TRIPLET[-1]
    padded = np.frombuffer(bytes(span) + data + bytes(span), np.uint8)
    out = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(padded) - span, BLOCK):
        d = padded[at:at + BLOCK + span].astype(np.uint32)
        n = len(d) - span
        i, j, k = TRIPLET
        h = ((d[i:i + n] << 16) | (d[j:j + n] << 8) | d[k:k + n]) * np.uint32(0x9E3779B1)
        h ^= h >> 15
        h *= np.uint32(0x85EBCA77)
        out += np.bincount(h >> np.uint32(32 - BUCKETS.bit_length() + 1), minlength=BUCKETS)
    return out


def codes(text: str) -> np.ndarray:
    """Length code, then the quartile (0 to 3) of each bucket, as uint8."""
    data = text.encode()
    if not data:
        return np.zeros(BUCKETS + 1, np.uint8)
    c = _counts(data)
    q1, q2, q3 = np.sort(c)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    length = min(255, 1 + int(8 * np.log2(len(data))))
    return np.concatenate([[length], (c > q1).astype(np.uint8) + (c > q2) + (c > q3)]).astype(np.uint8)


def packed(code: np.ndarray) -> bytes:
    """The length code, then four quartiles a byte."""
    q = code[1:].reshape(-1, 4)
    return code[:1].tobytes() + (q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6).tobytes()


def fingerprint(code: np.ndarray) -> str:
    data = packed(code)
    return data[:1].hex() + base64.urlsafe_b64encode(data[1:]).decode().rstrip("=")


def written(name: str) -> Column:
    """``fingerprint`` of a column of packed codes."""
    length, rest = F.substring(name, 1, 1), F.expr(f"substring({name}, 2)")
    return F.concat(F.lower(F.hex(length)), F.translate(F.base64(rest), "+/=\r\n", "-_")).alias(name)


def parse(text: str) -> np.ndarray:
    """The codes of a fingerprint."""
    raw = text[2:]
    packed = np.frombuffer(base64.urlsafe_b64decode(raw + "=" * (-len(raw) % 4)), np.uint8)
    q = (packed[:, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
    return np.concatenate([[int(text[:2], 16)], q.ravel()]).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal digests, 0 for an empty text against another."""
    most = int(np.maximum(a[1:], b[1:]).sum(dtype=np.int64))
    least = int(np.minimum(a[1:], b[1:]).sum(dtype=np.int64))
    if most == 0:
        return 1.0
    length = min(LENGTH_CAP, abs(int(a[0]) - int(b[0]))) / LENGTH_CAP
    return max(0.0, least / most * (1 - LENGTH_SHARE * length))


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many of the next text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


#: As stored: digests are binary until the result is made.
FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.binary()),
          ("fingerprint", pa.binary()), ("edited_fingerprint", pa.binary()), ("near_edited", pa.float64()),
          ("near_next", pa.float64())]
STORED = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _row(doc_id, text: str, code: np.ndarray, following: str, next_code: np.ndarray) -> tuple:
    edited = edited_text(text, following)
    e = codes(edited)
    return (doc_id, len(text), hashlib.sha256(edited.encode()).digest(), packed(code), packed(e),
            likeness(code, e), likeness(code, next_code))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited
    and near_next of every document and its edited text."""
    prepare(docs.sparkSession)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
            .withColumn("part", F.spark_partition_id()))
    edge_schema = pa.schema([*FIELDS, ("part", pa.int32()), ("is_first", pa.bool_()), ("is_last", pa.bool_()),
                             ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A sorted partition: every row meets its next; the first row's and the
        last row's texts are kept for the neighbouring partitions."""
        held = None  # doc_id, text, code, part, is_first
        for b in batches:
            out = []
            for doc_id, text, part in zip(*(b.column(c) for c in ("doc_id", "text", "part"))):
                doc_id, text, part = doc_id.as_py(), text.as_py(), part.as_py()
                code = codes(text)
                if held is not None:
                    out.append((*_row(*held[:3], text, code), held[3], held[4], False,
                                held[1] if held[4] else None))
                held = (doc_id, text, code, part, held is None)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), edge_schema)],
                                                 schema=edge_schema)
        if held is not None:
            doc_id, text, code, part, first = held
            last = (doc_id, len(text), None, packed(code), None, None, None, part, first, True, text)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(last, edge_schema)],
                                             schema=edge_schema)

    done = stored(rows.mapInArrow(run, STORED + ", part int, is_first boolean, is_last boolean, text string"),
                  "digests", docs.count(), 5_000)
    # one row per partition from here on
    by_part = Window.orderBy("part")
    parts = done.filter("is_first").select("part")
    following = parts.select("part", F.coalesce(
        F.lead("part").over(by_part), F.min("part").over(by_part)).alias("next_part"))
    firsts = done.filter("is_first").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = (done.filter("is_last").select("part", "doc_id", "text").join(following, "part")
            .join(firsts, "next_part").select("doc_id", "text", "next_text"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [_row(r["doc_id"], r["text"], codes(r["text"]), r["next_text"], codes(r["next_text"]))
                   for r in b.to_pylist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), FIELDS)],
                                                 names=[n for n, _ in FIELDS])

    names = [n for n, _ in FIELDS]
    return done.filter("not is_last").select(names).unionByName(ends.mapInArrow(finish, STORED)).select(
        "doc_id", "n_chars", F.lower(F.hex("edited_sha256")).alias("edited_sha256"), written("fingerprint"),
        written("edited_fingerprint"), "near_edited", "near_next")

"""Target-distribution importance resampling with segment deduplication.

Words are runs of digits, letters a-z (A-Z is lower-cased) and characters
beyond ASCII.  Features are all runs of 1 to ``n`` consecutive words of a text;
a feature's bucket is its CRC-32 modulo ``buckets``.  A bucket's gain is the
floored 1000-fold log ratio of its smoothed shares in the target and in the
documents; a document's weight is the floored mean gain of its features, its
score the weight plus a Gumbel draw from a hash of its doc_id.  The documents of
the highest scores are drawn.

Segment deduplication: newlines separate words, so they cut a text into lines.
Equal lines of all documents are brought together (with partial counts, so a
line that stands in every document costs one row per task), the features of
each distinct line are hashed once, and its counts are multiplied by its
occurrences.  Runs of words that cross lines are counted apart, from the texts:
every such run ends in one line and starts before it, so a line with the
``n - 1`` words before it holds them all.  Scoring sums a line once per task
while it is remembered.

A NULL text has no words and no features (weight 0); a NULL doc_id draws from
the hash of the seed alone and comes last among ties; repeated rows are drawn
by themselves.  Without a target all its counts are 0.  An empty table gives no
rows; other columns are not read by ``ranks`` and are kept by ``draw``.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, stored
from dunegrid.operators.ordering import with_position

#: A-Z to a-z; what is neither digit, letter, newline nor beyond ASCII to space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 or b == 10 else 32
               for b in range(256))
#: Features and bytes of lines that a worker process remembers.
KEPT_FEATURES, KEPT_LINE_BYTES = 400_000, 32 << 20


def clean(text: str | None) -> bytes:
    """UTF-8 bytes of a text with words apart by spaces and newlines only."""
    return (text or "").encode().translate(_TABLE)


def inner_runs(words: Sequence[bytes], n: int) -> list[bytes]:
    """Runs of 1 to ``n`` words of a line."""
    out = list(words)
    for k in range(2, n + 1):
        out += [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)]
    return out


def crossing_runs(tail: Sequence[bytes], words: Sequence[bytes], n: int) -> list[bytes]:
    """Runs of at most ``n`` words that start in ``tail`` (the at most n - 1
    words before a line) and end in the line."""
    both = [*tail, *words[:n - 1]]
    t = len(tail)
    return [b" ".join(both[i:e + 1]) for e in range(t, len(both)) for i in range(max(0, e + 1 - n), t)]


def tail_of(tail: Sequence[bytes], words: Sequence[bytes], n: int) -> list[bytes]:
    return [*tail, *words][-(n - 1):] if n > 1 else []


class _Buckets(dict):
    """Bucket of a feature, remembered."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_FEATURES:
            self.clear()
        b = zlib.crc32(feature) % self.buckets
        self[feature] = b
        return b


def _counted(counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    return pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def bucket_counts(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """bucket, n: how often the features of all texts fall into a bucket."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(
        F.count(F.lit(1)).alias("times"))

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            found = [inner_runs(clean(line.as_py()).split(), n) for line in b.column("line")]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            at = np.fromiter(map(of.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
            times = np.repeat(b.column("times").to_numpy(), sizes)
            counts += np.bincount(at, times, minlength=buckets).astype(np.int64)
        yield _counted(counts)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts = _Buckets(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for text in b.column("text"):
                tail: list[bytes] = []
                for line in clean(text.as_py()).split(b"\n"):
                    words = line.split()
                    for f in crossing_runs(tail, words, n):
                        counts[of[f]] += 1
                    tail = tail_of(tail, words, n)
        yield _counted(counts)

    parts = lines.mapInArrow(inside, "bucket long, n long")
    if n > 1:
        parts = parts.unionByName(docs.select("text").mapInArrow(across, "bucket long, n long"))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, n: int, buckets: int) -> np.ndarray:
    """Gain of every bucket; what the driver holds are two arrays of ``buckets`` counts."""
    arrays = []
    for df in (docs, target):
        counts = np.zeros(buckets, object)  # Python integers: no overflow, whatever the total
        for r in bucket_counts(df, n, buckets).collect():
            counts[r["bucket"]] = r["n"]
        arrays.append(counts)
    s, t = arrays
    total_s, total_t = float(sum(s) + buckets), float(sum(t) + buckets)
    return np.array([math.floor(1000 * math.log((float(t[b] + 1) * total_s) / (float(s[b] + 1) * total_t)))
                     for b in range(buckets)], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """Floored 1000-fold Gumbel draw of a doc_id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Lines(dict):
    """(words, features, gain, first and last words) of a line, remembered up to a number of bytes."""

    def __init__(self, gain_of: dict, n: int):
        super().__init__()
        self.gain_of, self.n, self.bytes = gain_of, n, 0

    def __missing__(self, line: bytes):
        words = line.split()
        found = inner_runs(words, self.n)
        ends = (words[:self.n - 1], words[-(self.n - 1):]) if self.n > 1 else ((), ())
        out = (len(words), len(found), sum(map(self.gain_of.__getitem__, found)), *ends)
        if self.bytes > KEPT_LINE_BYTES:
            self.clear()
            self.bytes = 0
        if len(line) <= 4096:
            self[line] = out
            self.bytes += len(line) + 200
        return out


class _Gains(dict):
    """Gain of a feature, remembered."""

    def __init__(self, table: list[int]):
        super().__init__()
        self.table = table

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KEPT_FEATURES:
            self.clear()
        g = self.table[zlib.crc32(feature) % len(self.table)]
        self[feature] = g
        return g


def scores(docs: DataFrame, gain: np.ndarray, n: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score of every row."""
    table = gain.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain_of = _Gains(table)
        lines = _Lines(gain_of, n)
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                n_words = n_features = total = 0
                tail: list[bytes] = []
                for line in clean(text.as_py()).split(b"\n"):
                    w, f, g, head, end = lines[line]
                    n_words, n_features, total = n_words + w, n_features + f, total + g
                    if n > 1 and w:
                        more = crossing_runs(tail, head, n)
                        n_features += len(more)
                        total += sum(map(gain_of.__getitem__, more))
                        tail = tail_of(tail, end, n)
                weight = total // n_features if n_features else 0
                out.append((doc_id, n_words, n_features, weight, weight + gumbel(seed, doc_id)))
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                             names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_features long, weight long, score long")


def ranks(docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, seed: int = 2024, percent: int = 10,
          least_words: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score, rank (NULL where not drawn) of every row.

    ``percent`` per cent of the documents with at least ``least_words`` words
    are drawn, by descending score, ties to the smaller doc_id.
    """
    prepare(docs.sparkSession)
    rows = stored(scores(docs, gains(docs, target, n, buckets), n, seed), "resample-scores", docs.count())
    enough = F.col("n_words") >= least_words
    drawn = rows.filter(enough).count() * percent // 100
    order = rows.withColumns({"late": ~enough, "down": -F.col("score"), "none": F.col("doc_id").isNull()})
    at = with_position(order, ["late", "down", "none", "doc_id", "weight", "n_features"])
    return at.select("doc_id", "n_features", "weight", "score",
                     F.when(F.col("pos") <= drawn, F.col("pos")).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """Rows of ``docs`` whose doc_id is drawn (all rows of that doc_id; NULL is never drawn)."""
    drawn = ranks(docs, target, **options).filter("rank is not null").select(F.col("doc_id").alias("_drawn")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_id"))
    return rows.join(drawn, F.col("_id") == F.col("_drawn"), "left_semi").select("row.*")

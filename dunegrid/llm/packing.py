"""Packing documents into fixed windows by non-negative least squares.

Each task packs its own documents in blocks of ``block_tokens`` ids, in one
pass and without a shuffle:

1. Whole windows are cut off a document; what is left (shorter than a window)
   is a piece.  A piece's level is its length in units of ``unit`` tokens,
   rounded down; the block's histogram counts pieces per level.
2. Every way to fill a window with at most ``depth`` levels is a column of a
   0/1/2... matrix.  Non-negative least squares finds how often to use each
   way so that together they use up the histogram; the counts are rounded down
   and bounded by what the histogram holds.
3. Because levels are rounded down, a filled way holds at least a window of
   ids.  The overhang (below depth * unit ids) is cut off its longest piece and
   joins the residual.
4. The residual is packed greedily: the longest piece that still fits, else a
   piece is cut to fill the window exactly.  An unfinished window's pieces move
   to the next block; a task's last window is cut into lengths that are powers
   of two, which need no padding.

No id is lost or doubled and no window but those of powers of two is partly
filled, whatever the input's size.  A NULL text is empty (its end id only);
equal or NULL doc_ids are separate documents; an empty table gives no rows;
other columns are not read.  Sequence ids are unique but not dense: the task's
number times 2^32 plus a counter.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm import tokens
from dunegrid.llm.common import prepare, slices, text_or_empty

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=8)
def ways(levels: int, depth: int) -> np.ndarray:
    """Every multiset of at most ``depth`` levels that sums to ``levels``: a
    column each, counting how often it uses level 1 ... levels - 1."""
    found: list[list[int]] = []

    def grow(parts: list[int], left: int, most: int) -> None:
        if left == 0:
            found.append(parts)
        elif len(parts) < depth:
            for x in range(min(most, left), 0, -1):
                if x * (depth - len(parts)) < left:
                    break
                grow([*parts, x], left - x, x)

    grow([], levels, levels - 1)
    out = np.zeros((levels - 1, len(found)))
    for k, parts in enumerate(found):
        for x in parts:
            out[x - 1, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Least squares a @ x = b with x >= 0 by the active-set method; ``most``
    bounds the steps (any stop gives a feasible x)."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gram, ab = None, a.T @ b
    tol = 1e-9 * max(1.0, float(np.abs(ab).max(initial=0)))
    for _ in range(most or 3 * a.shape[0]):
        w = ab - a.T @ (a[:, free] @ x[free])
        w[free] = -np.inf
        k = int(np.argmax(w)) if n else 0
        if not n or w[k] <= tol:
            break
        free[k] = True
        while True:
            at = np.flatnonzero(free)
            gram = a[:, at].T @ a[:, at] + 1e-9 * np.eye(len(at))
            z = np.linalg.solve(gram, ab[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300))
            x[at] += step * (z - x[at])
            free[at[x[at] <= 1e-12]] = False
            x[~free] = 0
            if not free.any():
                break
    return x


def repeat_counts(histogram: np.ndarray, depth: int) -> list[tuple[list[tuple[int, int]], int]]:
    """How often to use each way: ([(level, times)], repeats), bounded by the histogram."""
    left = histogram.astype(np.int64).copy()
    a = ways(len(histogram) + 1, depth)
    usable = np.flatnonzero((a <= left[:, None]).all(axis=0))
    if not len(usable):
        return []
    x = nnls(a[:, usable], left.astype(float))
    out = []
    for k in np.argsort(-x, kind="stable"):
        if x[k] <= 0:
            break
        use = [(int(i), int(a[i, usable[k]])) for i in np.flatnonzero(a[:, usable[k]])]
        n = min([round(x[k]), *(int(left[i]) // m for i, m in use)])
        if n > 0:
            for i, m in use:
                left[i] -= n * m
            out.append(([(i + 1, m) for i, m in use], n))
    return out


class _Packer:
    """Packs one task's documents; a piece is (length, doc, start)."""

    def __init__(self, window: int, unit: int, depth: int, first_id: int):
        self.window, self.unit, self.depth = window, unit, depth
        self.next_id = first_id
        self.rows: list[tuple] = []
        self.docs: dict[int, tuple] = {}  # number -> (doc_id, ids, tokens)
        self.pieces: list[tuple[int, int, int]] = []
        self.count = 0

    def add(self, doc_id, ids: bytes) -> None:
        n, self.count = len(ids) // 4, self.count + 1
        self.docs[self.count] = (doc_id, ids, n)
        full = n // self.window
        for k in range(full):
            self.emit([(self.window, self.count, k * self.window)])
        if n % self.window:
            self.pieces.append((n % self.window, self.count, full * self.window))

    def emit(self, pieces: list[tuple[int, int, int]]) -> None:
        at = 0
        for length, doc, start in pieces:
            doc_id, ids, n = self.docs[doc]
            crc = zlib.crc32(memoryview(ids)[4 * start:4 * (start + length)])
            self.rows.append((doc_id, start, length, crc, n, self.next_id, at))
            at += length
        self.next_id += 1

    def pack(self, last: bool) -> None:
        """Pack what has come; unless ``last``, keep an unfinished window's pieces."""
        by_level: dict[int, list] = {}
        for p in sorted(self.pieces):
            by_level.setdefault(p[0] // self.unit, []).append(p)
        residual = by_level.pop(0, [])
        levels = self.window // self.unit
        histogram = np.array([len(by_level.get(x, ())) for x in range(1, levels)])
        for use, repeats in repeat_counts(histogram, self.depth):
            for _ in range(repeats):
                pieces = sorted((by_level[x].pop() for x, m in use for _ in range(m)), reverse=True)
                over = sum(p[0] for p in pieces) - self.window
                length, doc, start = pieces[0]
                if over:
                    residual.append((over, doc, start + length - over))
                    pieces[0] = (length - over, doc, start)
                self.emit(pieces)
        residual = sorted(residual + [p for x in by_level.values() for p in x])
        total = sum(p[0] for p in residual)
        while total >= self.window:
            self.emit(self.fill(residual, self.window))
            total -= self.window
        while last and total:
            size = 1 << (total.bit_length() - 1)
            self.emit(self.fill(residual, size))
            total -= size
        self.pieces = residual
        kept = {p[1] for p in residual}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}

    @staticmethod
    def fill(pieces: list[tuple[int, int, int]], size: int) -> list[tuple[int, int, int]]:
        """Take ``size`` ids from sorted ``pieces``: the longest that fits, else a cut one."""
        out = []
        while size:
            k = bisect.bisect_right(pieces, (size, np.inf, 0)) - 1
            if k >= 0:
                out.append(pieces.pop(k))
            else:
                length, doc, start = pieces.pop(0)
                out.append((size, doc, start))
                bisect.insort(pieces, (length - size, doc, start + size))
            size -= out[-1][0]
        return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, unit: int = 64,
         depth: int = 4, block_tokens: int = 1 << 21) -> DataFrame:
    """Rows of SCHEMA: one per piece of a document's ids (its tokens, then ``end_id``)."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get().partitionId()
        packer, waiting = _Packer(window, unit, depth, task << 32), 0

        def out() -> pa.RecordBatch:
            cols = list(zip(*packer.rows)) or [()] * 7
            packer.rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[
                "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id").to_pylist()
            for lo, hi in slices(b.num_rows, pc.binary_length(texts).to_pylist(), BLOCK_CHARS):
                for k, ids in zip(range(lo, hi), enc.encode(texts.slice(lo, hi - lo).to_pylist())):
                    packer.add(doc_ids[k], ids + end)
                    waiting += len(ids) // 4 + 1
                    if waiting >= block_tokens:
                        packer.pack(last=False)
                        waiting = 0
                        yield out()
        packer.pack(last=True)
        yield out()

    return rows.mapInArrow(run, SCHEMA)

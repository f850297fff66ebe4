"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are a text's words (A-Z lower-cased) and one end.

1. Token counts of all training texts (``counts``): texts are cut and hashed
   to 128 bits in numpy, straight from the Arrow buffers; partial counts in the
   tasks, one shuffle, written once.  They give the base model
   (c + 0.5) / (N + 0.5 * (V + 1)).
2. The model's symbols are the ``CLASSES * WIDTH - 1`` most frequent tokens, by
   rank in classes of ``WIDTH``, and one symbol for all other tokens, inside
   which the base model holds.  A token's probability is that of its class
   times that of its symbol inside the class; both are softmaxes over the base
   model's logarithms plus the weight rows of the active features: the token
   before (a bigram) and the one before that (a skip), each hashed to a row, and
   inside a class the same two with the class hashed in.  Without
   weights the model is the base model.
3. Training is gradient ascent in ``rounds``: in each, every ``rounds``-th
   training text (by hash) adds its observed and expected feature counts to a
   gradient per task (a bounded number of them), the gradients are summed block
   by block on Spark, and a row moves by the difference over the sum of both (a step bounded by its
   length).  So every training text is used once, and what a task holds and
   the driver gathers is the size of the weights, whatever the input.
4. Scoring is one pass over all texts in numpy batches.  The ``KNOWN`` most
   frequent tokens' counts travel with the job; all other words of a text are
   joined with the whole count table, so every count is exact.

A NULL or empty text has the end alone.  A word is known by its 128-bit hash,
whatever its length; a text is hashed whole, with 32 bytes of tables per byte of
the longest text.  A NULL doc_id teaches; repeated rows are scored (and teach) by
themselves.  Without training texts every base probability is 1 and so is the
model's.  An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, slices
from dunegrid.session import materialize

FOLDS, HELD_OUT_FOLD = 5, 1
CLASSES, WIDTH = 64, 64
OTHER = CLASSES * WIDTH - 1
#: Tokens whose counts every task holds.
KNOWN = 65_536
#: Bits of the hashed rows of a feature of classes and of a feature inside classes.
CLASS_BITS, WORD_BITS = 12, 13
SKIPS = 2
WORD_ROWS_AT = SKIPS << CLASS_BITS
ROWS = WORD_ROWS_AT + (SKIPS << WORD_BITS)
#: Weight rows of a block of the gradient.
BLOCK = 1024
#: Texts of a task's gradient, and most gradients of a round (each is of the
#: weights' size, so what their sum reads is bounded).
TEXTS_PER_GRADIENT, MOST_GRADIENTS = 8_000, 4_096
#: Tokens of a numpy batch, and batches whose probabilities are added up at once.
BATCH, TOGETHER = 4096, 32
#: Tokens whose partial counts a task holds before it adds them up, and gives them away.
HELD = 1 << 21
LN10 = math.log(10)
#: Bytes in lower case (A-Z only) plus 1, and whether they part words.
_LOWER = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in range(256)], np.uint64)
_PART = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def held_out(doc_id: str = "doc_id") -> Column:
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as texts went so far."""

    def __init__(self, base: int):
        self.base, self.n = base, 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, 1 << 20)
            self.tables = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                steps = np.full(self.n, b, np.uint64)
                steps[0] = 1
                self.tables.append(np.cumprod(steps, dtype=np.uint64))
        return self.tables[0], self.tables[1]


_POWERS = [_Powers(0x9E3779B97F4A7C15), _Powers(0xC2B2AE3D27D4EB4F)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[2]
    return x ^ (x >> np.uint64(29))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every token of some texts, and where texts begin.

    A word's hash is the polynomial of its bytes (from its own first byte on),
    taken from running sums over all bytes.  The end has the hashes 0, 0.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
    at = at - at[0]
    word = np.concatenate([~_PART[data], [False]])  # one beyond the last byte
    before = np.concatenate([[False], word[:-1]])
    before[at] = False  # a text begins
    first = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:], [False]])
    after[at[1:] - 1] = False  # a text ends (-1: the byte beyond the last, which is none)
    last = np.flatnonzero(word & ~after) + 1
    of_text = np.searchsorted(at[1:], first, side="right")
    n_words = np.bincount(of_text, minlength=len(texts))
    begin = np.concatenate([[0], np.cumsum(n_words + 1)])
    place = np.arange(len(first)) + of_text
    out = []
    low = _LOWER[data]
    for powers in _POWERS:
        up, down = powers.upto(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[:len(data)], dtype=np.uint64)])
        h = np.zeros(begin[-1], np.uint64)
        h[place] = _mix((sums[last] - sums[first]) * down[first])
        out.append(h)
    return out[0], out[1], begin[:-1]


def _added_up(h1: np.ndarray, h2: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal tokens' counts added up (a token may be left twice where hashes of 64 bits meet)."""
    order = np.argsort(h1)
    h1, h2 = h1[order], h2[order]
    at = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])[:len(h1)])
    return h1[at], h2[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def counts(texts: DataFrame) -> DataFrame:
    """h1, h2, n: all tokens of ``texts`` by their hashes, and how often they stand."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def together() -> tuple[np.ndarray, ...]:
            return _added_up(*(np.concatenate([h[k] for h in held]) for k in range(3)))

        def batch(found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found[0].view(np.int64)), pa.array(found[1].view(np.int64)),
                                               pa.array(found[2])], names=["h1", "h2", "n"])
        for b in batches:
            for part in _parts(b):
                h1, h2, _ = tokens(part.column("text"))
                held.append(_added_up(h1, h2, np.ones(len(h1), np.int64)))
                size += len(held[-1][0])
                if size >= 2 * HELD:
                    held = [together()]
                    size = len(held[0][0])
                    if size >= HELD:
                        yield batch(held[0])
                        held, size = [], 0
        if held:
            yield batch(together())

    return texts.select("text").mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


@dataclass
class Base:
    """Hashes and counts of the most frequent tokens in order, and the totals."""

    h1: np.ndarray
    h2: np.ndarray
    n: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        d = self.total + 0.5 * (self.distinct + 1)
        self.log = np.log10((self.n + 0.5) / d)
        inside = np.zeros(OTHER + 1)
        inside[:min(len(self.n), OTHER)] = self.n[:OTHER] + 0.5
        inside[OTHER] = max(0.5, d - inside.sum())
        self.log_d, self.log_other = math.log10(d), math.log10(inside[OTHER])
        inside = inside.reshape(CLASSES, WIDTH)
        total = inside.sum(axis=1)
        self.classes = (total / total.sum()).astype(np.float32)
        self.inside = (inside / np.maximum(total, 1e-300)[:, None]).astype(np.float32)
        self.order = np.argsort(self.h1)
        self.sorted = self.h1[self.order]

    def ranks(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Rank of every token, KNOWN for those that are not held."""
        if not len(self.n):
            return np.full(len(h1), KNOWN)
        at = self.order[np.minimum(np.searchsorted(self.sorted, h1), len(self.n) - 1)]
        return np.where((self.h1[at] == h1) & (self.h2[at] == h2), at, KNOWN)


def base_of(table: DataFrame) -> Base:
    """The base model of a count table (h1, h2, n)."""
    total, distinct = table.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # at most one token of a 64-bit hash, so that a search by it is enough
    top = table.orderBy(F.desc("n"), "h1", "h2").limit(KNOWN).dropDuplicates(["h1"]).collect()
    top.sort(key=lambda r: (-r["n"], r["h1"]))
    h1, h2, n = (np.array([r[k] for r in top], np.int64) for k in ("h1", "h2", "n"))
    return Base(h1.view(np.uint64), h2.view(np.uint64), n.astype(np.float64), total, distinct)


def _hashed(x: np.ndarray, bits: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _M[3]
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def skips_of(x: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Hashes of the token before and of the one before that (``x``: first
    hashes; 0 before a text, which begins at ``first``)."""
    one, two = np.zeros_like(x), np.zeros_like(x)
    one[1:], two[2:] = x[:-1], x[:-2]
    one[first] = two[first] = 0
    two[first[first + 1 < len(x)] + 1] = 0
    return [one * _M[0], two * _M[1]]


def class_rows(skips: list[np.ndarray]) -> list[np.ndarray]:
    """Weight rows of the features of classes."""
    return [_hashed(x, CLASS_BITS) + (k << CLASS_BITS) for k, x in enumerate(skips)]


def word_rows(skips: list[np.ndarray], of_class: np.ndarray) -> list[np.ndarray]:
    """Weight rows of the features inside a class."""
    c = (of_class.astype(np.uint64) + np.uint64(1)) * _M[2]
    return [_hashed(x + c, WORD_BITS) + WORD_ROWS_AT + (k << WORD_BITS) for k, x in enumerate(skips)]


def _parts(b: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
    for lo, hi in slices(b.num_rows, sizes, limit):
        yield b.slice(lo, hi - lo)


def _shares(prior: np.ndarray, factors: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """Softmax of the prior's logarithms plus the weights of the rows, as a product."""
    p = prior * np.take(factors, rows[0], axis=0)
    for r in rows[1:]:
        p *= np.take(factors, r, axis=0)
    p /= (p @ np.ones(p.shape[1], np.float32))[:, None]
    return p


def _batches(h1: np.ndarray, ranks: np.ndarray, first: np.ndarray, base: Base, factors: np.ndarray):
    """For every numpy batch: where it starts, the probabilities of classes and
    inside the true class, the feature rows and the true columns of both."""
    skips = skips_of(h1, first)
    symbol = np.minimum(ranks, OTHER)
    for lo in range(0, len(h1), BATCH):
        at = slice(lo, lo + BATCH)
        c, w = symbol[at] // WIDTH, symbol[at] % WIDTH
        here = [s[at] for s in skips]
        f, g = class_rows(here), word_rows(here, c)
        yield lo, _shares(base.classes, factors, f), _shares(np.take(base.inside, c, axis=0), factors, g), f, g, c, w


def _add_rows(to: np.ndarray, rows: np.ndarray, values: np.ndarray, often: int = 4) -> None:
    """to[rows] += values, rows repeated: a product with ones for rows that stand
    often, and for the others their first, second ... lines at once."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    rows, values = rows[order], np.take(values, order, axis=0)
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    n, rows = np.diff(np.append(starts, len(rows))), rows[starts]
    for k in range(often):
        at = (n > k) & (n <= often)
        to[rows[at]] += values[starts[at] + k]
    ones = np.ones(len(values), np.float32)
    at = n > often
    for r, s, k in zip(rows[at].tolist(), starts[at].tolist(), n[at].tolist()):
        to[r] += ones[:k] @ values[s:s + k]


class _Sums:
    """Observed and expected counts of every weight; probabilities are gathered
    for some batches, so that a row is added to once for many tokens."""

    def __init__(self):
        self.seen, self.hoped = (np.zeros((ROWS, WIDTH), np.float32) for _ in range(2))
        self.p = [np.empty((BATCH * TOGETHER, n), np.float32) for n in (CLASSES, WIDTH)]
        self.rows: list[list[tuple]] = []
        self.n = 0

    def add(self, p: np.ndarray, q: np.ndarray, f: list, g: list, c: np.ndarray, w: np.ndarray) -> None:
        flat = self.seen.reshape(-1)
        for rows, y in ((f, c), (g, w)):
            for r in rows:
                np.add.at(flat, r * WIDTH + y, np.float32(1))
        for to, x in zip(self.p, (p, q)):
            to[self.n:self.n + len(c)] = x
        self.rows.append((f, g))
        self.n += len(c)
        if self.n > BATCH * (TOGETHER - 1):
            self.flush()

    def flush(self) -> None:
        for part in range(2 if self.n else 0):
            for k in range(SKIPS):
                _add_rows(self.hoped, np.concatenate([r[part][k] for r in self.rows]), self.p[part][:self.n])
        self.rows, self.n = [], 0


def gradient(docs: DataFrame, base: Base, weights: np.ndarray, rows: int, smooth: float) -> np.ndarray:
    """Step of every weight from the observed and expected counts over ``docs``."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast((base, weights))
    schema = "block int, seen binary, hoped binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, weights = sent.value
        factors = np.exp(weights)
        sums, any_rows = _Sums(), False
        for b in batches:
            for part in _parts(b):
                any_rows = True
                h1, h2, first = tokens(part.column("text"))
                for _, *batch in _batches(h1, base.ranks(h1, h2), first, base, factors):
                    sums.add(*batch)
        sums.flush()
        seen, hoped = sums.seen, sums.hoped
        for k in range(0, ROWS if any_rows else 0, BLOCK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([seen[k:k + BLOCK].tobytes()], pa.binary()),
                 pa.array([hoped[k:k + BLOCK].tobytes()], pa.binary())], names=["block", "seen", "hoped"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for k, *values in zip(*(b.column(i) for i in range(3))):
                both = sums.setdefault(k.as_py(), [np.zeros(BLOCK * WIDTH) for _ in range(2)])
                for s, v in zip(both, values):
                    s += np.frombuffer(v.as_buffer(), np.float32)
        for k, (s, h) in sums.items():
            step = ((s - h) / (s + h + smooth)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([step.tobytes()], pa.binary())],
                                             names=["block", "step"])

    tasks = min(MOST_GRADIENTS, max(1, -(-rows // TEXTS_PER_GRADIENT)))
    parts = docs.select("text").coalesce(tasks).mapInArrow(run, schema)
    steps = parts.repartition(ROWS // BLOCK, "block").mapInArrow(total, "block int, step binary")
    out = np.zeros_like(weights)
    for r in steps.collect():  # the size of the weights
        out[r["block"]:r["block"] + BLOCK] = np.frombuffer(r["step"], np.float32).reshape(BLOCK, WIDTH)
    sent.unpersist()
    return out


def train(docs: DataFrame, base: Base, rows: int, rounds: int = 3, rate: float = 1.2, smooth: float = 4.0) -> np.ndarray:
    """Weights after ``rounds`` gradient steps, each over its own part of ``docs`` (``rows`` rows)."""
    weights = np.zeros((ROWS, WIDTH), np.float32)
    turn = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(rounds))
    for k in range(rounds if rows else 0):
        weights += rate * gradient(docs.filter(turn == k), base, weights, -(-rows // rounds), smooth)
    return weights


def _rare(h1: np.ndarray, h2: np.ndarray, row: np.ndarray, rows: int) -> pa.Array:
    """Lists of (h1, h2, times) of the tokens of every row (``row``, ascending)."""
    order = np.lexsort((h2, h1, row))
    h1, h2, row = h1[order], h2[order], row[order]
    new = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(np.concatenate([[True], new])[:len(h1)])
    times = np.diff(np.append(at, len(h1)))
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[at], minlength=rows))])
    structs = pa.StructArray.from_arrays([pa.array(h1[at].view(np.int64)), pa.array(h2[at].view(np.int64)),
                                          pa.array(times)], ["h1", "h2", "times"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)


def _row_scores(docs: DataFrame, base: Base, weights: np.ndarray) -> DataFrame:
    """What the tasks know of every row: n_tokens, n_known, base, score without
    the share of rare tokens, which are listed (h1, h2, times)."""
    sent = docs.sparkSession.sparkContext.broadcast((base, weights))
    schema = ("doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, "
              "rare array<struct<h1: long, h2: long, times: long>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, weights = sent.value
        factors = np.exp(weights)
        # logarithm of a known token in the base model (beyond: 0) and inside the symbol for others
        logs = np.append(base.log, 0.0)
        inside = np.append(base.log + (base.log_d - base.log_other), 0.0)
        inside[:min(OTHER, len(base.n))] = 0.0
        for b in batches:
            for part in _parts(b):
                h1, h2, first = tokens(part.column("text"))
                ranks = base.ranks(h1, h2)
                known = ranks < KNOWN
                at = np.minimum(ranks, len(base.n))
                score = inside[at]
                for lo, p, q, _, _, c, w in _batches(h1, ranks, first, base, factors):
                    n = np.arange(len(c))
                    score[lo:lo + BATCH] += np.log10(p[n, c].astype(np.float64) * q[n, w])
                row = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h1))))[~known]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(np.diff(np.append(first, len(h1)))),
                     pa.array(np.add.reduceat(known.astype(np.int64), first)),
                     pa.array(np.add.reduceat(logs[at], first)), pa.array(np.add.reduceat(score, first)),
                     _rare(h1[~known], h2[~known], row, len(first))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])

    rows = docs.select("doc_id", "held_out", "text").mapInArrow(run, schema)
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "maxent-rows")


def scores(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    training = docs.filter("not held_out")
    n = training.count()
    table = materialize(counts(training), "maxent-counts")
    base = base_of(table)
    weights = train(training, base, n, **options)
    rows = _row_scores(docs, base, weights)

    d = base.total + 0.5 * (base.distinct + 1)
    rare = rows.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(table, ["h1", "h2"], "left")
    log = F.log10((F.coalesce("n", F.lit(0)) + 0.5) / F.lit(d))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * log).alias("log"), F.sum("times").alias("times"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("seen"))
    none = F.lit(0)
    return rows.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("seen", none)).alias("n_known"),
        F.lit(base.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("log", none)).alias("base_score"),
        (F.col("score") + F.coalesce("log", none)
         + F.coalesce("times", none) * F.lit(base.log_d - base.log_other)).alias("score"))

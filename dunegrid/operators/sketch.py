"""A mergeable quantile summary: one pass, bounded state, a rank-error bound beside it.

A summary is a sorted list of values with weights and ``bound``, how far the
number of values at or below any point may be from what the summary says.  Exact
counts of distinct values have bound 0.  ``shrink`` keeps at most ``size``
values: neighbours are joined into their largest value while their weight stays
below a share of the total, and the bound grows by the most weight that moved.
Merging adds weights and bounds.

A task keeps one summary per power of two of batches (a binary counter), so a
value is shrunk a logarithmic number of times; then the tasks' summaries are
merged up a tree, ``fan`` at a time, each merge a bounded group.  Every value
costs one look; what is shuffled is at most ``size`` values per task.

NULL and NaN are no values.  An empty column gives n = 0 and no percentiles.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.session import ensure_on_executors, materialize

Summary = tuple[np.ndarray, np.ndarray, int]  # values, weights, bound
SCHEMA = "part long, n long, bound long, values array<double>, weights array<long>"


def exact(values: np.ndarray) -> Summary:
    v, w = np.unique(values, return_counts=True)
    return v, w.astype(np.int64), 0


def merged(parts: Sequence[Summary]) -> Summary:
    v, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    w = np.zeros(len(v), np.int64)
    np.add.at(w, at, np.concatenate([p[1] for p in parts]))
    return v, w, sum(p[2] for p in parts)


def shrink(s: Summary, size: int) -> Summary:
    """At most ``size`` values (a value heavier than its share stays as it is)."""
    v, w, bound = s
    if len(v) <= size:
        return s
    upto = np.cumsum(w)
    # values whose running weights end in one cell of 2 / size of the total are
    # joined; a cell is at most that wide, or holds one value
    cell = (upto * (size // 2)) // max(1, int(upto[-1]))
    last = np.concatenate([cell[1:] != cell[:-1], [True]])
    total = np.diff(np.concatenate([[0], upto[last]]))
    return v[last], total, bound + int((total - w[last]).max())


def summaries(df: DataFrame, col: str, size: int) -> DataFrame:
    """One summary row (SCHEMA) per task."""
    ensure_on_executors(df.sparkSession)
    value = F.col(col).cast("double")
    rows = df.select(value.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Summary | None] = []  # summary k is of 2**k batches
        for b in batches:
            if not b.num_rows:
                continue
            s, k = shrink(exact(b.column("v").to_numpy()), size), 0
            while k < len(held) and held[k] is not None:
                s, held[k] = shrink(merged([held[k], s]), size), None
                k += 1
            if k == len(held):
                held.append(None)
            held[k] = s
        left = [s for s in held if s is not None]
        if left:
            yield _row(0, shrink(merged(left), size))

    return rows.mapInArrow(run, SCHEMA).withColumn("part", F.spark_partition_id().cast("long"))


def _row(part: int, s: Summary) -> pa.RecordBatch:
    v, w, bound = s
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int64()), pa.array([int(w.sum())], pa.int64()), pa.array([bound], pa.int64()),
         pa.array([v], pa.list_(pa.float64())), pa.array([w], pa.list_(pa.int64()))],
        names=["part", "n", "bound", "values", "weights"])


def quantile_sketch(df: DataFrame, col: str, size: int = 4096, fan: int = 16) -> DataFrame:
    """The column's summary, one row: n, bound, values, weights (no row if it has no value)."""
    def merge(t: pa.Table) -> pa.Table:
        parts = [(np.array(v), np.array(w, np.int64), b) for v, w, b in zip(
            t.column("values").to_pylist(), t.column("weights").to_pylist(), t.column("bound").to_pylist())]
        return pa.Table.from_batches([_row(t.column("part")[0].as_py(), shrink(merged(parts), size))])

    level = materialize(summaries(df, col, size), "sketch")
    while level.count() > 1:
        level = level.withColumn("part", F.floor(F.col("part") / fan))
        level = materialize(level.groupBy("part").applyInArrow(merge, SCHEMA), "sketch")
    return level.drop("part")


def sketch_percentiles(sketch: DataFrame, probs: Sequence[float]) -> DataFrame:
    """(p, value, n, bound) per prob: the least value that the summary puts at
    or above rank p * n; its true ranks meet [p * n - bound, p * n + bound]."""
    rank = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p")
    rows = sketch.select("n", "bound", F.arrays_zip("values", "weights").alias("entries"), rank)
    found = F.aggregate(
        "entries", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("value")),
        lambda s, e: F.struct((s["seen"] + e["weights"]).alias("seen"),
                              F.coalesce(s["value"], F.when(s["seen"] + e["weights"] >= F.greatest(
                                  F.lit(1.0), F.col("p") * F.col("n")), e["values"])).alias("value")))
    return rows.select("p", found["value"].alias("value"), "n", "bound")

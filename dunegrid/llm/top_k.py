"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are ordered by length (norm) and cut into buckets of ``bucket_rows``
rows of nearly equal length.  Queries travel in blocks.

Buckets stay where they are: consecutive buckets form a group of ``group_rows``
rows, and a task holds one group at a time while query blocks (queries of nearly
equal length) stream past it.  The number of partitions follows the rows held
and sent, not the pairs of blocks and buckets.

1. Each query block meets the bucket of the longest vectors; the k-th best
   score there is a lower bound theta for the query's final k-th score.
2. A block goes to the groups that its thetas do not rule out.  There it meets
   the buckets in descending length.  In a bucket whose longest vector has
   length l, a partner of query q needs a cosine of at least theta / (|q| l), the
   local threshold.  Above 1 the query is done with the group, as all further
   buckets are shorter.  A high local threshold selects *coordinate* pruning: on
   the query's largest coordinates a partner's unit vector must lie in a narrow
   range.  A low one selects *length* pruning: only the bucket's prefix of vectors
   that are long enough is kept.  Survivors are verified by their integer
   product, and theta rises to the k-th best score the query has found in the
   group so far.
3. A query's survivors of all groups (at most k per group) are ranked.

Bounds are loosened by a relative 1e-9 against rounding, products are exact
integers (double products below 2^53, Python integers beyond; scores stop at
the ends of the long range).

Vectors that are NULL or hold NULL or non-finite components take no part.
Repeated rows (same vec_id and components) count once; rows that share the
query's vec_id are never its partners; vectors of another dimension are no
partners; an empty table or a table of one row gives no rows.  Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare
from dunegrid.operators.ordering import with_position
from dunegrid.session import materialize

SLACK = 1e-9
FOCUS = 4
#: Local cosine threshold from which coordinate pruning is chosen.
COORDINATE_FROM = 0.35


def scaled(col: str, factor: int = 256) -> Column:
    """floor(factor * x) of every component; NULL unless all are finite."""
    bad = F.exists(F.col(col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(F.col(col).isNotNull() & ~bad,
                  F.transform(F.col(col), lambda x: F.floor(x.cast("double") * factor).cast("long")))


def products(rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact integer products of each row with q, within the long range."""
    if not rows.size:
        return np.zeros(len(rows), np.int64)
    if float(np.abs(rows).max()) * float(np.abs(q).max()) * rows.shape[1] < 2**53:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(r, q)) for r in rows]
    return np.array([min(max(s, -2**63), 2**63 - 1) for s in exact], np.int64)


def candidates(unit: np.ndarray, norms: np.ndarray, qu: np.ndarray, qn: float, theta: float) -> np.ndarray:
    """Rows of a bucket (unit vectors and lengths, longest first) that may
    reach the product ``theta`` with the query of direction ``qu`` and length ``qn``."""
    if not np.isfinite(theta) or theta <= 0:
        return np.arange(len(norms))
    if qn == 0 or not len(norms) or norms[0] == 0:
        return np.zeros(0, np.int64)
    local = theta / (qn * norms[0]) * (1 - SLACK)
    if local > 1:
        return np.zeros(0, np.int64)
    long_enough = int(np.searchsorted(-norms, -theta / qn * (1 - SLACK), side="right"))
    if local < COORDINATE_FROM or unit.shape[1] == 0:
        return np.arange(long_enough)
    keep = np.ones(long_enough, bool)
    for f in np.argsort(-np.abs(qu))[:FOCUS]:
        mid = qu[f] * local
        wide = np.sqrt(max(0.0, (1 - local**2) * (1 - qu[f]**2))) + SLACK
        # a partner may have a larger cosine than the local one: its range widens towards the query
        low, high = mid - wide, mid + wide
        if qu[f] >= local:
            high = 1.0
        if -qu[f] >= local:
            low = -1.0
        keep &= (unit[:long_enough, f] >= low - SLACK) & (unit[:long_enough, f] <= high + SLACK)
    return np.flatnonzero(keep)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def _blob_schema(kind: str) -> str:
    return f"dim int, {kind} long, n int, ids binary, cells binary, longest double"


def _pack(kind: str):
    def run(t: pa.Table) -> pa.Table:
        ids = t.column("vec_id").to_numpy()
        dim = t.column("dim")[0].as_py()
        cells = t.column("cells").combine_chunks()
        flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(ids), dim)
        norm = t.column("norm").to_numpy()
        order = np.lexsort((ids, -norm))
        return pa.table({"dim": pa.array([dim], pa.int32()), kind: t.column(kind).slice(0, 1).cast(pa.int64()),
                         "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([ids[order].tobytes()]),
                         "cells": pa.array([flat[order].tobytes()]), "longest": pa.array([float(norm.max())])})
    return run


@dataclass
class Rows:
    """Vectors of a bucket or block, longest first: ids, integer cells, directions, lengths."""

    ids: np.ndarray
    cells: np.ndarray
    unit: np.ndarray
    norms: np.ndarray
    exact: bool

    @classmethod
    def of(cls, ids: bytes, cells: bytes, dim: int) -> Rows:
        i = np.frombuffer(ids, np.int64)
        c = np.frombuffer(cells, np.int64).reshape(len(i), dim)
        f = c.astype(np.float64)
        norms = np.sqrt((f * f).sum(axis=1))
        exact = not c.size or float(np.abs(f).max()) ** 2 * max(1, dim) < 2**52  # doubles hold products of such rows
        return cls(i, f if exact else c, f / np.where(norms > 0, norms, 1.0)[:, None], norms, exact)


def search(queries: Rows, buckets: list[Rows], theta: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(query position, partner ids, scores, buckets searched): each query's
    best in buckets of descending length, theta rising from bucket to bucket."""
    for j in range(len(queries.ids)):
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bound, searched = float(theta[j]), 0
        for b in buckets:
            if bound > 0 and np.isfinite(bound) and queries.norms[j] * b.norms[0] < bound * (1 - SLACK):
                break  # no vector of this bucket or a later one is long enough
            searched += 1
            at = candidates(b.unit, b.norms, queries.unit[j], float(queries.norms[j]), bound)
            at = at[b.ids[at] != queries.ids[j]]
            if queries.exact and b.exact:
                s = (b.cells[at] @ queries.cells[j]).astype(np.int64)
            else:
                s = products(b.cells[at].astype(np.int64), queries.cells[j].astype(np.int64))
            good = s >= bound if np.isfinite(bound) else np.ones(len(at), bool)
            ids, scores = np.concatenate([ids, b.ids[at][good]]), np.concatenate([scores, s[good]])
            top = best(ids, scores, k)
            ids, scores = ids[top], scores[top]
            if len(scores) == k:
                bound = max(bound, float(scores[-1]))
        yield j, ids, scores, searched


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding",
          bucket_rows: int = 4096, block_rows: int = 256, group_rows: int = 32_768, blocks_per_task: int = 4) -> DataFrame:
    """query_id, rank, vec_id, score for every query row (id divisible by ``query_every``)."""
    found = survivors(vectors, k, query_every, id_col, vec_col, bucket_rows, block_rows, group_rows, blocks_per_task)
    # 3. at most k rows per query and group are ranked
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.filter("vec_id IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def survivors(vectors: DataFrame, k: int, query_every: int, id_col: str, vec_col: str, bucket_rows: int,
              block_rows: int, group_rows: int, blocks_per_task: int) -> DataFrame:
    """query_id, vec_id, score of at most k partners per query and group of
    buckets, and ``searched``: the buckets searched (a row without vec_id where none was found)."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), scaled(vec_col).alias("cells"))
            .filter(F.col("cells").isNotNull() & F.col("vec_id").isNotNull()).dropDuplicates(["vec_id", "cells"])
            .withColumn("dim", F.size("cells"))
            .withColumn("norm", F.sqrt(F.aggregate("cells", F.lit(0.0), lambda s, x: s + x.cast("double") * x))))
    rows = with_position(rows, [F.col("dim"), F.col("norm").desc(), F.col("vec_id")])
    rows = materialize(rows.withColumn("bucket", F.floor((F.col("pos") - 1) / bucket_rows)), "top-k-rows")
    buckets = materialize(rows.groupBy("dim", "bucket").applyInArrow(_pack("bucket"), _blob_schema("bucket")),
                          "top-k-buckets")
    # queries by length, so that a block's longest says something about all of it
    queries = with_position(rows.filter(F.col("vec_id") % query_every == 0).drop("pos", "bucket"),
                            [F.col("dim"), F.col("norm").desc(), F.col("vec_id")])
    blocks = (queries.withColumn("block", F.floor((F.col("pos") - 1) / block_rows))
              .groupBy("dim", "block").applyInArrow(_pack("block"), _blob_schema("block"))
              .select("dim", "block", F.col("ids").alias("q_ids"), F.col("cells").alias("q_cells"),
                      F.col("longest").alias("q_longest")))
    blocks = materialize(blocks, "top-k-blocks")

    # 1. theta from the bucket of the longest vectors of each dimension
    first = buckets.groupBy("dim").agg(F.min("bucket").alias("bucket"))
    seeds = buckets.join(first, ["dim", "bucket"]).drop("longest", "n")

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            asked = Rows.of(r["q_ids"], r["q_cells"], r["dim"])
            theta = np.full(len(asked.ids), -np.inf)
            for j, _, scores, _ in search(asked, [Rows.of(r["ids"], r["cells"], r["dim"])], theta.copy(), k):
                if len(scores) == k:
                    theta[j] = scores[-1]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r["dim"]], pa.int32()), pa.array([r["block"]], pa.int64()), pa.array([theta.tobytes()]),
                 pa.array([float(theta.min())])], names=["dim", "block", "theta", "least"])

    thetas = materialize(blocks.drop("q_longest").join(seeds, "dim").mapInArrow(
        bound, "dim int, block long, theta binary, least double"), "top-k-theta")

    # 2. blocks go to the groups of buckets that some query of theirs cannot rule out
    per_group = max(1, group_rows // bucket_rows)
    grouped = buckets.withColumn("group", F.floor(F.col("bucket") / per_group))
    longest = grouped.groupBy("dim", "group").agg(F.max("longest").alias("longest"))
    sized = blocks.join(thetas, ["dim", "block"]).withColumn("task", F.floor(F.col("block") / blocks_per_task))
    sent = sized.join(longest, "dim").filter(
        F.col("least") <= F.col("q_longest") * F.col("longest") * (1 + 1e-6)).select(
            "dim", "group", "task", F.lit(1).alias("kind"), F.col("block").alias("number"), F.col("q_ids").alias("ids"),
            F.col("q_cells").alias("cells"), "theta")
    held = grouped.join(sent.select("dim", "group", "task").distinct(), ["dim", "group"]).select(
        "dim", "group", "task", F.lit(0).alias("kind"), F.col("bucket").alias("number"), "ids", "cells",
        F.lit(None).cast("binary").alias("theta"))
    n_vectors, n_queries = rows.count(), queries.count()
    tasks = -(-n_vectors // group_rows) * -(-n_queries // (block_rows * blocks_per_task))
    parts = max(1, min(tasks, 2 * spark.sparkContext.defaultParallelism + n_vectors // group_rows))
    work = sent.unionByName(held).repartition(parts, "dim", "group", "task").sortWithinPartitions(
        "dim", "group", "task", "kind", "number")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for r in (b.slice(i, 1).to_pylist()[0] for b in batches for i in range(b.num_rows)):
            if (r["dim"], r["group"], r["task"]) != at:
                at, held = (r["dim"], r["group"], r["task"]), []
            if not r["kind"]:  # buckets come first, longest vectors first
                held.append(Rows.of(r["ids"], r["cells"], r["dim"]))
                continue
            asked = Rows.of(r["ids"], r["cells"], r["dim"])
            found = list(search(asked, held, np.frombuffer(r["theta"], np.float64), k))
            size = [max(1, len(ids)) for _, ids, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked.ids[[j for j, *_ in found]], size)),
                 pa.array([i for _, ids, _, _ in found for i in (ids.tolist() or [None])], pa.int64()),
                 pa.array([s for _, _, scores, _ in found for s in (scores.tolist() or [None])], pa.int64()),
                 pa.array(np.repeat([n for *_, n in found], size), pa.int64())],
                names=["query_id", "vec_id", "score", "searched"])

    return work.mapInArrow(run, "query_id long, vec_id long, score long, searched long")

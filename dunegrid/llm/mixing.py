"""Mixing sources to target weights by cube-method balanced sampling.

A source's target divided by its size is how often its documents are taken on
average: the whole part is taken for certain, the fraction is each document's
inclusion probability.  The cube method turns those probabilities into 0 or 1
while it keeps two totals of the source, tokens and documents:

* Flight: three documents with open probabilities are moved along the null
  space of the two balancing equations until one of them is decided.  It runs
  in blocks of about ``block`` documents (a source of any size is many blocks,
  in parallel) and leaves at most ``landing`` open documents per block; those
  meet in blocks of the next level until one block per source is left.
* Landing: the last open documents are decided by trying every combination for
  the smallest deviation in tokens, then in documents.

Draws come from hashes of the document and a seed, so reruns agree whatever the
partitioning.  Repeated rows (same doc_id, source and size) are decided
together; a NULL text has no words; a NULL source is a source of its own, the
last; a NULL doc_id is an id like any other.  Documents without words are never
taken into account for tokens and take 0.  An empty table gives no rows.  Other
columns are not read by ``decide`` and are kept by ``mix``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.llm.common import prepare, word_count
from dunegrid.operators.ordering import with_position
from dunegrid.session import materialize

EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   most: float = 2.0) -> DataFrame:
    """source, source_size, target from rows (source, size, copies).

    Weights are dealt to sources in code-point order (NULL last).  ``share``
    times all sizes is split by weight; a target above ``most`` times its
    source's size stops there and the excess is split anew by weight among the
    others, until none is above.  One row per source; only sums reach the
    driver.
    """
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"),
                                          F.count(F.lit(1)).alias("units"))
    sources = with_position(sources, [F.col("source").asc_nulls_last()], pos_col="nth")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "mix-sources")
    cap = F.col("source_size") * F.lit(float(most))
    total, heavy = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    rate, capped = (share * total / heavy if total else 0.0), -1
    while total:
        above = cap <= F.col("weight") * F.lit(rate) * (1 + 1e-12)
        n, held, weight_held = sources.filter(above).agg(
            F.count(F.lit(1)), F.sum(cap), F.sum("weight")).first()
        if n == capped or weight_held == heavy:
            break
        capped = n
        if n:
            rate = (share * total - held) / (heavy - weight_held)
    return sources.select("source", "units", "source_size",
                          F.least(cap, F.col("weight") * F.lit(rate)).alias("target"))


def flight(p: np.ndarray, x: np.ndarray, m: np.ndarray, rng: np.random.Generator, leave: int) -> None:
    """Decide all but ``leave`` (at least 2) of the open probabilities in
    place; sums of p * x and p * m stay as they are."""
    todo = [int(i) for i in np.flatnonzero((p > EPS) & (p < 1 - EPS))]
    todo.reverse()
    draws = iter(rng.random(len(todo) + 1).tolist())
    px, xs, ms = p.tolist(), x.tolist(), m.tolist()
    team: list[int] = []
    while len(team) + len(todo) > max(leave, 2):
        while len(team) < 3:
            team.append(todo.pop())
        a, b, c = team
        u = (xs[b] * ms[c] - xs[c] * ms[b], xs[c] * ms[a] - xs[a] * ms[c], xs[a] * ms[b] - xs[b] * ms[a])
        if not any(u):  # tokens in proportion to documents: one equation
            u = (ms[b], -ms[a], 0.0)
        up = min((1 - px[i]) / v if v > 0 else px[i] / -v for i, v in zip(team, u) if v)
        down = min(px[i] / v if v > 0 else (1 - px[i]) / -v for i, v in zip(team, u) if v)
        step = up if next(draws) * (up + down) < down else -down
        for i, v in zip(team, u):
            px[i] += step * v
            if px[i] < EPS:
                px[i] = 0.0
            elif px[i] > 1 - EPS:
                px[i] = 1.0
        team = [i for i in team if 0.0 < px[i] < 1.0]
    p[:] = px


def land(p: np.ndarray, x: np.ndarray, m: np.ndarray) -> None:
    """Decide the open probabilities for the least deviation of p * x, then p * m."""
    at = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    if not len(at):
        return
    picks = ((np.arange(1 << len(at))[:, None] >> np.arange(len(at))) & 1).astype(float)
    off_x = np.abs((picks - p[at]) @ x[at]) / max(1.0, float(x[at].mean()))
    off_m = np.abs((picks - p[at]) @ m[at]) / max(1.0, float(m[at].mean()))
    p[at] = picks[int(np.argmin(off_x + 0.01 * off_m))]


def decide(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
           seed: int = 11, block: int = 4096, landing: int = 12) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, times
    (how often the mix takes the document)."""
    spark = docs.sparkSession
    prepare(spark)
    units = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                    F.col("source").cast("string").alias("source"), word_count().alias("size"))
                        .groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("copies")), "mix-units")
    targets = source_targets(units, weights, share, most).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    open_units = (units.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
                  .withColumn("whole", F.floor(rate + EPS).cast("long"))
                  .withColumn("p", F.greatest(F.lit(0.0), rate - F.col("whole")))
                  .withColumn("hash", F.xxhash64(F.lit(seed), "doc_id", "source", "size")))
    schema = ("doc_id long, source string, size long, copies long, units long, source_size long, "
              "target double, whole long, p double, hash long")
    names = [f.split()[0] for f in schema.split(", ")]

    def fly(t: pa.Table) -> pa.Table:
        t = t.sort_by([("hash", "ascending"), ("doc_id", "ascending"), ("size", "ascending")])
        m = t.column("copies").to_numpy().astype(float)
        x = t.column("size").to_numpy().astype(float) * m
        p = t.column("p").to_numpy().copy()
        rng = np.random.default_rng([seed, t.num_rows, t.column("hash")[0].as_py() & (2**63 - 1)])
        flight(p, x, m, rng, landing)
        if t.column("blocks")[0].as_py() == 1:
            land(p, x, m)
        return t.select(names).set_column(names.index("p"), "p", pa.array(p))

    decided, level = [], 0
    open_units = open_units.select(*names)
    while True:
        blocks = F.ceil(F.col("units") / F.lit(float(block)))
        now = (open_units.withColumn("blocks", blocks)
               .withColumn("part", F.pmod(F.xxhash64(F.col("hash"), F.lit(level)), blocks)))
        done = materialize(now.groupBy("source", "part").applyInArrow(fly, schema), "mix-flight")
        still = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
        decided.append(done.filter(~still))
        open_units = done.filter(still)
        # a source's open units of the next level: at most `landing` per block of this one
        open_units = open_units.withColumn("units", F.when(F.col("units") <= block, F.lit(1)).otherwise(
            F.ceil(F.col("units") / F.lit(float(block))) * landing)).select(*names)
        level += 1
        if open_units.isEmpty():
            break
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    return (out.withColumn("times", F.col("whole") + F.round("p").cast("long"))
            .withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("doc_id", "source", "size", "source_size", "target", "times"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixture itself: every document row as often as ``decide`` takes it,
    with the columns of ``docs``."""
    times = decide(docs, **options).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"),
        F.col("times").alias("_times")).filter("_times > 0").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_d"),
                       F.col("source").cast("string").alias("_s"), word_count().alias("_n"))
    both = rows.join(times, F.col("_d").eqNullSafe(F.col("_id")) & F.col("_s").eqNullSafe(F.col("_source"))
                     & (F.col("_n") == F.col("_size")))
    return both.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("row.*")

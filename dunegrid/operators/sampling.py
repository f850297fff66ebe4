"""Reproducible sampling, ordering and splitting.

All draws come from an md5 of ``seed:key`` so that they are reproducible,
independent of partitioning, and the same in any SQL engine with ``md5``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.operators.ordering import with_position


def _key_text(cols: Sequence[str]) -> Column:
    return F.concat_ws(",", *[F.col(c).cast("string") for c in cols])


def hash_key(seed: int, cols: Sequence[str]) -> Column:
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), _key_text(cols)))


def hash_unit(seed: int, cols: Sequence[str]) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of md5(seed:key)."""
    h = F.conv(F.substring(hash_key(seed, cols), 1, 8), 16, 10).cast("long")
    return h / F.lit(4294967296.0)


def sample_exact(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 7) -> DataFrame:
    """Exactly ``n`` distinct rows, without repeats (the first n in hash order).

    Rows whose hash is far above the n-th are left out by a plain filter (six
    standard deviations above n / N of the hash range; all rows are used should
    that ever leave too few), the others get their position in hash order and
    the first n stay, so no task gathers the sample.  ``n`` larger than the
    number of rows is an error.
    """
    total = df.count()
    if n > total:
        raise ValueError("sample size exceeds the number of rows")
    keyed = df.withColumn("_h", hash_key(seed, key_cols))
    near = (n + 6 * math.sqrt(n) + 10) / max(1, total)
    if near < 1:
        some = keyed.filter(hash_unit(seed, key_cols) <= near)
        keyed = some if some.count() >= n else keyed
    return with_position(keyed, ["_h", *key_cols], pos_col="_pos").filter(F.col("_pos") <= n).drop("_h", "_pos")


def dense_ids(df: DataFrame, order_cols: Sequence[str], id_col: str = "id") -> DataFrame:
    """0-based dense row ids in ``order_cols`` order (distributed, no global window)."""
    return with_position(df, order_cols, pos_col="_pos").withColumn(
        id_col, F.col("_pos") - 1).drop("_pos")


def sample_with_repeats(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 7) -> DataFrame:
    """Exactly ``n`` draws with replacement: draw j picks row id
    ``h(seed:j) mod N`` (ids dense in key order).  The draws table comes from
    ``spark.range`` and is joined to the ids, so both sides stay distributed.
    """
    spark = df.sparkSession
    ided = dense_ids(df, key_cols)
    total = ided.select(F.max("id")).scalar() + 1
    draws = spark.range(n).select(F.col("id").alias("draw"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{int(seed)}:"), F.col("draw").cast("string"))), 1, 15),
               16, 10).cast("long")
    draws = draws.withColumn("id", F.pmod(h, total))
    return draws.join(ided, "id").drop("id")


def random_split(df: DataFrame, weights: Sequence[float], key_cols: Sequence[str], seed: int = 7,
                 labels: Sequence[str] | None = None, out: str = "split") -> DataFrame:
    """Reproducible split: label by where the hash unit falls in the cumulative weights."""
    total = float(sum(weights))
    labels = list(labels or [str(i) for i in range(len(weights))])
    u = hash_unit(seed, key_cols)
    expr = F.lit(labels[-1])
    acc = 0.0
    bounds = []
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc)
    for b, lab in reversed(list(zip(bounds, labels))):
        expr = F.when(u < F.lit(b), F.lit(lab)).otherwise(expr)
    return df.withColumn(out, expr)


def value_ranks(df: DataFrame, col: str) -> DataFrame:
    """Distinct data values in ascending order with their 1-based rank."""
    vals = df.filter(F.col(col).isNotNull()).select(F.col(col).alias("value")).distinct()
    return with_position(vals, ["value"], pos_col="rank")

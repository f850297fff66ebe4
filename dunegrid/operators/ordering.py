"""Global order, positions and running sums without a single-partition window.

``row_number() OVER (ORDER BY ...)`` with no partition moves every row into
one task.  Here Spark range-sorts the rows, each sorted partition numbers its
rows and keeps running sums in one Arrow pass, and that result is *written
once* together with the partition's number.  The offsets (one row per
partition) come from the written table, so rows and offsets always describe
the same partitions: nothing depends on an exchange being reused or on two
sorts choosing the same bounds.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.session import ensure_on_executors, materialize

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def with_position(df: DataFrame, order_cols: Sequence[str], sum_cols: Sequence[str] = (),
                  pos_col: str = "pos") -> DataFrame:
    """Add a 1-based global position (``pos_col``) in ``order_cols`` order and,
    for each column in ``sum_cols``, an inclusive running sum ``cum_<col>``
    (long for integer columns, else double; NULL counts as 0).

    The rows are written once under the checkpoint folder, so keep wide
    columns out of ``df`` when only their order is wanted.  Ties in
    ``order_cols`` get distinct, arbitrary positions; use a unique order key
    where positions must be reproducible.
    """
    spark = df.sparkSession
    ensure_on_executors(spark)
    sum_cols = list(sum_cols)
    whole = {c: isinstance(df.schema[c].dataType, _INTEGRAL) for c in sum_cols}
    ordered = df.orderBy(*order_cols).withColumn("_pid", F.spark_partition_id())

    out_schema = T.StructType(
        list(ordered.schema.fields) + [T.StructField("_lpos", T.LongType())]
        + [T.StructField(f"_lcum_{c}", T.LongType() if whole[c] else T.DoubleType()) for c in sum_cols])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        acc = {c: 0 if whole[c] else 0.0 for c in sum_cols}
        for b in batches:
            k = b.num_rows
            arrays = list(b.columns) + [pa.array(np.arange(n + 1, n + k + 1, dtype=np.int64))]
            names = list(b.schema.names) + ["_lpos"]
            n += k
            for c in sum_cols:
                kind = np.int64 if whole[c] else np.float64
                vals = b.column(b.schema.get_field_index(c)).to_pandas().fillna(0).to_numpy().astype(kind)
                cs = np.cumsum(vals) + acc[c]
                if k:
                    acc[c] = cs[-1]
                arrays.append(pa.array(cs))
                names.append(f"_lcum_{c}")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    stored = materialize(ordered.mapInArrow(local, out_schema), "positions")
    totals = stored.groupBy("_pid").agg(
        F.max("_lpos").alias("_n"), *[F.max_by(f"_lcum_{c}", "_lpos").alias(f"_s_{c}") for c in sum_cols])
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "_pid",
        F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("long").alias("_off_n"),
        *[F.coalesce(F.sum(f"_s_{c}").over(w), F.lit(0)).alias(f"_off_{c}") for c in sum_cols])
    joined = stored.join(F.broadcast(offsets), "_pid")
    cols = [F.col(c) for c in df.columns]
    cols.append((F.col("_off_n") + F.col("_lpos")).alias(pos_col))
    cols += [(F.col(f"_off_{c}") + F.col(f"_lcum_{c}")).alias(f"cum_{c}") for c in sum_cols]
    return joined.select(*cols)

"""Streaming form of the temporal composite (D1) and local indices.

New observations (cell rows with band columns and an acquisition time) arrive
as Parquet files in a folder.  The same Column functions as the batch path
compute the index, and Structured Streaming keeps the per-cell reduction as
state:

* ``period_days=None``: one running composite per cell (state = one row per
  cell, bounded by the grid), emitted in ``update`` mode;
* ``period_days=n``: one composite per cell and n-day period, with a
  watermark so late scenes up to ``lateness`` are still merged and closed
  periods are emitted once in ``append`` mode (state is dropped after that).

No per-row Python runs; the checkpoint location must be on shared storage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.functions.indices import ndvi

OBS_SCHEMA = T.StructType([
    T.StructField("scene", T.LongType()), T.StructField("acquired", T.TimestampNTZType()),
    T.StructField("c", T.IntegerType()), T.StructField("r", T.IntegerType()),
    T.StructField("red", T.DoubleType()), T.StructField("nir", T.DoubleType()),
])


def read_observations(spark: SparkSession, folder: str, schema: T.StructType = OBS_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(folder)


def ndvi_composite_stream(obs: DataFrame, period_days: int | None = None,
                          lateness: str = "30 days", time_col: str = "acquired") -> DataFrame:
    """Max-NDVI composite of a stream of observations; as in the batch operator
    a nodata observation makes the cell nodata."""
    v = obs.select("c", "r", F.col(time_col).cast("timestamp").alias("t"),
                   ndvi("red", "nir").alias("ndvi"))
    best = F.when(F.count("ndvi") == F.count(F.lit(1)), F.max("ndvi"))
    if period_days is None:
        return v.groupBy("c", "r").agg(best.alias("ndvi"), F.count(F.lit(1)).alias("n_obs"))
    v = v.withWatermark("t", lateness)
    w = F.window("t", f"{int(period_days)} days")
    return (v.groupBy(w.alias("period"), "c", "r")
            .agg(best.alias("ndvi"), F.count(F.lit(1)).alias("n_obs"))
            .select(F.col("period.start").alias("period_start"), "c", "r", "ndvi", "n_obs"))


def start_composite(spark: SparkSession, folder: str, checkpoint: str, query_name: str,
                    period_days: int | None = None, sink: str = "memory", path: str | None = None,
                    trigger_once: bool = False):
    """Start the composite query; ``sink`` 'memory' (tests) or 'parquet' (append
    of closed periods, needs ``period_days``)."""
    comp = ndvi_composite_stream(read_observations(spark, folder), period_days)
    mode = "update" if period_days is None else "append"
    if sink == "memory":
        mode = "complete" if period_days is None else "append"
    w = comp.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).queryName(query_name)
    if trigger_once:
        w = w.trigger(availableNow=True)
    if sink == "memory":
        return w.format("memory").start()
    if sink == "parquet":
        if period_days is None:
            raise ValueError("a parquet sink needs period_days (append of closed periods)")
        return w.format("parquet").option("path", path).start()
    raise ValueError("sink must be memory or parquet")

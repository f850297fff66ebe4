"""Tiled raster catalog on Parquet (layer / zoom partitions, Z-ordered files).

Write: cells get their tile key (``col_key``/``row_key`` for a
``tile_size`` grid) and its Morton code ``zkey``; rows are range-partitioned
on ``zkey`` and sorted within partitions, then written with
``partitionBy(layer, zoom)``.  Neighbouring tiles land in the same files and
row groups, so an area query reads few row groups.  Dynamic partition
overwrite replaces only the (layer, zoom) partitions being written.

With ``time_days`` the key order is space and time: ``zkey`` interleaves tile
column, tile row and the time step (``time_days`` days each, counted from
1970-01-01), so that a query by area and period reads few row groups.

Next to the rows the catalog stores one layout row per (layer, zoom): tile
size, grid (origin, cell size), CRS, key order, cell bounds, tile-key and step
bounds and record count.  They come from the statistics in the footers of the
files that the write committed (Spark's aggregate pushdown), so no row is
scanned again and a retried or speculative task changes nothing.

Read: ``layer``/``zoom`` equalities prune directories; the layout row gives the
tile size; the area becomes plain range predicates on ``c``/``r`` and on the
derived tile keys, and area and period together a bounded union of ``zkey``
ranges (``functions.curve``), which Parquet uses for row-group skipping; the
period becomes a range on the time column as well.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.functions.curve import in_ranges, z_ranges
from dunegrid.functions.geometry import morton2, morton3
from dunegrid.operators.assembly import _fail_if

#: Folder of the layout rows (hidden from a scan of the catalog by its name).
LAYOUT = "_layout"


def _write(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("layer", "zoom").parquet(path)


#: Days of 1970-01-01 onward that a step may number (21 bits of the code).
_EPOCH, _MAX_KEY = "1970-01-01", 1 << 21


def time_step(time_col: str, time_days: int) -> Column:
    """Number of the step of ``time_days`` days that a time falls into."""
    days = F.datediff(F.col(time_col).cast("date"), F.lit(_EPOCH).cast("date"))
    return F.floor(days / F.lit(int(time_days))).cast("int")


@contextmanager
def _footer_aggregates(spark: SparkSession) -> Iterator[None]:
    """Count, minimum and maximum of Parquet columns are answered by file footers."""
    v1 = "spark.sql.sources.useV1SourceList"
    new = {v1: ",".join(x for x in spark.conf.get(v1).split(",") if x != "parquet"),
           "spark.sql.parquet.aggregatePushdown": "true"}
    old = {k: spark.conf.get(k) for k in new}
    try:
        for k, v in new.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _bounds(spark: SparkSession, folder: str, bounds: list[tuple[str, str, str]]) -> dict:
    """n_records and the bounds (column, name of its minimum, of its maximum) of a written folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return {"n_records": 0}  # an empty layer has no files
    with _footer_aggregates(spark):
        return footer_bounds(spark, folder, bounds).first().asDict()


def footer_bounds(spark: SparkSession, folder: str, bounds: list[tuple[str, str, str]]) -> DataFrame:
    return spark.read.parquet(folder).agg(F.count(F.lit(1)).alias("n_records"), *[
        f(x).alias(n) for x, lo, hi in bounds for f, n in ((F.min, lo), (F.max, hi))])


def write_catalog(cells: DataFrame, path: str, layer: str, zoom: int, tile_size: int = 256,
                  c: str = "c", r: str = "r", grid=None, crs: int = 0, time_days: int | None = None,
                  time_col: str = "acquired") -> None:
    """Write one layer at one zoom.  ``grid`` (x0, y0, dx, dy; unit cells by
    default) and ``crs`` describe it; cell coordinates must not be negative.
    ``time_days`` chooses the key order of space and time."""
    x0, y0, dx, dy = (grid.x0, grid.y0, grid.dx, grid.dy) if grid is not None else (0.0, 0.0, 1.0, 1.0)
    negative = _fail_if((F.col(c) < 0) | (F.col(r) < 0), "cell coordinates must not be negative")
    keyed = (cells.filter(negative)
             .withColumn("col_key", F.floor(F.col(c) / tile_size).cast("int"))
             .withColumn("row_key", F.floor(F.col(r) / tile_size).cast("int")))
    bounds = [(c, "col_min", "col_max"), (r, "row_min", "row_max"), ("col_key", "col_key_min", "col_key_max"),
              ("row_key", "row_key_min", "row_key_max")]
    if time_days is None:
        keyed = keyed.withColumn("zkey", morton2("col_key", "row_key"))
    else:
        keyed = keyed.withColumn("step", time_step(time_col, time_days))
        out = F.col("step").isNull() | (F.col("step") < 0) | (F.greatest("step", "col_key", "row_key") >= _MAX_KEY)
        keyed = keyed.filter(_fail_if(out, "time steps from 1970 on and keys below 2**21 are needed")).withColumn(
            "zkey", morton3("col_key", "row_key", "step"))
        bounds.append(("step", "step_min", "step_max"))
    # range bounds on (zkey, r, c, ...): a heavily populated tile is split
    # over several partitions instead of landing in one task
    extra = [x for x in cells.columns if x not in (c, r)][:1]
    ordered = keyed.repartitionByRange("zkey", r, c, *extra).sortWithinPartitions("zkey", r, c)
    _write(ordered.withColumns({"layer": F.lit(layer), "zoom": F.lit(int(zoom))}), path)
    found = _bounds(cells.sparkSession, f"{path}/layer={layer}/zoom={int(zoom)}", bounds)
    ints = ["col_min", "col_max", "row_min", "row_max", "col_key_min", "col_key_max", "row_key_min", "row_key_max",
            "step_min", "step_max"]
    row = (layer, int(zoom), int(tile_size), float(x0), float(y0), float(dx), float(dy), int(crs), time_days,
           *[found.get(n) for n in ints], found["n_records"])
    schema = ("layer string, zoom int, tile_size int, x0 double, y0 double, dx double, dy double, crs int, "
              "time_days int, " + ", ".join(f"{n} int" for n in ints) + ", n_records long")
    _write(cells.sparkSession.createDataFrame([row], schema), f"{path}/{LAYOUT}")


def read_layout(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """The layout rows, one per (layer, zoom), with the layer's extent."""
    rows = spark.read.parquet(f"{path}/{LAYOUT}")
    if layer is not None:
        rows = rows.filter(F.col("layer") == layer)
    x = [F.col("x0") + F.col("col_min") * F.col("dx"), F.col("x0") + (F.col("col_max") + 1) * F.col("dx")]
    y = [F.col("y0") + F.col("row_min") * F.col("dy"), F.col("y0") + (F.col("row_max") + 1) * F.col("dy")]
    return (rows.withColumn("xmin", F.least(*x)).withColumn("xmax", F.greatest(*x))
            .withColumn("ymin", F.least(*y)).withColumn("ymax", F.greatest(*y)))


def key_ranges(layout, extent=None, period=None, budget: int = 64) -> list[tuple[int, int]]:
    """``zkey`` ranges of a layer (its layout row) for an extent and a period of
    ISO dates or times, each optional: bounded by what the layer holds."""
    lo = [layout["col_key_min"], layout["row_key_min"]]
    hi = [layout["col_key_max"], layout["row_key_max"]]
    if lo[0] is None:  # an empty layer
        return []
    if extent is not None:
        size = int(layout["tile_size"])
        xmin, ymin, xmax, ymax = extent
        # cells whose box meets the extent: from floor(min) on, to before max
        lo = [max(a, math.floor(v) // size) for a, v in zip(lo, (xmin, ymin))]
        hi = [min(b, (math.ceil(v) - 1) // size) for b, v in zip(hi, (xmax, ymax))]
    if layout["time_days"] is not None:
        steps = [layout["step_min"], layout["step_max"]]
        if period is not None:
            at = [(np.datetime64(str(t)[:10]) - np.datetime64(_EPOCH)).astype(int) // layout["time_days"] for t in period]
            steps = [max(steps[0], int(at[0])), min(steps[1], int(at[1]))]
        lo, hi = [*lo, steps[0]], [*hi, steps[1]]
    return z_ranges(lo, hi, budget)


def read_catalog(spark: SparkSession, path: str, layer: str, zoom: int, extent=None,
                 period=None, time_col: str = "acquired", c: str = "c", r: str = "r", budget: int = 64) -> DataFrame:
    """Query one layer at one zoom, optionally by extent (xmin, ymin, xmax, ymax
    in cell space, cells whose box meets it) and period (inclusive); at most
    ``budget`` key ranges go to the scan."""
    layout = read_layout(spark, path, layer).filter(F.col("zoom") == int(zoom)).first()
    if layout is None:
        raise ValueError(f"the catalog has no layer {layer!r} at zoom {zoom}")
    tile_size = int(layout["tile_size"])
    df = spark.read.parquet(path).filter((F.col("layer") == layer) & (F.col("zoom") == int(zoom)))
    if extent is not None:
        xmin, ymin, xmax, ymax = extent
        lo = [max(0, math.floor(v)) // tile_size for v in (xmin, ymin)]
        hi = [max(0, math.ceil(v) - 1) // tile_size for v in (xmax, ymax)]
        df = df.filter((F.col(c) > F.lit(xmin - 1)) & (F.col(c) < F.lit(xmax))
                       & (F.col(r) > F.lit(ymin - 1)) & (F.col(r) < F.lit(ymax))
                       # redundant key ranges: row-group pruning on the clustered keys
                       & F.col("col_key").between(lo[0], hi[0]) & F.col("row_key").between(lo[1], hi[1]))
    if extent is not None or (period is not None and layout["time_days"] is not None):
        df = df.filter(in_ranges(F.col("zkey"), key_ranges(layout, extent, period, budget)))
    if period is not None:
        t0, t1 = period
        dt = df.schema[time_col].dataType
        df = df.filter(F.col(time_col).between(F.lit(str(t0)).cast(dt), F.lit(str(t1)).cast(dt)))
    return df

"""Temporal composites and mosaics.

A composite drops time from the key and reduces every cell's observations;
Spark does this as a partial (map-side) + final hash aggregation on the cell
key, so the shuffle carries one partial row per cell and partition rather
than every observation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.functions.indices import ndvi
from dunegrid.operators.mask import filter_extent, filter_time, mask_polygon, polygon_bbox

NODATA_POLICIES = ("propagate", "ignore")


def _reduce(fn, v: Column, nodata: str) -> Column:
    if nodata not in NODATA_POLICIES:
        raise ValueError(f"nodata must be one of {NODATA_POLICIES}")
    if nodata == "ignore":
        return fn(v)
    # propagate: a nodata observation makes the composite cell nodata
    return F.when(F.count(v) == F.count(F.lit(1)), fn(v))


def composite(cells: DataFrame, value_cols: Sequence[str], how: str = "max",
              keys: Sequence[str] = ("c", "r"), nodata: str | dict[str, str] = "propagate") -> DataFrame:
    """Reduce observations over time to one row per cell (``localMax`` style).

    ``how`` is one of max, min, mean, sum, count, median.  The time column is
    simply not part of the key (dropping time from the key).  ``nodata`` is one
    policy for all value columns or one per column.
    """
    fns = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum,
           "count": F.count, "median": F.median}
    if how not in fns:
        raise ValueError(f"unknown composite {how!r}")
    policy = nodata if isinstance(nodata, dict) else dict.fromkeys(value_cols, nodata)
    aggs = [_reduce(fns[how], F.col(v), policy[v]).alias(v) for v in value_cols]
    return cells.groupBy(*keys).agg(*aggs)


def max_ndvi_composite(cells: DataFrame, t0, t1, region=None, extent=None,
                       red: str = "red", nir: str = "nir", time_col: str = "acquired",
                       nodata: str = "propagate") -> DataFrame:
    """Max-NDVI composite of a region and period (the layer query).

    Period filter (inclusive) -> extent / polygon selection -> NDVI per
    observation -> max per cell.  Returns (c, r, ndvi).  The original ran the
    index through an integer combine, which truncated NDVI to whole numbers;
    here the index is a double.
    """
    df = filter_time(cells.select("c", "r", time_col, red, nir), t0, t1, time_col)
    if extent is not None:
        df = filter_extent(df, *extent)
    if region is not None:
        df = mask_polygon(df, region)
    df = df.select("c", "r", ndvi(red, nir).alias("ndvi"))
    return composite(df, ["ndvi"], "max", nodata=nodata)


def data_layer(value_col: str, layer_col: str) -> Column:
    """The layer where the value is data, else NULL (which max_by/min_by skip)."""
    return F.when(F.col(value_col).isNotNull(), F.col(layer_col))


MOSAIC_POLICIES = ("first", "last", "max", "min", "mean")


def mosaic(layers: DataFrame, value_cols: Sequence[str], policy: str = "last",
           layer_col: str = "scene", keys: Sequence[str] = ("c", "r")) -> DataFrame:
    """Merge overlapping layers (scenes) cell by cell.

    ``first``/``last`` keep, per value column, the value of the lowest/highest
    ``layer_col`` that has data there (``min_by``/``max_by`` over data layers
    only, which aggregate partially like any other reduction), so nodata on top
    shows the layer below.  The original unioned scenes without merging equal
    keys; the policy makes the overlap explicit.
    """
    if policy not in MOSAIC_POLICIES:
        raise ValueError(f"policy must be one of {MOSAIC_POLICIES}")
    aggs = []
    for v in value_cols:
        if policy == "first":
            aggs.append(F.min_by(F.col(v), data_layer(v, layer_col)).alias(v))
        elif policy == "last":
            aggs.append(F.max_by(F.col(v), data_layer(v, layer_col)).alias(v))
        else:
            fn = {"max": F.max, "min": F.min, "mean": F.avg}[policy]
            aggs.append(fn(F.col(v)).alias(v))
    return layers.groupBy(*keys).agg(*aggs)


def union_layers(layers: Sequence[DataFrame], zoom_col: str | None = None) -> DataFrame:
    """Bag union of layers by column name; all layers must share one zoom."""
    if not layers:
        raise ValueError("no layers")
    out = layers[0]
    for other in layers[1:]:
        out = out.unionByName(other)
    if zoom_col is not None:
        zooms = out.select(zoom_col).distinct().limit(2).count()
        if zooms > 1:
            raise ValueError("layers have different zoom levels")
    return out


__all__ = ["composite", "max_ndvi_composite", "mosaic", "union_layers", "polygon_bbox"]

"""Layers made of scenes that differ in grid and coordinate system.

A scene's grid is data: one row (scene_id, crs, x0, y0, dx, dy) of a table, as
the files' own headers give it (``scene_grids``; ``scene_cells`` counts cells
from its corner).  Target layouts are rows too
(``mercator_layout``, ``merged_layout``): what they say is joined into the plan.

``reproject_scenes`` brings scenes of several CRSs (WGS84 UTM zones of both
hemispheres, lon/lat, Web Mercator) into one zoomed Web Mercator layer: the
transform is picked per scene, the zoom follows from all scenes' cell sizes,
each work tile resamples one scene's cells at a time (so a tile that thousands
of scenes cover is thousands of bounded groups), and the scenes' cells of a
target pixel are merged by priority in a partial aggregate.

``regrid_to_layout`` lays scenes of one CRS and different origins on a merged
grid by nearest neighbour, with plain expressions.

A scene without a grid row, an unknown CRS, or two grids of one scene fail.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.functions.geometry import (
    MERCATOR_HALF_WORLD, mercator_resolution, utm_forward_np, utm_inverse_np,
)
from dunegrid.operators import grid as gr
from dunegrid.operators.assembly import _fail_if
from dunegrid.operators.composite import data_layer
from dunegrid.session import ensure_on_executors

GRID_COLUMNS = ("crs", "x0", "y0", "dx", "dy")


def mercator_maps(crs: int) -> tuple[gr.MapXY, gr.MapXY]:
    """Numpy maps from a CRS (EPSG code) to Web Mercator and back."""
    if crs == 3857:
        return gr._same, gr._same
    if crs == 4326:
        return gr._lonlat_to_mercator, gr._mercator_to_lonlat
    zone, south = crs % 100, crs // 100 == 327
    if crs // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{crs} is neither WGS84 UTM, lon/lat nor Web Mercator")

    def forward(x, y):
        return gr._lonlat_to_mercator(*utm_inverse_np(x, y, zone, south))

    def inverse(x, y):
        return utm_forward_np(*gr._mercator_to_lonlat(x, y), zone, south)

    return forward, inverse


def scene_grids(windows: DataFrame, scene: str = "scene_id") -> DataFrame:
    """One grid row per scene (with its width and height) from window rows (crs,
    xmin, ymax, dx, dy, cols, rows): its files may be blocks of one raster, so
    the corner is that of the first window on either axis."""
    right, bottom = (F.col(a) + F.col(n) * F.col(d) for a, n, d in (("xmin", "cols", "dx"), ("ymax", "rows", "dy")))
    phase = [F.col(a) / F.col(d) - F.round(F.col(a) / F.col(d)) for a, d in (("xmin", "dx"), ("ymax", "dy"))]
    out = windows.groupBy(scene).agg(
        F.min("crs").alias("crs"), F.min("xmin").alias("x0"), F.max("ymax").alias("y0"), F.min("dx").alias("dx"),
        F.min("dy").alias("dy"), F.max(right).alias("_right"), F.min(bottom).alias("_bottom"),
        *[(F.max(x) - F.min(x)).alias(f"_s{k}") for k, x in enumerate([F.col("crs"), F.col("dx"), F.col("dy")])],
        *[(F.max(x) - F.min(x)).alias(f"_p{k}") for k, x in enumerate(phase)])
    # phases of one grid are equal but for rounding (and a whole cell between -0.5 and 0.5)
    apart = [F.least(F.col(p), F.abs(F.col(p) - 1)) > 1e-4 for p in ("_p0", "_p1")]
    bad = (F.col("_s0") != 0) | (F.col("_s1") != 0) | (F.col("_s2") != 0) | apart[0] | apart[1]
    return out.filter(_fail_if(bad, "the files of a scene differ in grid")).select(
        scene, *GRID_COLUMNS, F.round((F.col("_right") - F.col("x0")) / F.col("dx")).cast("int").alias("width"),
        F.round((F.col("_bottom") - F.col("y0")) / F.col("dy")).cast("int").alias("height"))


def scene_cells(windows: DataFrame, grids: DataFrame, keep: Sequence[str] = (), scene: str = "scene_id") -> DataFrame:
    """Cells (scene, keep, c, r, v) of windows, counted from their scene's corner."""
    corner = grids.select(scene, F.col("x0").alias("_x0"), F.col("y0").alias("_y0"))
    at = windows.join(corner, scene)
    first = [F.round((F.col(a) - F.col(o)) / F.col(d)).cast("int") for a, o, d in (
        ("xmin", "_x0", "dx"), ("ymax", "_y0", "dy"))]
    cells = at.select(scene, *keep, first[0].alias("_c"), first[1].alias("_r"), F.col("cols").alias("_w"),
                      F.posexplode("cells").alias("_pos", "v"))
    return cells.select(scene, *keep, (F.col("_c") + F.col("_pos") % F.col("_w")).cast("int").alias("c"),
                        (F.col("_r") + F.floor(F.col("_pos") / F.col("_w"))).cast("int").alias("r"), "v")


def cell_metres() -> Column:
    """Cell size of a grid row in (Web Mercator, for degrees) metres."""
    per_degree = F.when(F.col("crs") == 4326, F.lit(MERCATOR_HALF_WORLD / 180.0)).otherwise(F.lit(1.0))
    return F.abs(F.col("dx")) * per_degree


def mercator_layout(grids: DataFrame, tile_size: int = 256) -> DataFrame:
    """One row: the zoom whose resolution is nearest to the finest cell of all
    scenes, and its grid (zoom, tile_size, crs, x0, y0, dx, dy)."""
    top = mercator_resolution(0, tile_size)
    zoom = F.greatest(F.lit(0), F.round(F.log2(F.lit(top) / F.min(cell_metres())))).cast("int")
    row = grids.agg(zoom.alias("zoom"))
    res = F.lit(top) / F.pow(F.lit(2.0), F.col("zoom"))
    return row.select("zoom", F.lit(int(tile_size)).alias("tile_size"), F.lit(3857).alias("crs"),
                      F.lit(-MERCATOR_HALF_WORLD).alias("x0"), F.lit(MERCATOR_HALF_WORLD).alias("y0"),
                      res.alias("dx"), (-res).alias("dy"))


def reproject_scenes(cells: DataFrame, value_cols: Sequence[str], grids: DataFrame, scene: str = "scene_id",
                     priority: str | None = None, keys: Sequence[str] = (), tile_size: int = 256,
                     layout: DataFrame | None = None, c: str = "c", r: str = "r", tile: int = 128) -> DataFrame:
    """Cells (scene, keys, c, r, values) of scenes in several CRSs on one Web
    Mercator layer: zoom, keys, px, py, col_key, row_key, values.

    ``layout`` is a row of :func:`mercator_layout` (made from ``grids`` by
    default).  Per pixel, key and value column the scene of the highest
    ``priority`` (a column of ``grids``; the scene itself by default) that has
    data wins.
    """
    spark = cells.sparkSession
    ensure_on_executors(spark)
    values, keys = list(value_cols), list(keys)
    row = (mercator_layout(grids, tile_size) if layout is None else layout).first()
    dst = gr.Grid(row["x0"], row["y0"], row["dx"], row["dy"])
    one = grids.groupBy(scene).agg(F.count(F.lit(1)).alias("_n"), *[F.first(k).alias(f"_g_{k}") for k in GRID_COLUMNS],
                                   F.first(priority or scene).alias("_priority"))
    one = one.filter(_fail_if(F.col("_n") > 1, "a scene has several grids")).drop("_n")
    rows = cells.select(scene, *keys, F.col(c).cast("int").alias("_c"), F.col(r).cast("int").alias("_r"),
                        *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    rows = rows.join(one, scene, "left").filter(_fail_if(F.col("_g_crs").isNull(), "a scene has no grid"))

    def grid_of(t) -> tuple[gr.Grid, int]:
        crs, x0, y0, dx, dy = (t.column(f"_g_{k}")[0].as_py() for k in GRID_COLUMNS)
        return gr.Grid(x0, y0, dx, dy), crs

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            numbers = b.column(scene).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            for k in range(int(numbers.max(initial=-1)) + 1):  # scenes of this batch
                part = b.take(pa.array(np.flatnonzero(numbers == k)))
                src, crs = grid_of(part)
                yield from gr.route_to_tiles(part, src, dst, mercator_maps(crs)[0], tile)

    def per_tile(t: pa.Table) -> pa.Table:
        src, crs = grid_of(t)
        tc, tr, found = gr.resample_tile(t, len(values), src, dst, mercator_maps(crs)[1], tile)
        same = [pa.array([t.column(k)[0].as_py()] * len(tc), t.schema.field(k).type) for k in [*keys, "_priority"]]
        return pa.Table.from_arrays(
            [*same, pa.array(tc.astype("int32")), pa.array(tr.astype("int32")),
             *[pa.array(f, mask=np.isnan(f)) for f in found]], names=[*keys, "_priority", "px", "py", *values])

    ints = [T.StructField(k, T.IntegerType()) for k in ("_tx", "_ty", "px", "py")]
    routed = rows.mapInArrow(route, T.StructType([*rows.schema.fields, *ints[:2]]))
    out = routed.groupBy(scene, *keys, "_tx", "_ty").applyInArrow(per_tile, T.StructType(
        [*[rows.schema[k] for k in [*keys, "_priority"]], *ints[2:], *[T.StructField(v, T.DoubleType()) for v in values]]))
    merged = out.groupBy(*keys, "px", "py").agg(
        *[F.max_by(F.col(v), data_layer(v, "_priority")).alias(v) for v in values])
    size = int(row["tile_size"])
    return merged.select(F.lit(int(row["zoom"])).alias("zoom"), *keys, "px", "py",
                         F.floor(F.col("px") / size).cast("int").alias("col_key"),
                         F.floor(F.col("py") / size).cast("int").alias("row_key"), *values)


def merged_layout(grids: DataFrame, tile: int = 512) -> DataFrame:
    """One row: the grid that covers all scenes (one CRS, finest cell), from the
    north-west corner of them all, in whole tiles of ``tile`` cells: crs, x0,
    y0, dx, dy, cols, rows, tile_cols, tile_rows."""
    right, bottom = (F.col(a) + F.col(n) * F.col(d) for a, n, d in (("x0", "width", "dx"), ("y0", "height", "dy")))
    one = grids.agg(F.min("crs").alias("crs"), (F.max("crs") - F.min("crs")).alias("_apart"), F.min("x0").alias("x0"),
                    F.max("y0").alias("y0"), F.min("dx").alias("dx"), F.max("dy").alias("dy"),
                    F.max(right).alias("_right"), F.min(bottom).alias("_bottom"))
    one = one.filter(_fail_if(F.col("_apart") != 0, "the scenes have several CRSs"))
    cols = F.ceil(F.round((F.col("_right") - F.col("x0")) / F.col("dx"), 6)).cast("int")
    rows = F.ceil(F.round((F.col("_bottom") - F.col("y0")) / F.col("dy"), 6)).cast("int")
    return one.select("crs", "x0", "y0", "dx", "dy", cols.alias("cols"), rows.alias("rows"), F.lit(int(tile)).alias("tile"),
                      F.ceil(cols / tile).cast("int").alias("tile_cols"), F.ceil(rows / tile).cast("int").alias("tile_rows"))


def regrid_to_layout(cells: DataFrame, value_cols: Sequence[str], grids: DataFrame, layout: DataFrame,
                     scene: str = "scene_id", c: str = "c", r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-neighbour regrid of scenes onto a layout row, overlaps merged (the
    highest scene with data wins per value): keys, c, r, col_key, row_key, values.

    Grids and layout come from their tables: a cell's targets are found from the
    joined columns, so one plan serves any scenes.
    """
    g = grids.select(scene, *[F.col(k).alias(f"_g_{k}") for k in GRID_COLUMNS[1:]])
    one = F.broadcast(layout.select(*[F.col(k).alias(f"_t_{k}") for k in (*GRID_COLUMNS[1:], "cols", "rows", "tile")]))  # a row
    at = cells.join(g, scene, "left").filter(_fail_if(F.col("_g_x0").isNull(), "a scene has no grid")).crossJoin(one)

    def axis(cell: str, o: str, d: str, n: str) -> tuple[Column, Column]:
        """Candidate targets of a cell, and the source index of a target."""
        lo = F.col(f"_g_{o}") + F.col(cell) * F.col(f"_g_{d}")
        ends = [(x - F.col(f"_t_{o}")) / F.col(f"_t_{d}") - 0.5 for x in (lo, lo + F.col(f"_g_{d}"))]
        first = F.greatest(F.lit(0), F.floor(F.least(*ends)).cast("int"))
        last = F.least(F.col(f"_t_{n}") - 1, F.ceil(F.greatest(*ends)).cast("int"))
        centre = F.col(f"_t_{o}") + (F.col(f"_to_{cell}") + 0.5) * F.col(f"_t_{d}")
        source = F.floor((centre - F.col(f"_g_{o}")) / F.col(f"_g_{d}"))
        return F.when(first <= last, F.sequence(first, last)), source == F.col(cell)

    (seq_c, hit_c), (seq_r, hit_r) = axis(c, "x0", "dx", "cols"), axis(r, "y0", "dy", "rows")
    at = at.withColumn(f"_to_{c}", F.explode(seq_c)).filter(hit_c).withColumn(f"_to_{r}", F.explode(seq_r)).filter(hit_r)
    out = at.groupBy(*keys, F.col(f"_to_{c}").alias("_tc"), F.col(f"_to_{r}").alias("_tr"), "_t_tile").agg(
        *[F.max_by(F.col(v), data_layer(v, scene)).alias(v) for v in value_cols])
    return out.select(*keys, F.col("_tc").alias("c"), F.col("_tr").alias("r"),
                      F.floor(F.col("_tc") / F.col("_t_tile")).cast("int").alias("col_key"),
                      F.floor(F.col("_tr") / F.col("_t_tile")).cast("int").alias("row_key"), *value_cols)

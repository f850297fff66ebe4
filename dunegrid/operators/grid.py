"""Grid operations: tiles <-> cells, pyramids, nearest / bilinear regridding,
resampling to a fixed size, reprojection to Web Mercator, Z-order keys.

A grid is described by :class:`Grid`: cell (c, r) covers
[x0 + c dx, x0 + (c + 1) dx) x [y0 + r dy, y0 + (r + 1) dy); its centre is at
(c + .5, r + .5) in index space.  (For north-up map rasters pass the top edge
as ``y0`` and a negative ``dy``.)

Regridding runs from the *source* side.  Nearest: each source cell lists the
target cells it can influence (a bounded ``sequence`` per axis) and re-tests
them exactly.  Bilinear regridding and reprojection: each source cell goes to
the work tile(s) of target cells in its reach and one grouped map per tile does
the rest in numpy (``resample_on_tiles``); the ``*_cells`` forms do the same
cell by cell with Spark expressions.  No join against the target grid is
needed, and the work per source cell is bounded by the resolution ratio.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.functions.geometry import (
    EARTH_RADIUS, MERCATOR_HALF_WORLD, mercator_resolution, morton2,
)
from dunegrid.operators.assembly import _fail_if
from dunegrid.operators.composite import data_layer
from dunegrid.session import ensure_on_executors


@dataclass(frozen=True)
class Grid:
    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0


# --- tiles <-> cells ---------------------------------------------------------------

def explode_tiles(tiles: DataFrame, value_col: str = "cells", out: str = "v",
                  keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell of each tile: col_key, row_key, col, row, c, r, v.

    ``c`` and ``r`` are global cell coordinates, so a whole layer is
    "stitched" without leaving Spark.  A tile's first cell is at its
    ``col_off``/``row_off`` where the tiles carry these (windows at a raster's
    edge are smaller than the nominal tile, so their own size says nothing
    about where they start); tiles without offsets must all have one size.
    """
    has_off = {"col_off", "row_off"} <= set(tiles.columns)
    left = F.col("col_off") if has_off else F.col("col_key") * F.col("cols")
    top = F.col("row_off") if has_off else F.col("row_key") * F.col("rows")
    e = tiles.select(*keep, "col_key", "row_key", "cols", "rows", left.alias("_c0"), top.alias("_r0"),
                     F.posexplode(value_col).alias("_pos", out))
    col = (F.col("_pos") % F.col("cols")).cast("int")
    row = F.floor(F.col("_pos") / F.col("cols")).cast("int")
    return e.select(*keep, "col_key", "row_key", col.alias("col"), row.alias("row"),
                    (F.col("_c0") + col).alias("c"), (F.col("_r0") + row).alias("r"), out)


def assemble_tiles(cells: DataFrame, cols: int, rows: int, value_col: str = "v",
                   c: str = "c", r: str = "r", keep: Sequence[str] = (),
                   duplicates: str | tuple[str, str] = "max") -> DataFrame:
    """Cells -> dense row-major tiles of ``cols x rows``; unfilled cells are NULL.

    A pixel holds one value: several rows for one pixel (e.g. a time series)
    are first reduced per pixel with ``duplicates`` (max, min, mean, or
    ``("first", order column)`` for the first data value in that order), a
    partial aggregation, so a tile group never holds more than
    ``cols * rows`` entries however the input is skewed.  One grouped map per
    tile then places its entries; positions without an entry travel nowhere.
    """
    ensure_on_executors(cells.sparkSession)
    if isinstance(duplicates, tuple):
        red = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("_o")))
    else:
        red = {"max": F.max, "min": F.min, "mean": F.avg}[duplicates]("_v")
    n = cols * rows
    order = [F.col(duplicates[1]).alias("_o")] if isinstance(duplicates, tuple) else []
    keyed = cells.select(*keep,
                         F.floor(F.col(c) / cols).cast("int").alias("col_key"),
                         F.floor(F.col(r) / rows).cast("int").alias("row_key"),
                         ((F.col(r) - F.floor(F.col(r) / rows) * rows) * cols
                          + (F.col(c) - F.floor(F.col(c) / cols) * cols)).cast("int").alias("_pos"),
                         F.col(value_col).cast("double").alias("_v"), *order)
    per_pixel = keyed.groupBy(*keep, "col_key", "row_key", "_pos").agg(red.alias("_v"))
    keys = [*keep, "col_key", "row_key"]
    schema = T.StructType([*[per_pixel.schema[k] for k in keys], T.StructField("cells", T.ArrayType(T.DoubleType()))])

    def dense(t: pa.Table) -> pa.Table:
        tile = np.full(n, np.nan)
        tile[t.column("_pos").to_numpy()] = t.column("_v").to_pandas().to_numpy(dtype="float64")
        return pa.Table.from_arrays([t.column(k).slice(0, 1) for k in keys]
                                    + [pa.array([tile], pa.list_(pa.float64()))], names=[*keys, "cells"])

    tiles = per_pixel.groupBy(*keys).applyInArrow(dense, schema)
    # NaN travelled as the nodata mark; it becomes NULL on the JVM side
    return tiles.select(*keys, F.lit(cols).alias("cols"), F.lit(rows).alias("rows"),
                        F.transform("cells", lambda v: F.when(~F.isnan(v), v)).alias("cells"))


# --- pyramids ----------------------------------------------------------------------

def pyramid_level(cells: DataFrame, value_cols: Sequence[str], c: str = "c", r: str = "r",
                  how: str = "mean", keys: Sequence[str] = ()) -> DataFrame:
    """Next coarser level: each 2 x 2 block of cells -> one cell.

    ``mean`` equals bilinear resampling at the coarse cell centres (each
    centre sits at the middle of four fine centres); nodata children are
    skipped.  ``keys`` (scene, time ...) keep layers apart.
    """
    fn = {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[how]
    return (cells.groupBy(*keys, F.floor(F.col(c) / 2).cast("int").alias(c),
                          F.floor(F.col(r) / 2).cast("int").alias(r))
            .agg(*[fn(v).alias(v) for v in value_cols]))


def pyramid_levels(cells: DataFrame, c: str = "c", r: str = "r") -> int:
    """Levels above the base until one cell is left, from the layer's bounds."""
    lo_c, hi_c, lo_r, hi_r = cells.agg(F.min(c), F.max(c), F.min(r), F.max(r)).first()
    levels = 0
    while lo_c is not None and (lo_c != hi_c or lo_r != hi_r):
        lo_c, hi_c, lo_r, hi_r = (x // 2 for x in (lo_c, hi_c, lo_r, hi_r))
        levels += 1
        if levels > 62:  # bounds on both sides of 0 never meet in one cell
            raise ValueError("cell coordinates must not be negative")
    return levels


def build_pyramid(cells: DataFrame, value_cols: Sequence[str], levels: int | None = None,
                  out_path: str | None = None, layer: str = "layer", keys: Sequence[str] = (),
                  tile_size: int = 256) -> DataFrame:
    """Levels 1..``levels`` above the base, each from the previous one.

    ``levels`` defaults to as many as the layer's bounds need to end in one
    cell.  The lineage is cut per level: with ``out_path`` each level is
    written as zoom ``level`` of ``layer`` in the catalog there (tile keys and
    layout metadata included, so every level can be queried) and read back;
    without it the level is checkpointed to the session's reliable checkpoint
    folder.  Returns the union (level, keys..., c, r, values...).
    """
    from dunegrid.session import checkpoint_dir
    from dunegrid.sources.catalog import read_catalog, write_catalog

    spark = cells.sparkSession
    if out_path is None:
        checkpoint_dir(spark)
    cur = cells.select(*keys, "c", "r", *value_cols)
    if levels is None:
        levels = pyramid_levels(cur)
    out = cur.limit(0).select(F.lit(0).alias("level"), *keys, "c", "r", *value_cols)
    for level in range(1, levels + 1):
        nxt = pyramid_level(cur, value_cols, keys=keys)
        if out_path is not None:
            write_catalog(nxt, out_path, layer, level, tile_size)
            nxt = read_catalog(spark, out_path, layer, level).select(*keys, "c", "r", *value_cols)
        else:
            nxt = nxt.checkpoint(eager=True)
        part = nxt.select(F.lit(level).alias("level"), *keys, "c", "r", *value_cols)
        out = part if level == 1 else out.unionByName(part)
        cur = nxt
    return out


# --- regridding ----------------------------------------------------------------------

def _axis_candidates(lo_edge: Column, hi_edge: Column, t0: float, td: float, pad: int = 1) -> Column:
    """Target indices whose centres may fall in the source interval [lo, hi]
    (computed with one index of slack; callers re-test exactly)."""
    a = (lo_edge - F.lit(t0)) / F.lit(td) - 0.5
    b = (hi_edge - F.lit(t0)) / F.lit(td) - 0.5
    first = F.floor(F.least(a, b)).cast("int") - pad
    last = F.ceil(F.greatest(a, b)).cast("int") + pad
    return F.sequence(first, last)


def regrid_nearest(cells: DataFrame, value_cols: Sequence[str], src: Grid, dst: Grid,
                   c: str = "c", r: str = "r", out_c: str = "tc", out_r: str = "tr",
                   priority_col: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Nearest-neighbour regrid: target cell takes the source cell holding its centre.

    Source index of a target centre X is ``floor((X - x0) / dx)``; each source
    cell emits the target cells that map back to it, so there is no join and
    no aggregation (a target has exactly one source cell).  With
    ``priority_col`` several overlapping layers are merged: per target cell
    and value column the highest priority that has data wins.  ``keys`` (scene,
    time, band ...) are carried along and keep layers apart.
    """
    xc = F.lit(src.x0) + F.col(c) * F.lit(src.dx)
    yc = F.lit(src.y0) + F.col(r) * F.lit(src.dy)
    extra = [F.col(x) for x in dict.fromkeys([*keys, *([priority_col] if priority_col else [])])]
    cand = cells.select(
        *[F.col(v) for v in value_cols], *extra, F.col(c).alias("_sc"), F.col(r).alias("_sr"),
        F.explode(_axis_candidates(xc, xc + F.lit(src.dx), dst.x0, dst.dx)).alias(out_c),
        _axis_candidates(yc, yc + F.lit(src.dy), dst.y0, dst.dy).alias("_tr_seq"))
    cand = cand.select("*", F.explode("_tr_seq").alias(out_r)).drop("_tr_seq")
    X = F.lit(dst.x0) + (F.col(out_c) + 0.5) * F.lit(dst.dx)
    Y = F.lit(dst.y0) + (F.col(out_r) + 0.5) * F.lit(dst.dy)
    sc = F.floor((X - F.lit(src.x0)) / F.lit(src.dx)).cast("int")
    sr = F.floor((Y - F.lit(src.y0)) / F.lit(src.dy)).cast("int")
    hit = cand.filter((sc == F.col("_sc")) & (sr == F.col("_sr")))
    if priority_col is None:
        return hit.select(*keys, out_c, out_r, *value_cols)
    # overlapping inputs (e.g. scenes): the highest priority with data wins per
    # target cell, merged with max_by (partial aggregation, no collect)
    return hit.groupBy(*keys, out_c, out_r).agg(
        *[F.max_by(F.col(v), data_layer(v, priority_col)).alias(v) for v in value_cols])


def _combine_corners(vk, wk, fx, fy) -> Column:
    """Bilinear value from the four corner slots (NULL = absent).

    Complete row or column pairs use lerps (exact when the two values are
    equal); three corners fall back to renormalised weights.
    """
    p = [x.isNotNull() for x in vk]

    def lerp(a, b, f):
        return a + f * (b - a)

    top, bottom = lerp(vk[0], vk[1], fx), lerp(vk[2], vk[3], fx)
    num = F.coalesce(wk[0] * vk[0], F.lit(0.0))
    den = F.coalesce(wk[0], F.lit(0.0))
    for k in range(1, 4):
        num = num + F.coalesce(wk[k] * vk[k], F.lit(0.0))
        den = den + F.coalesce(wk[k], F.lit(0.0))
    n = sum(x.cast("int") for x in p)
    return (F.when(n == 4, lerp(top, bottom, fy))
            .when((n == 2) & p[0] & p[1], top)
            .when((n == 2) & p[2] & p[3], bottom)
            .when((n == 2) & p[0] & p[2], lerp(vk[0], vk[2], fy))
            .when((n == 2) & p[1] & p[3], lerp(vk[1], vk[3], fy))
            .when(n == 1, F.coalesce(*vk))
            .otherwise(F.try_divide(num, den)))


def _bilinear_from_source(cand: DataFrame, u: Column, v: Column, value_cols: Sequence[str],
                          keys: Sequence[str]) -> DataFrame:
    """Combine source contributions into bilinear values.

    For a target with fractional source coordinates (u, v), i0 = floor(u),
    fx = u - i0: cell i0 weighs 1 - fx and cell i0 + 1 weighs fx (same in y).
    With all four neighbours present the value is the two-step lerp
    ``lerp(lerp(v00, v10, fx), lerp(v01, v11, fx), fy)`` (exact where
    neighbours are equal); otherwise the data cells with positive weight are
    renormalised, sum(w v) / sum(w).  Each target has at most one contribution
    per corner, so the aggregation pivots them into four fixed slots (partial
    aggregation kept) and the result does not depend on row order.
    """
    i0 = F.floor(u)
    j0 = F.floor(v)
    fx = u - i0
    fy = v - j0
    di = F.col("_sc") - i0
    dj = F.col("_sr") - j0
    wx = F.when(di == 0, F.lit(1.0) - fx).when(di == 1, fx)
    wy = F.when(dj == 0, F.lit(1.0) - fy).when(dj == 1, fy)
    cand = (cand.withColumn("_w", wx * wy)
            .withColumn("_corner", (di + dj * 2).cast("int"))
            .withColumn("_fx", fx).withColumn("_fy", fy)
            .filter(F.col("_w") > 0))
    aggs = [F.max("_fx").alias("_fx"), F.max("_fy").alias("_fy"),
            *[F.count(F.when(F.col("_corner") == k, 1)).alias(f"_n{k}") for k in range(4)]]
    for val in value_cols:
        has = F.col(val).isNotNull()
        for k in range(4):
            at = has & (F.col("_corner") == k)
            aggs.append(F.max(F.when(at, F.col(val))).alias(f"_v{k}_{val}"))
            aggs.append(F.max(F.when(at, F.col("_w"))).alias(f"_w{k}_{val}"))
    out = cand.groupBy(*keys).agg(*aggs)
    # two rows of one source cell would be mixed silently: layers need their keys
    out = out.filter(_fail_if(F.greatest(*[F.col(f"_n{k}") for k in range(4)]) > 1,
                              "several rows for one cell: name the layer columns in keys"))
    sel = []
    fxc, fyc = F.col("_fx"), F.col("_fy")
    for val in value_cols:
        vk = [F.col(f"_v{k}_{val}") for k in range(4)]
        wk = [F.col(f"_w{k}_{val}") for k in range(4)]
        sel.append(_combine_corners(vk, wk, fxc, fyc).alias(val))
    out = out.select(*keys, *sel)
    any_data = F.lit(False)
    for vc in value_cols:
        any_data = any_data | F.col(vc).isNotNull()
    return out.filter(any_data)


def regrid_bilinear_cells(cells: DataFrame, value_cols: Sequence[str], src: Grid, dst: Grid,
                    c: str = "c", r: str = "r", out_c: str = "tc", out_r: str = "tr",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear regrid between two axis-aligned grids, cell by cell (the plain
    form that :func:`regrid_bilinear` is tested against).

    For a target centre X the fractional source coordinate is
    u = (X - x0) / dx - 0.5; source cell i contributes with 1 - |u - i| when
    that is positive.  A source cell therefore reaches targets whose centres
    lie within one source cell of its own centre.  ``keys`` (scene, time,
    band ...) keep layers apart; several rows of one cell and key fail.
    """
    xc = F.lit(src.x0) + (F.col(c) + 0.5) * F.lit(src.dx)
    yc = F.lit(src.y0) + (F.col(r) + 0.5) * F.lit(src.dy)
    cand = cells.select(
        *[F.col(v) for v in (*keys, *value_cols)], F.col(c).alias("_sc"), F.col(r).alias("_sr"),
        F.explode(_axis_candidates(xc - F.lit(src.dx), xc + F.lit(src.dx), dst.x0, dst.dx)).alias(out_c),
        _axis_candidates(yc - F.lit(src.dy), yc + F.lit(src.dy), dst.y0, dst.dy).alias("_tr_seq"))
    cand = cand.select("*", F.explode("_tr_seq").alias(out_r)).drop("_tr_seq")
    X = F.lit(dst.x0) + (F.col(out_c) + 0.5) * F.lit(dst.dx)
    Y = F.lit(dst.y0) + (F.col(out_r) + 0.5) * F.lit(dst.dy)
    u = (X - F.lit(src.x0)) / F.lit(src.dx) - 0.5
    v = (Y - F.lit(src.y0)) / F.lit(src.dy) - 0.5
    return _bilinear_from_source(cand, u, v, value_cols, [*keys, out_c, out_r])


def resample_to_size(cells: DataFrame, value_cols: Sequence[str], width: int, height: int,
                     src_width: int | None = None, src_height: int | None = None,
                     c: str = "c", r: str = "r") -> DataFrame:
    """Nearest-neighbour resample of a raster to ``width x height`` cells over
    the same extent (``toRaster(col, w, h)``).

    The source size is that of the layer (last column and row + 1, one
    aggregate inside the plan) unless it is given.
    """
    size = cells.agg((F.max(c) + 1).alias("w"), (F.max(r) + 1).alias("h"))
    sw = F.lit(float(src_width)) if src_width else size.select(F.col("w").cast("double")).scalar()
    sh = F.lit(float(src_height)) if src_height else size.select(F.col("h").cast("double")).scalar()
    df = cells.select(*[F.col(v) for v in value_cols], F.col(c).alias("_sc"), F.col(r).alias("_sr"),
                      sw.alias("_sw"), sh.alias("_sh"))

    def axis(i: str, n: int, size: str) -> Column:
        """Targets whose centres may fall in source cell i (exact test below)."""
        lo = F.floor(F.col(i) * n / F.col(size) - 0.5).cast("int")
        hi = F.ceil((F.col(i) + 1) * n / F.col(size) - 0.5).cast("int")
        return F.sequence(F.greatest(lo, F.lit(0)), F.greatest(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(n - 1))))

    df = df.select("*", F.explode(axis("_sc", width, "_sw")).alias("_tc"))
    df = df.select("*", F.explode(axis("_sr", height, "_sh")).alias("_tr"))
    hit = ((F.floor((F.col("_tc") + 0.5) * (F.col("_sw") / width)) == F.col("_sc"))
           & (F.floor((F.col("_tr") + 0.5) * (F.col("_sh") / height)) == F.col("_sr")))
    return df.filter(hit).select(F.col("_tc").alias("c"), F.col("_tr").alias("r"), *value_cols)


# --- reprojection ----------------------------------------------------------------------

def zoom_for_cell_size(cell_size: float, tile_size: int = 256) -> int:
    """The zoom whose Web Mercator resolution is nearest (by ratio) to a cell
    size in metres."""
    return max(0, round(math.log2(mercator_resolution(0, tile_size) / cell_size)))


Transform = Callable[[DataFrame, str, str, str, str], DataFrame]


def reproject_cells(cells: DataFrame, value_cols: Sequence[str], src: Grid, dst: Grid,
              forward: Transform, inverse: Transform, c: str = "c", r: str = "r",
              out_c: str = "tc", out_r: str = "tr", keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear reprojection between two grids related by a smooth map, cell by
    cell (the plain form that :func:`resample_on_tiles` is tested against).

    ``forward(df, x, y, out_x, out_y)`` adds target coordinates of source
    coordinate columns, ``inverse`` the other way (transforms add columns in
    stages so long series are evaluated once per row).  A source cell's
    bilinear support (centre +- one cell) is mapped forward through its
    corners and edge midpoints; the target pixels inside that box (plus one
    pixel of slack) are its candidates, and each candidate's centre is mapped
    back exactly (no error threshold) to weigh the contribution.
    """
    df = cells.select(*[F.col(v) for v in (*keys, *value_cols)], F.col(c).alias("_sc"), F.col(r).alias("_sr"))
    xc = F.lit(src.x0) + (F.col("_sc") + 0.5) * F.lit(src.dx)
    yc = F.lit(src.y0) + (F.col("_sr") + 0.5) * F.lit(src.dy)
    offsets = [(ox, oy) for ox in (-1, 0, 1) for oy in (-1, 0, 1) if (ox, oy) != (0, 0)]
    pts = F.array(*[F.struct((xc + F.lit(ox * src.dx)).alias("x"), (yc + F.lit(oy * src.dy)).alias("y"))
                    for ox, oy in offsets])
    # support points as rows (8 per cell), mapped forward, reduced to a target index box
    sp = df.select("_sc", "_sr").distinct() if keys else df
    sp = sp.select("_sc", "_sr", F.explode(pts).alias("_p")).select("_sc", "_sr", "_p.x", "_p.y")
    sp = forward(sp, "x", "y", "_X", "_Y")
    sp = sp.select("_sc", "_sr", ((F.col("_X") - F.lit(dst.x0)) / F.lit(dst.dx) - 0.5).alias("_u"),
                   ((F.col("_Y") - F.lit(dst.y0)) / F.lit(dst.dy) - 0.5).alias("_v"))
    box = sp.groupBy("_sc", "_sr").agg(
        (F.floor(F.min("_u")).cast("int") - 1).alias("_u0"), (F.ceil(F.max("_u")).cast("int") + 1).alias("_u1"),
        (F.floor(F.min("_v")).cast("int") - 1).alias("_v0"), (F.ceil(F.max("_v")).cast("int") + 1).alias("_v1"))
    cand = df.join(box, ["_sc", "_sr"])
    cand = cand.select(*keys, *value_cols, "_sc", "_sr", F.explode(F.sequence("_u0", "_u1")).alias(out_c),
                       F.sequence("_v0", "_v1").alias("_tr_seq"))
    cand = cand.select("*", F.explode("_tr_seq").alias(out_r)).drop("_tr_seq")
    cand = cand.withColumn("_X", F.lit(dst.x0) + (F.col(out_c) + 0.5) * F.lit(dst.dx)) \
               .withColumn("_Y", F.lit(dst.y0) + (F.col(out_r) + 0.5) * F.lit(dst.dy))
    cand = inverse(cand, "_X", "_Y", "_sx", "_sy")
    u = (F.col("_sx") - F.lit(src.x0)) / F.lit(src.dx) - 0.5
    v = (F.col("_sy") - F.lit(src.y0)) / F.lit(src.dy) - 0.5
    return _bilinear_from_source(cand, u, v, value_cols, [*keys, out_c, out_r])


def _lerp(a, b, f):
    return a + f * (b - a)


def _bilinear_numpy(v: list[np.ndarray], w: list[np.ndarray], fx: np.ndarray, fy: np.ndarray) -> np.ndarray:
    """The four corners' bilinear value, NaN for absent ones: complete row or
    column pairs use lerps (exact when the two values are equal), other sets the
    renormalised weights."""
    p = [~np.isnan(x) & (y > 0) for x, y in zip(v, w)]
    n = sum(x.astype(int) for x in p)
    num = sum(np.where(x, y * z, 0.0) for x, y, z in zip(p, w, v))
    den = sum(np.where(x, y, 0.0) for x, y in zip(p, w))
    with np.errstate(all="ignore"):
        out = np.where(den > 0, num / den, np.nan)
        top, bottom = _lerp(v[0], v[1], fx), _lerp(v[2], v[3], fx)
        for k in range(4):
            out = np.where((n == 1) & p[k], v[k], out)
        for (i, j), both in (((0, 1), top), ((2, 3), bottom), ((0, 2), _lerp(v[0], v[2], fy)),
                             ((1, 3), _lerp(v[1], v[3], fy))):
            out = np.where((n == 2) & p[i] & p[j], both, out)
        return np.where(n == 4, _lerp(top, bottom, fy), out)


MapXY = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _reach(at: list[np.ndarray], slack: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Target indices whose centres may lie between a support's corners
    (``slack`` of a target cell for the bend of its edges)."""
    return (np.ceil(np.minimum.reduce(at) - slack).astype(np.int64),
            np.floor(np.maximum.reduce(at) + slack).astype(np.int64))


def route_to_tiles(b: pa.RecordBatch, src: Grid, dst: Grid, forward: MapXY, tile: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch (cells ``_c``, ``_r`` of ``src``) once per work tile
    (``_tx``, ``_ty``) of ``dst`` that their bilinear support reaches."""
    x = src.x0 + (b.column("_c").to_numpy() + 0.5) * src.dx
    y = src.y0 + (b.column("_r").to_numpy() + 0.5) * src.dy
    ends = [forward(x + ox * src.dx, y + oy * src.dy) for ox in (-1, 1) for oy in (-1, 1)]
    u0, u1 = _reach([(X - dst.x0) / dst.dx - 0.5 for X, _ in ends])
    v0, v1 = _reach([(Y - dst.y0) / dst.dy - 0.5 for _, Y in ends])
    near = (u0 <= u1) & (v0 <= v1)
    a0, a1, b0, b1 = u0 // tile, u1 // tile, v0 // tile, v1 // tile
    for i in range(int((a1 - a0)[near].max(initial=-1)) + 1):
        for j in range(int((b1 - b0)[near].max(initial=-1)) + 1):
            at = np.flatnonzero(near & (a0 + i <= a1) & (b0 + j <= b1))
            if len(at):
                part = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array((a0 + i)[at].astype("int32")), pa.array((b0 + j)[at].astype("int32"))],
                    names=[*part.schema.names, "_tx", "_ty"])


def resample_tile(t: pa.Table, n_values: int, src: Grid, dst: Grid, inverse: MapXY,
                  tile: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Target columns, rows and values (NaN: nodata) of a work tile from the
    source cells routed to it.  Corners are looked up among the sorted cells,
    so memory follows the rows routed, not the window they span."""
    sc, sr = t.column("_c").to_numpy().astype(np.int64), t.column("_r").to_numpy().astype(np.int64)
    c0, r0 = int(sc.min()), int(sr.min())
    w, h = int(sc.max()) - c0 + 1, int(sr.max()) - r0 + 1
    flat = (sr - r0) * w + (sc - c0)
    order = np.argsort(flat)
    flat = flat[order]
    if (flat[1:] == flat[:-1]).any():
        raise ValueError("several rows for one cell: name the layer columns in keys")
    tc, tr = np.meshgrid(t.column("_tx")[0].as_py() * tile + np.arange(tile),
                         t.column("_ty")[0].as_py() * tile + np.arange(tile))
    tc, tr = tc.ravel(), tr.ravel()
    x, y = inverse(dst.x0 + (tc + 0.5) * dst.dx, dst.y0 + (tr + 0.5) * dst.dy)
    u, v = (x - src.x0) / src.dx - 0.5, (y - src.y0) / src.dy - 0.5
    i0, j0 = np.floor(u), np.floor(v)
    inside = (i0 >= c0 - 1) & (i0 < c0 + w) & (j0 >= r0 - 1) & (j0 < r0 + h)
    tc, tr, u, v, i0, j0 = (a[inside] for a in (tc, tr, u, v, i0, j0))
    fx, fy = u - i0, v - j0
    i0, j0 = i0.astype(np.int64) - c0, j0.astype(np.int64) - r0
    weights = [(1.0 - fx) * (1.0 - fy), fx * (1.0 - fy), (1.0 - fx) * fy, fx * fy]
    corners = []
    for di, dj in ((0, 0), (1, 0), (0, 1), (1, 1)):
        i, j = i0 + di, j0 + dj
        key = j * w + i
        at = np.minimum(np.searchsorted(flat, key), len(flat) - 1)
        corners.append((order[at], (flat[at] == key) & (i >= 0) & (i < w) & (j >= 0) & (j < h)))
    found = []
    for k in range(n_values):
        values = t.column(f"_v{k}").to_pandas().to_numpy(dtype="float64")
        found.append(_bilinear_numpy([np.where(ok, values[at], np.nan) for at, ok in corners], weights, fx, fy))
    some = ~np.logical_and.reduce([np.isnan(f) for f in found])
    return tc[some], tr[some], [f[some] for f in found]


def resample_on_tiles(cells: DataFrame, value_cols: Sequence[str], src: Grid, dst: Grid,
                      forward: MapXY, inverse: MapXY, c: str = "c", r: str = "r", out_c: str = "tc",
                      out_r: str = "tr", keys: Sequence[str] = (), tile: int = 128) -> DataFrame:
    """Bilinear resampling onto ``dst`` with one shuffle.

    ``forward`` and ``inverse`` map source to target coordinates and back
    (numpy arrays).  Each source cell's bilinear support (its centre +- one
    cell) is mapped forward and the cell goes to the work tile of ``tile`` x
    ``tile`` target cells that the support reaches: one tile for most cells, two
    or four at tile borders (the halo), none where no target centre is in
    reach.  One grouped map per tile and key maps every target centre back
    exactly and gathers its four neighbours among the cells routed there.
    ``keys`` (scene, time, band ...) keep layers apart; several rows of one
    cell and key fail.
    """
    ensure_on_executors(cells.sparkSession)
    values, keys = list(value_cols), list(keys)
    rows = cells.select(*keys, F.col(c).cast("int").alias("_c"), F.col(r).cast("int").alias("_r"),
                        *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    routed_schema = T.StructType([*rows.schema.fields, T.StructField("_tx", T.IntegerType()),
                                  T.StructField("_ty", T.IntegerType())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from route_to_tiles(b, src, dst, forward, tile)

    out_schema = T.StructType([*[rows.schema[k] for k in keys], T.StructField(out_c, T.IntegerType()),
                               T.StructField(out_r, T.IntegerType()),
                               *[T.StructField(v, T.DoubleType()) for v in values]])

    def per_tile(t: pa.Table) -> pa.Table:
        tc, tr, found = resample_tile(t, len(values), src, dst, inverse, tile)
        cols = [pa.array([t.column(k)[0].as_py()] * len(tc), t.schema.field(k).type) for k in keys]
        cols += [pa.array(tc.astype("int32")), pa.array(tr.astype("int32"))]
        cols += [pa.array(f, mask=np.isnan(f)) for f in found]
        return pa.Table.from_arrays(cols, names=[*keys, out_c, out_r, *values])

    routed = rows.mapInArrow(route, routed_schema)
    return routed.groupBy(*keys, "_tx", "_ty").applyInArrow(per_tile, out_schema)


def _same(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return x, y


def regrid_bilinear(cells: DataFrame, value_cols: Sequence[str], src: Grid, dst: Grid,
                    c: str = "c", r: str = "r", out_c: str = "tc", out_r: str = "tr",
                    keys: Sequence[str] = ()) -> DataFrame:
    """Bilinear regrid between two axis-aligned grids (see :func:`resample_on_tiles`)."""
    return resample_on_tiles(cells, value_cols, src, dst, _same, _same, c, r, out_c, out_r, keys)


def _lonlat_to_mercator(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.radians(lon) * EARTH_RADIUS, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * EARTH_RADIUS


def _mercator_to_lonlat(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.degrees(x / EARTH_RADIUS), np.degrees(np.arctan(np.exp(y / EARTH_RADIUS)) * 2 - np.pi / 2)


def _to_mercator(cells: DataFrame, value_cols: Sequence[str], src: Grid, zoom: int, tile_size: int,
                 forward: MapXY, inverse: MapXY, c: str, r: str, keys: Sequence[str]) -> DataFrame:
    res = mercator_resolution(zoom, tile_size)
    dst = Grid(-MERCATOR_HALF_WORLD, MERCATOR_HALF_WORLD, res, -res)
    out = resample_on_tiles(cells, value_cols, src, dst, forward, inverse, c, r, "px", "py", keys)
    return out.select(F.lit(zoom).alias("zoom"), *keys, "px", "py",
                      F.floor(F.col("px") / tile_size).cast("int").alias("col_key"),
                      F.floor(F.col("py") / tile_size).cast("int").alias("row_key"), *value_cols)


def reproject_lonlat_to_mercator(cells: DataFrame, value_cols: Sequence[str], src: Grid,
                                 zoom: int | None = None, tile_size: int = 256, c: str = "c",
                                 r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """Reproject a lon/lat raster (``src`` in degrees, north-up: negative dy)
    onto the zoomed Web Mercator pixel grid with bilinear sampling.

    Output: zoom, keys, px, py (global pixel, py from the north edge), col_key,
    row_key (tile of ``tile_size``), values.  Every target pixel centre is
    transformed back to lon/lat exactly (no error threshold).  ``zoom`` defaults
    to the level whose resolution is nearest to the source cell size.
    """
    if zoom is None:
        zoom = zoom_for_cell_size(abs(src.dx) * MERCATOR_HALF_WORLD / 180.0, tile_size)
    return _to_mercator(cells, value_cols, src, zoom, tile_size, _lonlat_to_mercator, _mercator_to_lonlat, c, r, keys)


def reproject_utm_to_mercator(cells: DataFrame, value_cols: Sequence[str], src: Grid, zone: int,
                              zoom: int | None = None, south: bool = False, tile_size: int = 256,
                              c: str = "c", r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """UTM raster (metres, north-up) -> zoomed Web Mercator pixels, bilinear;
    output and ``zoom`` as in :func:`reproject_lonlat_to_mercator`."""
    from dunegrid.functions.geometry import utm_forward_np, utm_inverse_np

    if zoom is None:
        zoom = zoom_for_cell_size(abs(src.dx), tile_size)

    def forward(x, y):
        return _lonlat_to_mercator(*utm_inverse_np(x, y, zone, south))

    def inverse(X, Y):
        return utm_forward_np(*_mercator_to_lonlat(X, Y), zone, south)

    return _to_mercator(cells, value_cols, src, zoom, tile_size, forward, inverse, c, r, keys)


def with_zorder(df: DataFrame, c: str = "c", r: str = "r", out: str = "z") -> DataFrame:
    """Add the Morton (Z-order) code of the cell key."""
    return df.withColumn(out, morton2(F.col(c), F.col(r)))

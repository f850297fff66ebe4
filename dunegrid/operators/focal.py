"""Focal (neighbourhood) operators with a halo exchange.

Cells are grouped into square work tiles of ``tile_size``; a cell within
``radius`` of a tile edge is also sent to the neighbouring tile(s), so every
tile receives its own cells plus a border strip of width ``radius`` (about
4 radius / tile_size extra rows).  Each tile is then processed as one dense
numpy array in an Arrow grouped map; a group never
holds more than (tile_size + 2 radius)^2 cells, whatever the raster size.  Small
windows are sorted; the median of large ones runs a histogram of rank codes.

Window semantics: square window of (2 radius + 1)^2 cells; nodata cells are
skipped; windows at the raster edge are clipped (only existing cells count);
results are produced for the cells present in the input.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dunegrid.operators.assembly import _fail_if
from dunegrid.session import ensure_on_executors

FOCAL_STATS = ("median", "mean", "min", "max", "sum", "count")


#: From this radius on the median runs a histogram instead of sorting windows.
RUNNING_FROM = 4


def running_median(arr: np.ndarray, radius: int) -> np.ndarray:
    """Median of the data cells in every (2 radius + 1)^2 window (NaN if none).

    Values are coded by rank.  Every row keeps a histogram of its window in two
    levels (codes, and cells of about the square root of their number); a step
    to the next column takes one column of 2 radius + 1 codes out and one in,
    for all rows at once, and two short running sums find the middle ranks.  So a
    cell costs 2 (2 radius + 1) updates, not the window's (2 radius + 1)^2
    values, and no window is copied.
    """
    h, w = arr.shape
    data = ~np.isnan(arr)
    values, codes = np.unique(arr[data], return_inverse=True)
    out = np.full(arr.shape, np.nan)
    if not len(values):
        return out
    side = int(np.ceil(np.sqrt(len(values))))
    many = side * side
    padded = np.full((h + 2 * radius, w + 2 * radius), -1, np.int64)
    inner = padded[radius:radius + h, radius:radius + w]
    inner[data] = codes.ravel()
    fine, coarse = np.zeros(h * many, np.int32), np.zeros(h * side, np.int32)
    n, row = np.zeros(h, np.int64), np.arange(h)

    def step(column: int, sign: int) -> None:
        at = np.lib.stride_tricks.sliding_window_view(padded[:, column], 2 * radius + 1)
        known = at >= 0
        r, code = np.nonzero(known)[0], at[known]
        np.add.at(fine, r * many + code, np.int32(sign))
        np.add.at(coarse, r * side + code // side, np.int32(sign))
        n.__iadd__(sign * known.sum(axis=1))

    def value_at(rank: np.ndarray, upto: np.ndarray) -> np.ndarray:
        cell = np.minimum((upto <= rank[:, None]).sum(axis=1), side - 1)
        left = rank - np.where(cell > 0, upto[row, np.maximum(cell - 1, 0)], 0)
        inside = np.cumsum(fine.reshape(h, side, side)[row, cell], axis=1)
        code = cell * side + np.minimum((inside <= left[:, None]).sum(axis=1), side - 1)
        return values[np.minimum(code, len(values) - 1)]

    for column in range(2 * radius):
        step(column, 1)
    for x in range(w):
        step(x + 2 * radius, 1)
        if x:
            step(x - 1, -1)
        upto = np.cumsum(coarse.reshape(h, side), axis=1)
        low, high = value_at((n - 1) // 2, upto), value_at(n // 2, upto)
        out[:, x] = np.where(n > 0, np.where(low == high, low, (low + high) / 2), np.nan)
    return out


def _focal_numpy(arr: np.ndarray, radius: int, stat: str) -> np.ndarray:
    """Focal statistic of a 2-D float array with NaN as nodata (same shape out)."""
    if stat == "median" and radius >= RUNNING_FROM:
        return running_median(arr, radius)
    k = 2 * radius + 1
    padded = np.pad(arr, radius, mode="constant", constant_values=np.nan)
    win = np.lib.stride_tricks.sliding_window_view(padded, (k, k))
    flat = win.reshape(arr.shape[0], arr.shape[1], k * k)
    with np.errstate(all="ignore"):
        import warnings
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", category=RuntimeWarning)
            if stat == "median":
                return np.nanmedian(flat, axis=2)
            if stat == "mean":
                return np.nanmean(flat, axis=2)
            if stat == "min":
                return np.nanmin(flat, axis=2)
            if stat == "max":
                return np.nanmax(flat, axis=2)
            cnt = np.sum(~np.isnan(flat), axis=2).astype("float64")
            if stat == "count":
                return cnt
            s = np.nansum(flat, axis=2)
            s[cnt == 0] = np.nan
            return s


def focal(cells: DataFrame, value_col: str | Sequence[str], radius: int = 2, stat: str = "median",
          tile_size: int = 256, c: str = "c", r: str = "r", out: str | None = None,
          duplicates: str = "error", keys: Sequence[str] = ()) -> DataFrame:
    """Focal statistic of ``value_col`` (one column or several, in one pass)
    over a (2 radius + 1)^2 square window.

    ``keys`` (scene, time ...) keep layers apart.  A cell of a layer holds one
    row: more than one fails, unless ``duplicates`` (max, min, mean, or first
    by ``(duplicates, order column)``) says how to reduce them.  Returns
    (keys..., c, r, values...); ``out`` renames a single value column.
    """
    if stat not in FOCAL_STATS:
        raise ValueError(f"stat must be one of {FOCAL_STATS}")
    if radius < 0 or radius >= tile_size:
        raise ValueError("radius must be in [0, tile_size)")
    ensure_on_executors(cells.sparkSession)
    values = [value_col] if isinstance(value_col, str) else list(value_col)
    names = [out] if out and len(values) == 1 else values
    keys = list(keys)
    T_ = int(tile_size)
    if duplicates != "error":
        # one value per cell (partial aggregation), so a hot cell cannot
        # inflate a tile group
        if isinstance(duplicates, tuple):
            red = [F.min_by(v, duplicates[1]).alias(v) for v in values]
        else:
            fn = {"max": F.max, "min": F.min, "mean": F.avg}[duplicates]
            red = [fn(v).alias(v) for v in values]
        cells = cells.groupBy(*keys, F.col(c).alias(c), F.col(r).alias(r)).agg(*red)
    tc = F.floor(F.col(c) / T_).cast("int")
    tr = F.floor(F.col(r) / T_).cast("int")
    lc = F.col(c) - tc * T_
    lr = F.col(r) - tr * T_
    # destination tiles: own tile, plus neighbours for cells in the border strip
    targets = []
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            cond = F.lit(True)
            if ox == -1:
                cond = cond & (lc < radius)
            if ox == 1:
                cond = cond & (lc >= T_ - radius)
            if oy == -1:
                cond = cond & (lr < radius)
            if oy == 1:
                cond = cond & (lr >= T_ - radius)
            targets.append(F.when(cond, F.struct((tc + ox).alias("tx"), (tr + oy).alias("ty"))))
    routed = cells.select(
        *keys, F.col(c).cast("int").alias("_c"), F.col(r).cast("int").alias("_r"),
        *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)],
        F.explode(F.filter(F.array(*targets), lambda s: s.isNotNull())).alias("_t"))
    routed = routed.select(*keys, F.col("_t.tx").alias("_tx"), F.col("_t.ty").alias("_ty"), "_c", "_r",
                           *[f"_v{i}" for i in range(len(values))])
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("c", T.IntegerType()),
                           T.StructField("r", T.IntegerType()),
                           *[T.StructField(n, T.DoubleType()) for n in names]])

    def per_tile(t: pa.Table) -> pa.Table:
        tx, ty = t.column("_tx")[0].as_py(), t.column("_ty")[0].as_py()
        x0, y0 = tx * T_ - radius, ty * T_ - radius
        size = T_ + 2 * radius
        at_c, at_r = t.column("_c").to_numpy(), t.column("_r").to_numpy()
        cc, rr = at_c - x0, at_r - y0
        seen = np.zeros((size, size), bool)
        seen[rr, cc] = True
        if int(seen.sum()) != t.num_rows:
            raise ValueError("several rows for one cell: name the layer columns in keys")
        own = (at_c >= tx * T_) & (at_c < (tx + 1) * T_) & (at_r >= ty * T_) & (at_r < (ty + 1) * T_)
        n = int(own.sum())
        cols = [pa.array([t.column(k)[0].as_py()] * n, t.schema.field(k).type) for k in keys]
        cols += [pa.array(at_c[own].astype("int32")), pa.array(at_r[own].astype("int32"))]
        for i in range(len(values)):
            arr = np.full((size, size), np.nan)
            arr[rr, cc] = t.column(f"_v{i}").to_pandas().to_numpy(dtype="float64")
            res = _focal_numpy(arr, radius, stat)[rr[own], cc[own]]
            cols.append(pa.array(res, mask=np.isnan(res)))
        return pa.Table.from_arrays(cols, names=[*keys, "c", "r", *names])

    return routed.groupBy(*keys, "_tx", "_ty").applyInArrow(per_tile, schema)


def focal_sql(cells_sql: str, radius: int, stat_sql: str = "median", value: str = "v") -> str:
    """Reference SQL (explode-the-window form) for the oracle."""
    return f"""
SELECT t.c, t.r, {stat_sql}(s.{value}) AS {value}
FROM ({cells_sql}) t JOIN ({cells_sql}) s
  ON s.c BETWEEN t.c - {radius} AND t.c + {radius} AND s.r BETWEEN t.r - {radius} AND t.r + {radius}
GROUP BY t.c, t.r"""


def _strip(value_col: str, ox: int, oy: int, rad: int):
    """The strip a tile sends to its neighbour at (ox, oy), row by row: for
    ox = +1 its last ``rad`` columns, for -1 its first (rows alike).  Only the
    strip's own entries are touched."""
    cols, rows = F.col("cols"), F.col("rows")
    w = F.lit(rad) if ox else cols
    h = F.lit(rad) if oy else rows
    left = cols - rad if ox == 1 else F.lit(0)
    top = rows - rad if oy == 1 else F.lit(0)
    if not ox:  # whole rows are one slice
        return F.slice(value_col, (top * cols + 1).cast("int"), (h * cols).cast("int"))
    return F.transform(F.sequence(F.lit(0), (w * h - 1).cast("int")), lambda i: F.element_at(
        value_col, ((top + F.floor(i / w)) * cols + left + i % w + 1).cast("int")))


def focal_tiles(tiles: DataFrame, radius: int = 2, stat: str = "median",
                value_col: str = "cells", keys: Sequence[str] = ()) -> DataFrame:
    """Focal statistic on the ``tiles`` form with a halo exchange of array strips.

    Every tile sends its whole array to itself and, to each of its 8
    neighbours, only the strip that neighbour needs (``radius`` columns,
    rows or a corner block); the strips travel as arrays, not as one row per
    cell.  One grouped map per tile reassembles the padded array, applies the
    window and returns the tile (edge windows clipped, nodata skipped).
    ``keys`` (scene, time, band ...) keep layers apart; two tiles of one key
    fail.  Tiles of one column (row) of tiles share their width (height); the
    last ones may be smaller, but not smaller than ``radius``.
    """
    if stat not in FOCAL_STATS:
        raise ValueError(f"stat must be one of {FOCAL_STATS}")
    ensure_on_executors(tiles.sparkSession)
    rad, keys = int(radius), list(keys)
    extra = [x for x in ("col_off", "row_off") if x in tiles.columns]
    parts = []
    for ox in (-1, 0, 1):
        for oy in (-1, 0, 1):
            strip = _strip(value_col, ox, oy, rad) if (ox, oy) != (0, 0) else F.col(value_col)
            if rad or (ox, oy) == (0, 0):
                parts.append(F.struct(F.lit(ox).alias("ox"), F.lit(oy).alias("oy"), strip.alias("strip")))
    fits = _fail_if((F.col("cols") < rad) | (F.col("rows") < rad), "a tile is smaller than the radius")
    routed = tiles.filter(fits).select(*keys, "col_key", "row_key", "cols", "rows", *extra,
                                       F.explode(F.array(*parts)).alias("p"))
    routed = routed.select(*keys, (F.col("col_key") + F.col("p.ox")).alias("_tx"),
                           (F.col("row_key") + F.col("p.oy")).alias("_ty"),
                           F.col("p.ox").alias("_ox"), F.col("p.oy").alias("_oy"), "cols", "rows", *extra,
                           F.col("p.strip").alias("_strip"))
    ints = ["col_key", "row_key", "cols", "rows", *extra]
    schema = T.StructType([*[tiles.schema[k] for k in keys], *[T.StructField(n, T.IntegerType()) for n in ints],
                           T.StructField(value_col, T.ArrayType(T.DoubleType()))])
    list_type = pa.list_(pa.float64())

    def per_tile(t: pa.Table) -> pa.Table:
        ox, oy = t.column("_ox").to_numpy(), t.column("_oy").to_numpy()
        own = np.flatnonzero((ox == 0) & (oy == 0))
        if len(own) > 1:
            raise ValueError("several tiles for one key: name the layer columns in keys")
        found = {n: [] for n in [*keys, *ints, value_col]}
        if len(own):  # else only neighbours sent strips: no tile here
            me = int(own[0])
            cols, rows = t.column("cols")[me].as_py(), t.column("rows")[me].as_py()
            arr = np.full((rows + 2 * rad, cols + 2 * rad), np.nan)
            for i in range(t.num_rows):
                vals = t.column("_strip")[i].values.to_pandas().to_numpy(dtype="float64")  # NULL -> NaN
                w = rad if ox[i] else cols
                h = rad if oy[i] else rows
                if len(vals) != w * h:
                    raise ValueError("neighbouring tiles differ in width or height")
                # the sender sits at offset (-ox, -oy) from this tile
                x0 = {0: rad, 1: 0, -1: rad + cols}[int(ox[i])]
                y0 = {0: rad, 1: 0, -1: rad + rows}[int(oy[i])]
                arr[y0:y0 + h, x0:x0 + w] = vals.reshape(h, w)
            res = _focal_numpy(arr, rad, stat)[rad:rad + rows, rad:rad + cols].ravel()
            for k in keys:
                found[k].append(t.column(k)[me].as_py())
            at = {"col_key": t.column("_tx")[me], "row_key": t.column("_ty")[me]}
            for n in ints:
                found[n].append((at[n] if n in at else t.column(n)[me]).as_py())
            found[value_col].append(res)
        arrays = [pa.array(found[k], t.schema.field(k).type) for k in keys]
        arrays += [pa.array(found[n], pa.int32()) for n in ints] + [pa.array(found[value_col], list_type)]
        return pa.Table.from_arrays(arrays, names=[*keys, *ints, value_col])

    done = routed.groupBy(*keys, "_tx", "_ty").applyInArrow(per_tile, schema)
    # NaN travelled as the nodata mark; it becomes NULL on the JVM side
    return done.withColumn(value_col, F.transform(value_col, lambda v: F.when(~F.isnan(v), v)))

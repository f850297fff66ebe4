"""A table of polygons met with cells or tiles through a tile-cover index.

Input is a vertex table (polygon, ring, ord, x, y): rings close themselves, the
even-odd rule makes holes and parts, polygons may overlap and there may be any
number of them.  Cell (c, r) belongs to a polygon when its centre
(c + 0.5, r + 0.5) does.

With u = x - 0.5, v = y - 0.5 the centres are whole points.  An edge that
passes between row r's ends of it flips the parity of all cells from column
k = ceil(u at v = r) on, so every edge is turned into (polygon, r, k) *flips*,
equal ones cancelling in a partial aggregate.

``tile_cover`` marks, per polygon, the tiles of a regular grid as

* *boundary*, where an edge passes: the tile holds, for each of its rows, the
  parity at its first column and the flips behind it;
* *inside*, where no edge passes and the scan line along the tile row's first
  cells is inside; such a tile holds nothing else.

Cells then meet the cover by one equi-join on the tile key, and only those of
boundary tiles are tested, against the few flips of their own row.  A polygon's
cover grows with its outline (boundary) and area in tiles (inside), never with
the raster; no polygon, ring or row of tiles is gathered: edges come from
positions of a distributed sort, flips are partial aggregates, and what a
window sorts is at most the tile columns of one polygon's row.

NULL coordinates or polygon ids fail; rings of fewer than three vertices
enclose nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dunegrid.operators.assembly import _fail_if
from dunegrid.operators.ordering import with_position
from dunegrid.session import materialize

#: Values of one step of a long sequence, so that no array is long.
_FAR = 4096


def edges_of(vertices: DataFrame) -> DataFrame:
    """(polygon, u1, v1, u2, v2): every ring's edges, its last vertex joined to the first."""
    bad = F.col("polygon").isNull() | F.col("x").isNull() | F.col("y").isNull()
    rows = vertices.filter(_fail_if(bad, "vertices need a polygon, x and y")).select(
        "polygon", "ring", "ord", (F.col("x") - 0.5).alias("u"), (F.col("y") - 0.5).alias("v"))
    at = with_position(rows, ["polygon", "ring", "ord"])
    ends = at.groupBy("polygon", "ring").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    # a vertex follows the one before it, a ring's first one its last
    before = at.select("polygon", "ring", "u", "v", (F.col("pos") + 1).alias("next"))
    last = before.join(ends, ["polygon", "ring"]).select(
        "polygon", "u", "v", F.when(F.col("next") > F.col("hi"), F.col("lo")).otherwise(F.col("next")).alias("next"))
    return last.join(at.select("pos", F.col("u").alias("u2"), F.col("v").alias("v2")), F.col("next") == F.col("pos")).select(
        "polygon", F.col("u").alias("u1"), F.col("v").alias("v1"), "u2", "v2")


def _between(df: DataFrame, lo, hi, name: str) -> DataFrame:
    """One row per whole number from ``lo`` to ``hi`` (none if hi < lo), in two steps."""
    far, near = f"_far_{name}", f"_hi_{name}"
    df = df.withColumn(near, hi).withColumn(far, F.explode(F.when(
        lo <= F.col(near), F.sequence(lo, F.col(near), F.lit(_FAR).cast("long")))))
    return df.withColumn(name, F.explode(F.sequence(far, F.least(F.col(far) + (_FAR - 1), F.col(near))))).drop(far, near)


def flips_of(edges: DataFrame) -> DataFrame:
    """(polygon, r, k): where a row's parity flips, equal pairs cancelled."""
    lo, hi = F.ceil(F.least("v1", "v2")).cast("long"), F.ceil(F.greatest("v1", "v2")).cast("long") - 1
    rows = _between(edges, lo, hi, "r")
    y = F.col("r").cast("double") + 0.5
    x1, x2, y1, y2 = (F.col(k) + 0.5 for k in ("u1", "u2", "v1", "v2"))
    crossing = x1 + (y - y1) * (x2 - x1) / (y2 - y1)
    return rows.select("polygon", "r", F.ceil(crossing - 0.5).cast("long").alias("k")).groupBy("polygon", "r", "k").agg(
        F.count(F.lit(1)).alias("n")).filter("n % 2 = 1").drop("n")


def boundary_of(edges: DataFrame, tile: int) -> DataFrame:
    """(polygon, row_key, col_key) of the tiles that an edge passes."""
    u1, u2, v1, v2 = (F.col(k) for k in ("u1", "u2", "v1", "v2"))
    rows = _between(edges, F.floor(F.least(v1, v2) / tile).cast("long"), F.floor(F.greatest(v1, v2) / tile).cast("long"),
                    "row_key")
    # the part of the edge inside the tile row, widened by a rounding error's worth
    low = F.greatest(F.least(v1, v2), (F.col("row_key") * tile).cast("double"))
    high = F.least(F.greatest(v1, v2), ((F.col("row_key") + 1) * tile).cast("double"))
    at = [F.when(v1 == v2, u).otherwise(u1 + (v - v1) * (u2 - u1) / F.when(v1 != v2, v2 - v1))
          for v, u in ((low, u1), (high, u2))]
    slack = F.lit(1e-6)
    rows = rows.withColumns({"_lo": F.greatest(F.least(*at) - slack, F.least(u1, u2)),
                             "_hi": F.least(F.greatest(*at) + slack, F.greatest(u1, u2))})
    return _between(rows, F.floor(F.col("_lo") / tile).cast("long"), F.floor(F.col("_hi") / tile).cast("long"),
                    "col_key").select("polygon", "row_key", "col_key").distinct()


def tile_cover(vertices: DataFrame, tile: int = 32) -> DataFrame:
    """(polygon, row_key, col_key, lines): ``lines`` is NULL for an inside tile;
    a boundary tile has for each of its rows the parity at its first column
    (``start``) and the columns behind where it flips (``flips``)."""
    edges = materialize(edges_of(vertices), "polygon-edges")
    edge_tiles = boundary_of(edges, tile)
    flips = flips_of(edges).withColumn("col_key", F.floor(F.col("k") / tile).cast("long"))
    first = F.col("k") == F.col("col_key") * tile  # takes effect at the tile's first column
    entries = flips.groupBy("polygon", "r", "col_key").agg(
        F.sum(F.when(first, 1).otherwise(0)).alias("at_start"),
        F.sort_array(F.collect_list(F.when(~first, F.col("k")))).alias("flips"))  # at most ``tile`` columns
    on_edge = edge_tiles.withColumn("r", F.explode(F.sequence(
        F.col("row_key") * tile, F.col("row_key") * tile + (tile - 1)))).drop("row_key").withColumn("edge", F.lit(True))
    rows = on_edge.join(entries, ["polygon", "r", "col_key"], "full").select(
        "polygon", "r", "col_key", F.coalesce("edge", F.lit(False)).alias("edge"),
        F.coalesce("at_start", F.lit(0)).alias("at_start"), F.coalesce("flips", F.array().cast("array<bigint>")).alias("flips"))
    line = Window.partitionBy("polygon", "r").orderBy("col_key")
    change = F.col("at_start") + F.size("flips")
    rows = rows.withColumn("before", F.coalesce(
        F.sum(change).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumns({"start": (F.col("before") + F.col("at_start")) % 2, "row_key": F.floor(F.col("r") / tile).cast("long"),
                             "after": (F.col("before") + change) % 2, "next": F.lead("col_key").over(line)})
    rows = materialize(rows, "polygon-lines")

    boundary = rows.filter("edge").groupBy("polygon", "row_key", "col_key").agg(
        F.sort_array(F.collect_list(F.struct("r", "start", "flips"))).alias("lines"))  # ``tile`` of them
    scan = rows.filter(F.col("r") == F.col("row_key") * tile)
    # tiles from one entry of the scan line to the next, and entries that no edge passes
    gaps = _between(scan.filter("after = 1"), F.col("col_key") + 1, F.col("next") - 1, "gap").select(
        "polygon", "row_key", F.col("gap").alias("col_key"))
    own = scan.filter("after = 1 AND NOT edge").select("polygon", "row_key", "col_key")
    inside = gaps.unionByName(own).withColumn("lines", F.lit(None).cast(boundary.schema["lines"].dataType))
    return boundary.unionByName(inside)


def join_polygons(cells: DataFrame, vertices: DataFrame, tile: int = 32, c: str = "c", r: str = "r") -> DataFrame:
    """``cells`` with a ``polygon`` column: a row per cell and polygon that holds its centre."""
    cover = tile_cover(vertices, tile).select(
        "polygon", F.col("row_key").alias("_row_key"), F.col("col_key").alias("_col_key"), "lines")
    keyed = cells.withColumns({"_rk": F.floor(F.col(r) / tile).cast("long"), "_ck": F.floor(F.col(c) / tile).cast("long")})
    met = keyed.join(cover, (F.col("_rk") == F.col("_row_key")) & (F.col("_ck") == F.col("_col_key")))
    line = F.element_at("lines", (F.col(r) - F.col("_rk") * tile + 1).cast("int"))
    parity = line["start"] + F.size(F.filter(line["flips"], lambda k: k <= F.col(c)))
    return met.filter(F.col("lines").isNull() | (parity % 2 == 1)).select(*cells.columns, "polygon")


def mask_by_polygons(cells: DataFrame, vertices: DataFrame, features: DataFrame, value_cols: Sequence[str],
                     tile: int = 32, c: str = "c", r: str = "r", keys: Sequence[str] = ()) -> DataFrame:
    """One row per cell (``keys``, c, r) in any polygon: its ``value_cols``, how many
    polygons hold it (``polygons``) and the sum of their ``value`` from
    ``features`` (polygon, value); cells outside all polygons are dropped."""
    rows = join_polygons(cells, vertices, tile, c, r).join(features.select("polygon", "value"), "polygon")
    return rows.groupBy(*keys, c, r).agg(
        *[F.first(v).alias(v) for v in value_cols], F.count(F.lit(1)).alias("polygons"), F.sum("value").alias("value"))


def tiles_of_polygons(tiles: DataFrame, vertices: DataFrame, tile: int) -> DataFrame:
    """``tiles`` (col_key, row_key of ``tile`` x ``tile`` cells) with a ``polygon``
    column: a row per tile and polygon that holds a cell of it, decided on the
    cover alone."""
    some = F.col("lines").isNull() | F.exists("lines", lambda s: (s["start"] == 1) | (F.size(s["flips"]) > 0))
    cover = tile_cover(vertices, tile).filter(some).select(
        "polygon", F.col("row_key").alias("_row_key"), F.col("col_key").alias("_col_key"))
    return tiles.join(cover, (F.col("row_key") == F.col("_row_key")) & (F.col("col_key") == F.col("_col_key"))).select(
        *tiles.columns, "polygon")

"""Registered queries: the ``geotiff`` format, scenes of several coordinate
systems in one layer, layouts from metadata rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.functions.geometry import utm_forward_np, utm_inverse_np
from dunegrid.operators import assembly, composite, scenes
from dunegrid.operators import grid as gr
from dunegrid.plans.grid_plans import _CORNER_SUM, _corners_sql, utm_ctes
from dunegrid.plans.registry import register, with_ctes
from dunegrid.session import materialize, scratch_table_path
from dunegrid.sources import catalog, geotiff, geotiff_source
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)
BANDS_SQL = ("sc", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT scene, c, r, {n} AS band, CASE WHEN count({b}) = count(*) THEN max({b}) END AS v FROM px GROUP BY scene, c, r"
    for b, n in zip(td.BANDS, td.BAND_NUMBERS)) + ") WHERE v IS NOT NULL")
#: Rows of windows in a file, and cells of a window.
FILE_ROWS, WINDOW = 4, 32
# Fixed parameters: scenes 0 and 1 lie in UTM zone 48 N, scenes 2 and 3 in zone 49 N,
# a few cells away on the ground, across the zones' common meridian.
ZONE_WEST, ZONE_EAST = 48, 49
WEST = gr.Grid(752000.0, 4500000.0, 30.0, -30.0)
_X, _Y = utm_forward_np(*utm_inverse_np(np.array([WEST.x0 + 1200.0]), np.array([WEST.y0 - 60.0]), ZONE_WEST), ZONE_EAST)
EAST = gr.Grid(float(np.round(_X[0], -1)), float(np.round(_Y[0], -1)), 30.0, -30.0)
SCENE_ZOOM = 12  # what 30 m cells ask for; only the SQL needs to be told


def band_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Every scene's composite, band by band: scene, band, c, r, v."""
    cells = composite.composite(td.px(spark, sf), list(td.BANDS), "max", keys=("scene", "c", "r"))
    each = [F.struct(F.lit(n).alias("band"), F.col(b).alias("v")) for b, n in zip(td.BANDS, td.BAND_NUMBERS)]
    return cells.select("scene", "c", "r", F.explode(F.array(*each)).alias("b")).select("scene", "c", "r", "b.*")


def write_scenes(spark: SparkSession, sf: str, root: str) -> None:
    """A file per scene, band and block of rows, in the scene's own UTM zone."""
    bands = materialize(band_cells(spark, sf), "band-cells")
    width, height = bands.agg(F.max("c") + 1, F.max("r") + 1).first()
    windows = materialize(gr.assemble_tiles(bands, WINDOW, WINDOW, keep=("scene", "band")), "scene-windows")
    block = F.floor(F.col("row_key") / FILE_ROWS)
    top = block * (FILE_ROWS * WINDOW)
    for grid, zone, wanted in ((WEST, ZONE_WEST, F.col("scene") < 2), (EAST, ZONE_EAST, F.col("scene") >= 2)):
        rows = windows.filter(wanted).withColumns({
            "file": F.format_string("scene_%d/part_%d_B%d_REF.TIF", "scene", block, "band"),
            "height": F.least(F.lit(FILE_ROWS * WINDOW), F.lit(height) - top),
            "ymax": F.lit(grid.y0) + top * grid.dy, "row_key": F.col("row_key") % FILE_ROWS})
        geotiff.write_geotiff_windows(rows, root, "file", int(width or 0), F.col("height"), WINDOW, xmin=grid.x0,
                                      ymax=F.col("ymax"), dx=grid.dx, dy=grid.dy, crs=32600 + zone)


def _rounded(value: str) -> str:
    return f"floor(({value}) * 100.0 + 0.5) / 100.0"


def _ingest_sql() -> str:
    def per_zone(z: str, which: str) -> str:
        return f"""SELECT nb.px, nb.py, nm.scene, nm.band, {_CORNER_SUM} AS v
FROM nb{z} nb JOIN sc nm ON nm.c = nb.i AND nm.r = nb.j WHERE nb.w > 0 AND nm.scene {which} GROUP BY ALL"""

    west, east = utm_ctes(WEST, ZONE_WEST, SCENE_ZOOM, "w"), utm_ctes(EAST, ZONE_EAST, SCENE_ZOOM, "e")
    corners = [(f"nb{z}", _corners_sql("px, py").replace("FROM t", f"FROM t{z}")) for z in "we"]
    per = per_zone("w", "< 2").replace("GROUP BY ALL", "GROUP BY nb.px, nb.py, nm.scene, nm.band")
    per += "\nUNION ALL\n" + per_zone("e", ">= 2").replace("GROUP BY ALL", "GROUP BY nb.px, nb.py, nm.scene, nm.band")
    bands = ", ".join(f"{_rounded(f'arg_max(v, scene) FILTER (WHERE band = {n} AND v IS NOT NULL)')} AS {b}"
                      for b, n in zip(td.BANDS, td.BAND_NUMBERS))
    return with_ctes(PX, NM, BANDS_SQL, *west, *east, *corners, ("m", per), body=f"""
SELECT {SCENE_ZOOM} AS zoom, px, py, CAST(floor(px / 256) AS INT) AS col_key, CAST(floor(py / 256) AS INT) AS row_key, {bands}
FROM m GROUP BY px, py""")


@register("ingest_scenes", ops=("A1", "A4", "A5", "A9", "A10", "C2", "C5", "G2", "I3"), sql=_ingest_sql())
def ingest_scenes(spark, sf):
    """From band files of scenes in two UTM zones to a stored Web Mercator layer:
    scan, assemble all bands, choose the zoom, reproject and merge, store, query."""
    root = scratch_table_path(spark, "scenes")
    write_scenes(spark, sf, root)
    geotiff_source.register(spark)
    reader = spark.read.format("geotiff").option("glob", "*_REF.TIF").option("tile_size", 50)
    grids = materialize(scenes.scene_grids(reader.option("cells", "false").load(root)), "scene-grids")
    windows = reader.option("cells", "true").load(root).filter(F.col("band").isin(*td.BAND_NUMBERS))
    cells = scenes.scene_cells(windows, grids, keep=("band",))
    cells = assembly.pivot_bands(cells, ["scene_id", "c", "r"], "band", "v", list(td.BAND_NUMBERS), list(td.BANDS),
                                 require_all=True)
    cells = cells.filter(F.coalesce(*td.BANDS).isNotNull())
    layout = scenes.mercator_layout(grids).first()
    layer = scenes.reproject_scenes(cells, td.BANDS, grids)
    path = scratch_table_path(spark, "catalog")
    target = gr.Grid(layout["x0"], layout["y0"], layout["dx"], layout["dy"])
    catalog.write_catalog(layer.drop("zoom", "col_key", "row_key"), path, "scenes", layout["zoom"], layout["tile_size"],
                          c="px", r="py", grid=target, crs=layout["crs"])
    stored = catalog.read_catalog(spark, path, "scenes", layout["zoom"], c="px", r="py")
    return stored.select("zoom", F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"), "col_key",
                         "row_key", *[(F.floor(F.col(b) * 100.0 + 0.5) / 100.0).alias(b) for b in td.BANDS])


@register("geotiff_source_pushdown", ops=("A1", "A3", "A6", "A11", "B2"), sql=with_ctes(PX, NM, BANDS_SQL, body="""
SELECT CAST(scene AS INT) AS scene, c, r, v FROM sc WHERE band = 5 AND scene IN (1, 3) AND c >= 32 AND c < 64"""))
def geotiff_source_pushdown(spark, sf):
    """Written and read by ``format("geotiff")``; scene, band and window columns are pushed to the scan."""
    geotiff_source.register(spark)
    tiles = gr.assemble_tiles(band_cells(spark, sf), WINDOW, WINDOW, keep=("scene", "band"))
    root = scratch_table_path(spark, "geotiff")
    tiles.select(
        F.format_string("scene_%d/at_%d_%d_B%d_REF.TIF", "scene", "col_key", "row_key", "band").alias("file"), "cols", "rows",
        "cells", (F.col("col_key") * float(WINDOW)).alias("xmin"), (F.col("row_key") * -float(WINDOW)).alias("ymax"),
        F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy")).write.format("geotiff").mode("append").save(root)
    found = spark.read.format("geotiff").option("tile_size", 20).load(root).filter(
        F.col("scene_id").isin("scene_1", "scene_3") & (F.col("band") == 5) & F.col("path").contains("/at_1_"))
    cells = gr.explode_tiles(found, keep=("scene_id", "xmin", "ymax"))
    return cells.filter("v IS NOT NULL").select(
        F.regexp_extract("scene_id", r"(\d+)", 1).cast("int").alias("scene"),
        (F.round("xmin").cast("int") + F.col("col")).alias("c"), (F.col("row") - F.round("ymax").cast("int")).alias("r"), "v")


# A grid row per scene, from the layer's own bounds: origins apart by parts of a cell.
GRIDS_SQL = ("grids", """
SELECT CAST(scene AS INT) AS scene, 500000.0 + 310.0 * scene AS x0, 4500000.0 - 170.0 * scene AS y0,
  max(c) + 1 AS width, max(r) + 1 AS height FROM px GROUP BY scene""")


@register("regrid_scene_layout", ops=("I1", "C5", "D8"), sql=with_ctes(PX, GRIDS_SQL, ("s", """
SELECT CAST(scene AS INT) AS scene, c, r, max(nir) AS nir, max(blue) AS blue FROM px GROUP BY scene, c, r"""), ("lay", """
SELECT min(x0) AS x0, max(y0) AS y0, CAST(ceil((max(x0 + width * 30.0) - min(x0)) / 30.0) AS BIGINT) AS cols,
  CAST(ceil((max(y0) - min(y0 - height * 30.0)) / 30.0) AS BIGINT) AS rows FROM grids"""), ("tc", """
SELECT g.scene, q.t, CAST(floor((lay.x0 + (q.t + 0.5) * 30.0 - g.x0) / 30.0) AS INT) AS c
FROM grids g, lay, (SELECT unnest(range((SELECT cols FROM lay))) AS t) q"""), ("tr", """
SELECT g.scene, q.t, CAST(floor((lay.y0 - (q.t + 0.5) * 30.0 - g.y0) / -30.0) AS INT) AS r
FROM grids g, lay, (SELECT unnest(range((SELECT rows FROM lay))) AS t) q"""), body="""
SELECT CAST(tc.t AS INT) AS c, CAST(tr.t AS INT) AS r, CAST(tc.t // 32 AS INT) AS col_key, CAST(tr.t // 32 AS INT) AS row_key,
  arg_max(nir, s.scene) FILTER (WHERE nir IS NOT NULL) AS nir, arg_max(blue, s.scene) FILTER (WHERE blue IS NOT NULL) AS blue
FROM s JOIN tc ON tc.scene = s.scene AND tc.c = s.c JOIN tr ON tr.scene = s.scene AND tr.r = s.r
GROUP BY tc.t, tr.t"""))
def regrid_scene_layout(spark, sf):
    """Scenes of different origins on the merged extent, grids and layout as rows."""
    cells = td.px(spark, sf).groupBy(F.col("scene").cast("int").alias("scene"), "c", "r").agg(
        F.max("nir").alias("nir"), F.max("blue").alias("blue"))
    s = F.col("scene")
    grids = td.px(spark, sf).groupBy(s.cast("int").alias("scene")).agg(
        (F.max("c") + 1).alias("width"), (F.max("r") + 1).alias("height")).select(
            "scene", F.lit(32648).alias("crs"), (s * 310.0 + 500000.0).alias("x0"), (s * -170.0 + 4500000.0).alias("y0"),
            F.lit(30.0).alias("dx"), F.lit(-30.0).alias("dy"), "width", "height")
    return scenes.regrid_to_layout(cells, ["nir", "blue"], grids, scenes.merged_layout(grids, 32), scene="scene")

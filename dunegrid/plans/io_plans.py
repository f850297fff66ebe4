"""Registered queries: Parquet catalog and GeoTIFF round trips over data
derived from the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunegrid.functions.geometry import morton3
from dunegrid.operators import assembly, composite, mask
from dunegrid.operators import grid as gr
from dunegrid.plans.fixtures import BOX, PERIOD, POLYGON
from dunegrid.plans.grid_plans import NEAREST_DST, NEAREST_MERGE_SQL, SCENES
from dunegrid.plans.registry import register, with_ctes
from dunegrid.session import scratch_table_path
from dunegrid.sources import catalog, delimited, geotiff
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)
BF = ("band_file", td.BAND_FILE_SQL)


@register("catalog_area_time_query", ops=("A9", "A10", "F4", "B4", "B6"),
          sql=with_ctes(PX, body=f"""
SELECT scene, c, r, CAST(acquired AS DATE) AS acquired_day, red, nir FROM px
WHERE c >= {BOX[0]} AND c < {BOX[2]} AND r >= {BOX[1]} AND r < {BOX[3]}
  AND acquired BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"""))
def catalog_area_time_query(spark, sf):
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(td.px(spark, sf), path, layer="px", zoom=0, tile_size=32)
    q = catalog.read_catalog(spark, path, "px", 0, extent=BOX, period=PERIOD)
    return q.select("scene", "c", "r", F.col("acquired").cast("date").alias("acquired_day"), "red", "nir")


# Fixed parameters: days of a time step, and a box across the borders of Morton
# quadrants (columns 63 | 64, rows 7 | 8).
STEP_DAYS, BORDER_BOX = 90, (60, 6, 69, 10)
_BITS3 = " + ".join(f"((({k} >> {b}) & 1) << {3 * b + 2 - d})" for b in range(12)
                    for d, k in enumerate(("col_key", "row_key", "step")))


@register("space_time_keys", ops=("A9", "F4"),
          sql=with_ctes(PX, ("k", f"""
SELECT DISTINCT CAST(c // 4 AS BIGINT) AS col_key, CAST(r // 4 AS BIGINT) AS row_key,
  CAST(date_diff('day', DATE '1970-01-01', CAST(acquired AS DATE)) // {STEP_DAYS} AS BIGINT) AS step FROM px"""), body=f"""
SELECT col_key, row_key, step, {_BITS3} AS zkey FROM k"""))
def space_time_keys(spark, sf):
    """Three-way interleaved codes of tile column, tile row and time step."""
    keys = td.px(spark, sf).select(
        F.floor(F.col("c") / 4).alias("col_key"), F.floor(F.col("r") / 4).alias("row_key"),
        catalog.time_step("acquired", STEP_DAYS).cast("long").alias("step")).distinct()
    return keys.withColumn("zkey", morton3("col_key", "row_key", "step"))


@register("catalog_border_box", ops=("A9", "A10", "F4", "B4"),
          sql=with_ctes(PX, body=f"""
SELECT scene, c, r, count(*) AS n, max(nir) AS nir FROM px
WHERE c >= {BORDER_BOX[0]} AND c < {BORDER_BOX[2]} AND r >= {BORDER_BOX[1]} AND r < {BORDER_BOX[3]}
GROUP BY scene, c, r"""))
def catalog_border_box(spark, sf):
    """A small box that lies in four quadrants of the curve: a few ranges of codes,
    where the codes of its corners span most of the layer."""
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(td.px(spark, sf), path, layer="px", zoom=0, tile_size=2)
    q = catalog.read_catalog(spark, path, "px", 0, extent=BORDER_BOX)
    return q.groupBy("scene", "c", "r").agg(F.count(F.lit(1)).alias("n"), F.max("nir").alias("nir"))


@register("catalog_space_time_query", ops=("A9", "A10", "F4", "B4", "B6"),
          sql=with_ctes(PX, body=f"""
SELECT scene, c, r, CAST(acquired AS DATE) AS acquired_day, red, nir FROM px
WHERE c >= {BORDER_BOX[0]} AND c < {BORDER_BOX[2]} AND r >= {BORDER_BOX[1]} AND r < {BORDER_BOX[3]}
  AND acquired BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"""))
def catalog_space_time_query(spark, sf):
    """Area and period on a layer stored in space-time order."""
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(td.px(spark, sf), path, layer="px", zoom=0, tile_size=4, time_days=STEP_DAYS)
    q = catalog.read_catalog(spark, path, "px", 0, extent=BORDER_BOX, period=PERIOD)
    return q.select("scene", "c", "r", F.col("acquired").cast("date").alias("acquired_day"), "red", "nir")


@register("max_ndvi_from_catalog", ops=("D2", "A9", "A10", "C3", "B6", "H1"),
          sql=with_ctes(PX, ("sel", f"SELECT * FROM px WHERE acquired BETWEEN "
                                    f"TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"),
                        ("inside", mask.inside_polygon_sql(POLYGON, "SELECT DISTINCT c, r FROM sel")),
                        body="""
SELECT c, r, CASE WHEN count(ndvi) = count(*) THEN max(ndvi) END AS ndvi
FROM (SELECT sel.c, sel.r, CASE WHEN nir + red = 0 THEN NULL ELSE (nir - red) / (nir + red) END AS ndvi
      FROM sel JOIN inside USING (c, r)) t
GROUP BY c, r"""))
def max_ndvi_from_catalog(spark, sf):
    """The layer query end to end: layer and zoom, region, period, mask, composite."""
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(td.px(spark, sf), path, layer="px", zoom=0, tile_size=32)
    q = catalog.read_catalog(spark, path, "px", 0, extent=mask.polygon_bbox(POLYGON), period=PERIOD)
    return composite.max_ndvi_composite(q, *PERIOD, region=POLYGON)


@register("catalog_layout", ops=("D8", "A9"),
          sql=with_ctes(PX, body="""
SELECT 'px' AS layer, 0 AS zoom, 32 AS tile_size, 32648 AS crs,
       CAST(min(c) AS INT) AS col_min, CAST(max(c) AS INT) AS col_max,
       CAST(min(r) AS INT) AS row_min, CAST(max(r) AS INT) AS row_max,
       CAST(floor(max(c) / 32.0) AS INT) AS col_key_max, CAST(floor(max(r) / 32.0) AS INT) AS row_key_max,
       count(*) AS n_records, CAST(500000 + 30 * min(c) AS DOUBLE) AS xmin,
       CAST(4500000 - 30 * (max(r) + 1) AS DOUBLE) AS ymin
FROM px"""))
def catalog_layout(spark, sf):
    """The metadata stored with a layer: layout, grid, CRS, bounds and extent."""
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(td.px(spark, sf), path, layer="px", zoom=0, tile_size=32,
                          grid=gr.Grid(500000.0, 4500000.0, 30.0, -30.0), crs=32648)
    return catalog.read_layout(spark, path, "px").select(
        "layer", "zoom", "tile_size", "crs", "col_min", "col_max", "row_min", "row_max", "col_key_max",
        "row_key_max", "n_records", "xmin", "ymin")


@register("delimited_label_means", ops=("A7",),
          sql=with_ctes(PX, body="""
SELECT CAST(scene AS VARCHAR) AS label, count(*) AS n, sum(red) AS red, sum(nir) AS nir FROM px GROUP BY scene"""))
def delimited_label_means(spark, sf):
    """The cells written as delimited text and read back as (features, label)."""
    path = scratch_table_path(spark, "delimited")
    td.px(spark, sf).select("red", "nir", F.col("scene").cast("string")).write.option("header", "false").csv(path)
    rows = delimited.read_labelled_csv(spark, path, ["red", "nir"], assemble=False)
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("red").alias("red"), F.sum("nir").alias("nir"))


@register("driver_collection", ops=("A8",), sql="""
SELECT r_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def driver_collection(spark, sf):
    """A driver-side collection (the few regions) as a DataFrame, joined to a table."""
    regions = [(r["r_regionkey"], r["r_name"]) for r in td.table(spark, sf, "region").collect()]
    df = spark.createDataFrame(regions, "r_regionkey long, r_name string")
    nations = td.table(spark, sf, "nation")
    return nations.join(df, nations["n_regionkey"] == df["r_regionkey"]).groupBy("r_name").agg(
        F.count(F.lit(1)).alias("n"))


@register("geotiff_roundtrip", ops=("A11", "A1", "A3", "A6", "I5", "D5", "I7"),
          sql=with_ctes(PX, NM, body="SELECT c, r, v FROM nm"))
def geotiff_roundtrip(spark, sf):
    # nm -> 32 x 32 tiles, north-up with the origin at (0, 0): x = c, y = -r
    tiles = gr.assemble_tiles(td.max_nir(spark, sf), 32, 32)
    tiles = tiles.select("*", (F.col("col_key") * 32).cast("double").alias("xmin"),
                         (-F.col("row_key") * 32).cast("double").alias("ymax"),
                         F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy"))
    out_dir = scratch_table_path(spark, "geotiff")
    geotiff.write_geotiff(tiles, out_dir)
    back = geotiff.read_geotiff(spark, out_dir, tile_size=16, glob="*.TIF")
    cells = gr.explode_tiles(back, keep=("xmin", "ymax", "dx", "dy"))
    c = (F.round(F.col("xmin") / F.col("dx")) + F.col("col")).cast("int")
    r = (F.round(F.col("ymax") / F.col("dy")) + F.col("row")).cast("int")
    return cells.filter(F.col("v").isNotNull()).select(c.alias("c"), r.alias("r"), "v")


#: Rows of windows in a file of ``edge_windows``.
FILE_ROWS = 2


def edge_windows(spark, cells, out_dir: str):
    """Cells (c, r, v) written as a streamed file per block of rows, so that files
    and tasks grow with the layer, and scanned in windows that divide neither a
    file's width nor its height; rows come from the files' ymax."""
    width, height = cells.agg(F.max("c") + 1, F.max("r") + 1).first()
    block = F.floor(F.col("row_key") / FILE_ROWS)
    top = block * (FILE_ROWS * 48)
    tiles = gr.assemble_tiles(cells, 48, 48).withColumns({
        "file": F.format_string("layer_%d.TIF", block), "height": F.least(F.lit(FILE_ROWS * 48), F.lit(height) - top),
        "ymax": -top, "row_key": F.col("row_key") % FILE_ROWS})
    geotiff.write_geotiff_windows(tiles, out_dir, "file", int(width or 0), F.col("height"), 48, ymax=F.col("ymax"))
    back = gr.explode_tiles(geotiff.read_geotiff(spark, out_dir, tile_size=37), keep=("ymax",))
    r = (F.col("row") - F.col("ymax")).cast("int").alias("r")
    return back.filter(F.col("v").isNotNull()).select("c", r, "v")


@register("geotiff_edge_windows", ops=("A1", "A3", "A6", "A11", "I5", "I7"),
          sql=with_ctes(PX, NM, body="SELECT c, r, v FROM nm"))
def geotiff_edge_windows(spark, sf):
    return edge_windows(spark, td.max_nir(spark, sf), scratch_table_path(spark, "geotiff"))


# Fixed parameters: (query suffix, compression, sample type, predictor).
ENCODINGS = (("lzw", "lzw", "f8", False), ("lzw_predictor", "lzw", "i4", True),
             ("deflate_predictor", "deflate", "i4", True), ("plain_int", "none", "i4", False))


def _encoded_round_trip(how: str, dtype: str, predictor: bool):
    """Red, nir and nullable blue as three samples of each pixel, written in one
    encoding and scanned back."""
    def run(spark, sf):
        bands = ("red", "nir", "blue")
        cells = composite.composite(td.px(spark, sf), bands, "max")
        tiles = [gr.assemble_tiles(cells.select("c", "r", F.col(b).alias("v")), 32, 32).select(
            "col_key", "row_key", "cols", "rows", F.col("cells").alias(b)) for b in bands]
        joined = tiles[0].join(tiles[1].drop("cols", "rows"), ["col_key", "row_key"]).join(
            tiles[2].drop("cols", "rows"), ["col_key", "row_key"])
        woven = F.flatten(F.zip_with(F.zip_with(bands[0], bands[1], lambda a, b: F.array(a, b)), bands[2],
                                     lambda ab, c: F.concat(ab, F.array(c))))
        rasters = joined.select(
            "col_key", "row_key", "cols", "rows", woven.alias("cells"), F.lit(3).alias("samples"),
            (F.col("col_key") * 32.0).alias("xmin"), (-F.col("row_key") * 32.0).alias("ymax"),
            F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy"))
        out_dir = scratch_table_path(spark, "geotiff")
        geotiff.write_geotiff(rasters, out_dir, compress=how, dtype=dtype, predictor=predictor,
                              nodata=None if dtype[0] == "f" else -2147483648)
        back = geotiff.read_geotiff(spark, out_dir, tile_size=20)
        cells = gr.explode_tiles(back, keep=("xmin", "ymax", "sample")).filter(F.col("v").isNotNull())
        return cells.select((F.col("xmin").cast("int") + F.col("col")).alias("c"),
                            (F.col("row") - F.col("ymax").cast("int")).alias("r"), "sample", "v")
    return run


for _name, _how, _dtype, _predictor in ENCODINGS:
    register(f"geotiff_{_name}", ops=("A1", "A6", "A11"), sql=with_ctes(
        PX, ("m", "SELECT c, r, max(red) AS red, max(nir) AS nir, "
                  "CASE WHEN count(blue) = count(*) THEN max(blue) END AS blue FROM px GROUP BY c, r"), body="""
SELECT c, r, 0 AS sample, red AS v FROM m UNION ALL SELECT c, r, 1, nir FROM m
UNION ALL SELECT c, r, 2, blue FROM m WHERE blue IS NOT NULL"""))(_encoded_round_trip(_how, _dtype, _predictor))


@register("geotiff_band_scan", ops=("A1", "A2", "A4", "A5", "C2", "G1", "B2"),
          sql=with_ctes(PX, BF, body="""
SELECT 'scene_' || CAST(CAST(string_split(string_split(path, '/')[3], '_')[2] AS INT) AS VARCHAR) AS scene_id,
  CAST(floor(cx) AS INT) AS c, CAST(floor(cy) AS INT) AS r,
  max(CASE WHEN band_index = 0 THEN v END) AS b0, max(CASE WHEN band_index = 1 THEN v END) AS b1,
  max(CASE WHEN band_index = 2 THEN v END) AS b2, max(CASE WHEN band_index = 3 THEN v END) AS b3,
  max(CASE WHEN band_index = 4 THEN v END) AS b4, max(CASE WHEN band_index = 5 THEN v END) AS b5
FROM band_file GROUP BY 1, 2, 3
HAVING count(v) > 0"""))
def geotiff_band_scan(spark, sf):
    bf = td.band_file(spark, sf)
    cells = bf.select(F.regexp_extract("path", r"scene_(\d+)", 1).cast("int").alias("scene"),
                      (F.col("band_index") + 2).alias("band"),
                      F.floor("cx").cast("int").alias("c"), F.floor("cy").cast("int").alias("r"), "v")
    # the windows of each (scene, band) stream into one file of the layer's size
    size = cells.agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h")).first()
    windows = gr.assemble_tiles(cells, 32, 32, keep=("scene", "band"))
    windows = windows.withColumn("file", F.format_string("scene_%s/S_B%s_REF.TIF", F.col("scene").cast("string"),
                                                         F.col("band").cast("string")))
    root = scratch_table_path(spark, "bands")
    geotiff.write_geotiff_windows(windows, root, "file", int(size["w"]), int(size["h"]), 32, crs=32648)
    # scan: discover files, cut windows, decode, tag band index, assemble bands
    tiles = geotiff.with_scene_and_band(geotiff.read_geotiff(spark, root, tile_size=64, glob="*_REF.TIF"))
    px_cells = gr.explode_tiles(tiles, keep=("scene_id", "band"))
    px_cells = px_cells.select(
        "scene_id", assembly.tag_band_index(F.col("band"), [2, 3, 4, 5, 6, 7]).alias("band_index"), "c", "r", "v")
    out = assembly.pivot_bands(px_cells, ["scene_id", "c", "r"], "band_index", "v", list(range(6)))
    any_data = F.lit(False)
    for i in range(6):
        any_data = any_data | F.col(f"b{i}").isNotNull()
    return out.filter(any_data)


@register("ingest_to_catalog", ops=("A1", "A4", "A5", "A9", "A10", "C1", "G2", "I1", "I4"),
          sql=with_ctes(PX, NM, SCENES, ("m", NEAREST_MERGE_SQL), body="""
SELECT CAST(floor(tc / 2) AS INT) AS c, CAST(floor(tr / 2) AS INT) AS r,
       round(avg(nir), 6) AS nir, round(avg(blue), 6) AS blue
FROM m GROUP BY 1, 2"""))
def ingest_to_catalog(spark, sf):
    """From band files to a queried zoom: discover, scan, join bands, lay out on
    the target grid with the scenes merged, store, build the pyramid, query."""
    scenes = composite.composite(td.px(spark, sf), ["nir", "blue"], "max", keys=("scene", "c", "r"))
    bands = scenes.select("scene", "c", "r", F.explode(F.array(
        F.struct(F.lit(5).alias("band"), F.col("nir").alias("v")),
        F.struct(F.lit(2).alias("band"), F.col("blue").alias("v")))).alias("b")).select("scene", "c", "r", "b.*")
    size = bands.agg((F.max("c") + 1).alias("w"), (F.max("r") + 1).alias("h")).first()
    windows = gr.assemble_tiles(bands, 32, 32, keep=("scene", "band")).withColumn(
        "file", F.format_string("scene_%d/S_B%d_REF.TIF", "scene", "band"))
    root = scratch_table_path(spark, "bands")
    geotiff.write_geotiff_windows(windows, root, "file", int(size["w"]), int(size["h"]), 32)

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    files = assembly.discover_band_files(listed, [5, 2]).select("path", "scene_id", "band_index")
    tiles = geotiff.read_geotiff(spark, root, tile_size=50).join(files, "path")
    cells = gr.explode_tiles(tiles, keep=("scene_id", "band_index"))
    joined = assembly.pivot_bands(cells, ["scene_id", "c", "r"], "band_index", "v", [0, 1], ["nir", "blue"],
                                  require_all=True).filter("nir is not null or blue is not null")
    layer = gr.regrid_nearest(joined, ["nir", "blue"], gr.Grid(), NEAREST_DST, out_c="c2", out_r="r2",
                              priority_col="scene_id").withColumnsRenamed({"c2": "c", "r2": "r"})
    path = scratch_table_path(spark, "catalog")
    catalog.write_catalog(layer, path, "scenes", 0, tile_size=16, grid=NEAREST_DST)
    gr.build_pyramid(catalog.read_catalog(spark, path, "scenes", 0), ["nir", "blue"], out_path=path, layer="scenes",
                     tile_size=16)
    return catalog.read_catalog(spark, path, "scenes", 1).select(
        "c", "r", F.round("nir", 6).alias("nir"), F.round("blue", 6).alias("blue"))

"""Registered queries: selection, local algebra, composites, assembly, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dunegrid.functions import indices as ix
from dunegrid.operators import assembly, composite, mask, stats
from dunegrid.plans.fixtures import BOX, PERIOD, POLYGON
from dunegrid.plans.registry import register, with_ctes
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)
BF = ("band_file", td.BAND_FILE_SQL)

NDVI_SQL = "CASE WHEN nir + red = 0 THEN NULL ELSE (nir - red) / (nir + red) END"


def _inside_sql(cells_sql: str) -> str:
    return mask.inside_polygon_sql(POLYGON, cells_sql)


# --- D2: the flagship layer query ------------------------------------------------

@register("max_ndvi_composite", ops=("D2", "D1", "B6", "B5", "C3", "H1", "H2", "B3", "I5"),
          sql=with_ctes(PX, ("sel", f"SELECT * FROM px WHERE acquired BETWEEN "
                                    f"TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}'"),
                        ("inside", _inside_sql("SELECT DISTINCT c, r FROM sel")),
                        body=f"""
SELECT c, r, CASE WHEN count(ndvi) = count(*) THEN max(ndvi) END AS ndvi
FROM (SELECT sel.c, sel.r, {NDVI_SQL} AS ndvi FROM sel JOIN inside USING (c, r)) t
GROUP BY c, r"""))
def max_ndvi_composite(spark, sf):
    return composite.max_ndvi_composite(td.px(spark, sf), *PERIOD, region=POLYGON)


@register("max_ndvi_composite_period", ops=("D1", "B6", "H1"),
          sql=with_ctes(PX, body=f"""
SELECT c, r, CASE WHEN count(ndvi) = count(*) THEN max(ndvi) END AS ndvi
FROM (SELECT c, r, {NDVI_SQL} AS ndvi FROM px
      WHERE acquired BETWEEN TIMESTAMP '{PERIOD[0]}' AND TIMESTAMP '{PERIOD[1]}') t
GROUP BY c, r"""))
def max_ndvi_composite_period(spark, sf):
    return composite.max_ndvi_composite(td.px(spark, sf), *PERIOD)


@register("max_composite_bands", ops=("D1", "B3"),
          sql=with_ctes(PX, body="""
SELECT c, r,
  CASE WHEN count(blue) = count(*) THEN max(blue) END AS blue,
  max(red) AS red, max(nir) AS nir
FROM px GROUP BY c, r"""))
def max_composite_bands(spark, sf):
    p = td.px(spark, sf)
    # one aggregate with a nodata policy per band
    return composite.composite(p, ["blue", "red", "nir"], "max",
                               nodata={"blue": "propagate", "red": "ignore", "nir": "ignore"})


# --- B4 / B5 / C3: area selection ------------------------------------------------

@register("extent_filter", ops=("B4",),
          sql=with_ctes(PX, body=f"""
SELECT c, r, count(*) AS n_obs FROM px
WHERE c >= {BOX[0]} AND c < {BOX[2]} AND r >= {BOX[1]} AND r < {BOX[3]}
GROUP BY c, r"""))
def extent_filter(spark, sf):
    df = mask.filter_extent(td.px(spark, sf), *BOX)
    return df.groupBy("c", "r").agg(F.count(F.lit(1)).alias("n_obs"))


@register("polygon_mask", ops=("C3", "B5"),
          sql=with_ctes(PX, NM, ("inside", _inside_sql("SELECT c, r FROM nm")),
                        body="SELECT nm.c, nm.r, nm.v FROM nm JOIN inside USING (c, r)"))
def polygon_mask(spark, sf):
    return mask.mask_polygon(td.max_nir(spark, sf), POLYGON)


@register("polygon_mask_to_nodata", ops=("C3",),
          sql=with_ctes(PX, NM, ("inside", _inside_sql("SELECT c, r FROM nm")),
                        body="""
SELECT nm.c, nm.r, CASE WHEN inside.c IS NULL THEN NULL ELSE nm.v END AS v
FROM nm LEFT JOIN inside USING (c, r)"""))
def polygon_mask_to_nodata(spark, sf):
    return mask.mask_polygon(td.max_nir(spark, sf), POLYGON, keep_outside=True, value_cols=["v"])


# --- H*: spectral indices and band algebra ------------------------------------------

@register("spectral_indices", ops=("H1", "H3", "H5", "H6", "H7", "H10", "B1", "B16"),
          sql=with_ctes(PX, body=f"""
SELECT scene, c, r,
  {NDVI_SQL} AS ndvi,
  blue * 0.356 + red * 0.13 + nir * 0.373 + swir1 * 0.085 + swir2 * 0.072 - 0.0018 AS albedo,
  CASE WHEN (nir * 2 + 1) * (nir * 2 + 1) - (nir - red) * 8 >= 0
       THEN ((nir * 2 + 1) - abs(sqrt((nir * 2 + 1) * (nir * 2 + 1) - (nir - red) * 8))) / 2 END AS msavi,
  CASE WHEN red + blue + green = 0 THEN NULL ELSE (red - blue) / (red + blue + green) END AS tgsi,
  blue + green + red + nir + swir1 + swir2 AS band_sum
FROM px"""))
def spectral_indices(spark, sf):
    p = td.px(spark, sf)
    return p.select(
        "scene", "c", "r",
        ix.ndvi("red", "nir").alias("ndvi"),
        ix.albedo("blue", "red", "nir", "swir1", "swir2").alias("albedo"),
        ix.msavi("red", "nir").alias("msavi"),
        ix.tgsi("blue", "green", "red").alias("tgsi"),
        ix.band_sum(*td.BANDS).alias("band_sum"))


@register("threshold_bands", ops=("B8", "B15", "B11"),
          sql=with_ctes(PX, body="""
SELECT scene, c, r,
  CASE WHEN blue <= 10000 THEN blue END AS blue, CASE WHEN green <= 10000 THEN green END AS green,
  CASE WHEN red <= 10000 THEN red END AS red, CASE WHEN nir <= 10000 THEN nir END AS nir,
  CASE WHEN swir1 <= 10000 THEN swir1 END AS swir1, CASE WHEN swir2 <= 10000 THEN swir2 END AS swir2
FROM px"""))
def threshold_bands(spark, sf):
    p = td.px(spark, sf)
    return p.select("scene", "c", "r", *[ix.threshold(b, 10000).alias(b) for b in td.BANDS])


@register("rgb_composite", ops=("B12", "B13", "B14"),
          sql=with_ctes(PX, body="""
SELECT scene, c, r,
  CAST(floor((CASE WHEN red IS NULL THEN NULL ELSE least(greatest(red, 1000.0), 3000.0) END - 1000.0) * 255 / 2000.0 + 0) AS INT) AS red8,
  CAST(floor((CASE WHEN green IS NULL THEN NULL ELSE least(greatest(green, 1000.0), 3000.0) END - 1000.0) * 255 / 2000.0 + 0) AS INT) AS green8,
  CAST(floor((CASE WHEN blue IS NULL THEN NULL ELSE least(greatest(blue, 1000.0), 3000.0) END - 1000.0) * 255 / 2000.0 + 0) AS INT) AS blue8
FROM px"""))
def rgb_composite(spark, sf):
    p = td.px(spark, sf)
    return p.select("scene", "c", "r", ix.rgb("red", "green", "blue", 1000.0, 3000.0).alias("rgb")) \
        .select("scene", "c", "r", F.col("rgb.r").alias("red8"), F.col("rgb.g").alias("green8"),
                F.col("rgb.b").alias("blue8"))


@register("data_cells", ops=("B9", "D9"),
          sql=with_ctes(PX, body="""
SELECT scene, count(blue) AS n_data, count(*) AS n_cells FROM px GROUP BY scene"""))
def data_cells(spark, sf):
    p = td.px(spark, sf)
    return p.groupBy("scene").agg(F.count("blue").alias("n_data"), F.count(F.lit(1)).alias("n_cells"))


@register("normalize_layer", ops=("H4", "D6"),
          sql=with_ctes(PX, NM, body="""
SELECT c, r, CASE WHEN (SELECT max(v) FROM nm) - (SELECT min(v) FROM nm) = 0 THEN NULL
  ELSE (v - (SELECT min(v) FROM nm)) / ((SELECT max(v) FROM nm) - (SELECT min(v) FROM nm)) END AS v
FROM nm"""))
def normalize_layer(spark, sf):
    return stats.normalize(td.max_nir(spark, sf), "v")


@register("normalize_per_scene", ops=("H4",),
          sql=with_ctes(PX, ("s", "SELECT scene, c, r, max(nir) AS v FROM px GROUP BY scene, c, r"),
                        ("mm", "SELECT scene, min(v) AS lo, max(v) AS hi FROM s GROUP BY scene"),
                        body="""
SELECT s.scene, s.c, s.r, CASE WHEN hi - lo = 0 THEN NULL ELSE (v - lo) / (hi - lo) END AS v
FROM s JOIN mm USING (scene)"""))
def normalize_per_scene(spark, sf):
    s = td.px(spark, sf).groupBy("scene", "c", "r").agg(F.max("nir").alias("v"))
    return stats.normalize(s, "v", by=["scene"])


@register("layer_minmax", ops=("D6", "D9"),
          sql=with_ctes(PX, NM, body="""
SELECT min(v) AS vmin, max(v) AS vmax, count(v) AS n_data, count(*) AS n_cells FROM nm"""))
def layer_minmax(spark, sf):
    return stats.min_max(td.max_nir(spark, sf), "v")


@register("layer_metadata", ops=("D8", "C5"),
          sql=with_ctes(PX, body="""
SELECT min(c) AS col_min, max(c) AS col_max, min(r) AS row_min, max(r) AS row_max,
       count(*) AS n_records, count(DISTINCT scene) AS n_crs,
       CAST(min(acquired) AS DATE) AS t_min, CAST(max(acquired) AS DATE) AS t_max
FROM px"""))
def layer_metadata(spark, sf):
    md = assembly.layer_metadata(td.px(spark, sf), crs_col="scene", time_col="acquired")
    return md.withColumn("t_min", F.col("t_min").cast("date")).withColumn("t_max", F.col("t_max").cast("date"))


@register("merged_scene_metadata", ops=("C5", "D8"),
          sql=with_ctes(PX, body="""
SELECT CAST(500000 + 30 * min(c) AS DOUBLE) AS xmin, CAST(4500000 - 30 * (max(r) + 1) AS DOUBLE) AS ymin,
       CAST(500000 + 30 * (max(c) + 1) AS DOUBLE) AS xmax, CAST(4500000 - 30 * min(r) AS DOUBLE) AS ymax,
       32648 AS crs, CAST(30 AS DOUBLE) AS dx, CAST(-30 AS DOUBLE) AS dy
FROM px"""))
def merged_scene_metadata(spark, sf):
    """Each scene's extent, CRS and cell size (30 m cells of a UTM raster), merged into the layer's."""
    x, y = (lambda v: F.lit(500000.0) + v * 30.0), (lambda v: F.lit(4500000.0) - v * 30.0)
    parts = td.px(spark, sf).groupBy("scene").agg(
        x(F.min("c")).alias("xmin"), y(F.max("r") + 1).alias("ymin"), x(F.max("c") + 1).alias("xmax"),
        y(F.min("r")).alias("ymax")).select("*", F.lit(32648).alias("crs"), F.lit(30.0).alias("dx"),
                                            F.lit(-30.0).alias("dy"))
    return assembly.merge_metadata(parts)


@register("ndvi_percentiles", ops=("D7",),
          sql=with_ctes(PX, body=f"""
SELECT p, round(v, 6) AS value FROM (
  SELECT CAST(0.1 AS DOUBLE) AS p, quantile_cont({NDVI_SQL}, 0.1) AS v FROM px
  UNION ALL SELECT CAST(0.5 AS DOUBLE), quantile_cont({NDVI_SQL}, 0.5) FROM px
  UNION ALL SELECT CAST(0.95 AS DOUBLE), quantile_cont({NDVI_SQL}, 0.95) FROM px) t"""))
def ndvi_percentiles(spark, sf):
    nd = td.px(spark, sf).select(ix.ndvi("red", "nir").alias("ndvi"))
    res = stats.exact_percentiles(nd, "ndvi", [0.1, 0.5, 0.95])
    return res.select(F.col("p").cast("decimal(3,2)").cast("double").alias("p"),
                      F.round("value", 6).alias("value"))


@register("ndvi_quantile_breaks", ops=("D7", "H8"),
          sql=with_ctes(PX, ("nd", f"SELECT {NDVI_SQL} AS ndvi FROM px"), body="""
SELECT CAST(unnest(range(1, 20)) AS INT) AS break_index,
       round(unnest(quantile_cont(ndvi, CAST(""" + repr([i / 20 for i in range(1, 20)]) + """ AS DOUBLE[]))), 6) AS value
FROM nd"""))
def ndvi_quantile_breaks(spark, sf):
    nd = td.px(spark, sf).select(ix.ndvi("red", "nir").alias("ndvi"))
    return stats.quantile_breaks(nd, "ndvi", 20).select("break_index", F.round("value", 6).alias("value"))


@register("ndvi_histogram", ops=("D7",),
          sql=with_ctes(PX, body=f"""
SELECT CAST(floor((ndvi - (-1.0)) / 0.1) AS BIGINT) AS bin, count(*) AS n
FROM (SELECT {NDVI_SQL} AS ndvi FROM px) t WHERE ndvi IS NOT NULL GROUP BY 1"""))
def ndvi_histogram(spark, sf):
    nd = td.px(spark, sf).select(ix.ndvi("red", "nir").alias("ndvi"))
    return stats.histogram(nd, "ndvi", -1.0, 0.1)


@register("fvc", ops=("H8", "H9"),
          sql=with_ctes(PX, ("nd", f"SELECT scene, c, r, {NDVI_SQL} AS ndvi FROM px"),
                        ("q", "SELECT quantile_cont(ndvi, 0.1) AS soil, quantile_cont(ndvi, 0.95) AS veg FROM nd"),
                        body="""
SELECT scene, c, r, round(CASE WHEN veg - soil = 0 THEN NULL ELSE (ndvi - soil) / (veg - soil) END, 6) AS fvc
FROM nd, q"""))
def fvc_query(spark, sf):
    nd = td.px(spark, sf).select("scene", "c", "r", ix.ndvi("red", "nir").alias("ndvi"))
    out = stats.fvc_from_quantiles(nd, "ndvi", 0.10, 0.95)
    return out.select("scene", "c", "r", F.round("fvc", 6).alias("fvc"))


# --- G1 / G2: unions and mosaics -----------------------------------------------------

@register("mosaic_last", ops=("G2",),
          sql=with_ctes(PX, ("s", """
SELECT scene, c, r, max(nir) AS nir, CASE WHEN count(blue) = count(*) THEN max(blue) END AS blue
FROM px GROUP BY scene, c, r"""), body="""
SELECT c, r, arg_max(nir, scene) AS nir, arg_max(blue, scene) FILTER (WHERE blue IS NOT NULL) AS blue
FROM s GROUP BY c, r"""))
def mosaic_last(spark, sf):
    # blue is nodata in some scenes of most cells: the layer below shows there
    s = composite.composite(td.px(spark, sf), ["nir", "blue"], "max", keys=("scene", "c", "r"))
    return composite.mosaic(s, ["nir", "blue"], "last", layer_col="scene")


@register("mosaic_mean", ops=("G2",),
          sql=with_ctes(PX, ("s", "SELECT scene, c, r, max(nir) AS nir FROM px GROUP BY scene, c, r"),
                        body="SELECT c, r, round(avg(nir), 6) AS nir FROM s GROUP BY c, r"))
def mosaic_mean(spark, sf):
    s = td.px(spark, sf).groupBy("scene", "c", "r").agg(F.max("nir").alias("nir"))
    m = composite.mosaic(s, ["nir"], "mean")
    return m.select("c", "r", F.round("nir", 6).alias("nir"))


@register("union_band_scans", ops=("G1",),
          sql=with_ctes(PX, BF, body="""
SELECT band_index, count(*) AS n, count(v) AS n_data FROM band_file GROUP BY band_index"""))
def union_band_scans(spark, sf):
    bf = td.band_file(spark, sf)
    scans = [bf.filter(F.col("band_index") == i) for i in range(6)]
    u = composite.union_layers(scans)
    return u.groupBy("band_index").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_data"))


# --- A4 / A5 / C1 / C2: discovery, tagging, assembly ----------------------------------

@register("band_discovery", ops=("A4", "A5"),
          sql=with_ctes(PX, BF, body="""
SELECT DISTINCT string_split(path, '/')[-2] AS scene_id,
       CAST(regexp_extract(path, '_B(\\d+)_REF\\.TIF$', 1) AS INT) AS band,
       CAST(list_position([4, 5, 3], CAST(regexp_extract(path, '_B(\\d+)_REF\\.TIF$', 1) AS INT)) - 1 AS INT) AS band_index,
       path
FROM band_file
WHERE CAST(regexp_extract(path, '_B(\\d+)_REF\\.TIF$', 1) AS INT) IN (4, 5, 3)"""))
def band_discovery(spark, sf):
    files = assembly.discover_band_files(td.band_file(spark, sf), [4, 5, 3])
    return files.select("scene_id", "band", "band_index", "path")


@register("band_assembly", ops=("C2", "D3", "D4"),
          sql=with_ctes(PX, BF, body="""
SELECT string_split(path, '/')[-2] AS scene_id, round(cx, 5) AS x, round(cy, 5) AS y,
  max(CASE WHEN band_index = 0 THEN v END) AS b0, max(CASE WHEN band_index = 1 THEN v END) AS b1,
  max(CASE WHEN band_index = 2 THEN v END) AS b2, max(CASE WHEN band_index = 3 THEN v END) AS b3,
  max(CASE WHEN band_index = 4 THEN v END) AS b4, max(CASE WHEN band_index = 5 THEN v END) AS b5,
  count(DISTINCT band_index) AS n_bands
FROM band_file GROUP BY 1, 2, 3"""))
def band_assembly(spark, sf):
    return assembly.assemble_bands(td.band_file(spark, sf), 6)


@register("spatial_join_bands", ops=("C1", "B2"), sql=f"""
WITH px AS MATERIALIZED ({td.PX_SQL}), band_file AS MATERIALIZED ({td.BAND_FILE_SQL}), k AS MATERIALIZED (
  SELECT string_split(path, '/')[-2] AS scene_id, CAST(floor(cx) AS INT) AS c, CAST(floor(cy) AS INT) AS r, band_index, v
  FROM band_file WHERE v IS NOT NULL OR band_index > 0)
SELECT scene_id, c, r, b0.v AS blue, b1.v AS green, b2.v AS red, b3.v AS nir, b4.v AS swir1, b5.v AS swir2
FROM (SELECT * FROM k WHERE band_index = 0) b0
JOIN (SELECT * FROM k WHERE band_index = 1) b1 USING (scene_id, c, r)
JOIN (SELECT * FROM k WHERE band_index = 2) b2 USING (scene_id, c, r)
JOIN (SELECT * FROM k WHERE band_index = 3) b3 USING (scene_id, c, r)
JOIN (SELECT * FROM k WHERE band_index = 4) b4 USING (scene_id, c, r)
JOIN (SELECT * FROM k WHERE band_index = 5) b5 USING (scene_id, c, r)""")
def spatial_join_bands(spark, sf):
    """All scenes, all six bands; a scene's blue layer has no record where it
    is nodata, so those cells are in no joined record."""
    bf = td.band_file(spark, sf).filter(F.col("v").isNotNull() | (F.col("band_index") > 0))
    keyed = bf.select(assembly.scene_of_path("path").alias("scene_id"), F.floor("cx").cast("int").alias("c"),
                      F.floor("cy").cast("int").alias("r"), "band_index", "v")
    return assembly.pivot_bands(keyed, ["scene_id", "c", "r"], "band_index", "v", list(range(6)),
                                list(td.BANDS), require_all=True)


# --- A12 / B7 / A13 / C4 / B10 -------------------------------------------------------

@register("sql_view_predicate", ops=("A12", "B7"),
          sql=with_ctes(PX, body="""
SELECT scene, count(*) AS n, round(avg(nir), 6) AS nir_mean FROM px WHERE scene <> 0 GROUP BY scene"""))
def sql_view_predicate(spark, sf):
    name = f"px_{uuid.uuid4().hex[:8]}"
    td.px(spark, sf).createOrReplaceTempView(name)
    return spark.sql(f"SELECT scene, count(*) AS n, round(avg(nir), 6) AS nir_mean "
                     f"FROM {name} WHERE scene != 0 GROUP BY scene")


@register("inspect_label_features", ops=("A13",),
          sql=with_ctes(PX, body="""
SELECT DISTINCT CAST(scene AS VARCHAR) || ':' || CAST(CAST(red AS BIGINT) AS VARCHAR) || ','
       || CAST(CAST(nir AS BIGINT) AS VARCHAR) AS line FROM px"""))
def inspect_label_features(spark, sf):
    p = td.px(spark, sf)
    feats = F.concat_ws(",", F.col("red").cast("bigint").cast("string"),
                        F.col("nir").cast("bigint").cast("string"))
    return p.select(F.concat_ws(":", F.col("scene").cast("string"), feats).alias("line")).distinct()


# class 0 ("sand"): cells whose mean NDVI over time is below 0.25
_SAND_SQL = f"""
SELECT c, r, CASE WHEN avg({NDVI_SQL}) < 0.25 THEN 0 ELSE 1 END AS class FROM px GROUP BY c, r"""


def _sand_classes(spark, sf):
    return (td.px(spark, sf).groupBy("c", "r")
            .agg(F.avg(ix.ndvi("red", "nir")).alias("mean_ndvi"))
            .select("c", "r", F.when(F.col("mean_ndvi") < 0.25, 0).otherwise(1).alias("class")))


@register("class_mask", ops=("C4",),
          sql=with_ctes(PX, NM, ("cls", _SAND_SQL), body="""
SELECT nm.c, nm.r, CASE WHEN cls.class IS NOT NULL AND cls.class <> 0 THEN nm.v END AS v
FROM nm LEFT JOIN cls USING (c, r)"""))
def class_mask(spark, sf):
    return mask.mask_by_class(td.max_nir(spark, sf), _sand_classes(spark, sf), ["v"], drop_class=0)


@register("class_filter", ops=("B10",),
          sql=with_ctes(PX, ("cls", _SAND_SQL), body="SELECT c, r FROM cls WHERE class = 0"))
def class_filter(spark, sf):
    return _sand_classes(spark, sf).filter(F.col("class") == 0).select("c", "r")

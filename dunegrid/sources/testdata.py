"""Raster views over the driver's test tables (see FIXTURES.md section 2).

``px``        multi-temporal six-band cells derived from ``lineitem``;
``tile8``     8 x 8 array tiles derived from ``embeddings``;
``band_file`` one row per (scene, cell, band) with a file-like path, derived
              from ``px`` (the input of band discovery and band assembly).

Each view has a Spark builder and the equivalent SQL text (used by the DuckDB
oracle as a CTE).  Only the columns a view needs are read, so Parquet column
pruning applies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("blue", "green", "red", "nir", "swir1", "swir2")
# Landsat 8 band numbers of the six reflective bands above, in the same order.
BAND_NUMBERS = (2, 3, 4, 5, 6, 7)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """The ``px`` view; ``extra`` lineitem columns are passed through as is."""
    li = table(spark, sf_dir, "lineitem")
    q, ln = F.col("l_quantity"), F.col("l_linenumber")
    return li.select(
        (F.col("l_suppkey") % 4).alias("scene"),
        F.col("l_shipdate").alias("acquired"),
        (F.col("l_partkey") % 128).cast("int").alias("c"),
        F.floor(F.col("l_partkey") / 128.0).cast("int").alias("r"),
        F.when(ln == 7, F.lit(None).cast("double")).otherwise(q * 100).alias("blue"),
        ((q + ln) * 100).alias("green"),
        (F.round(F.col("l_discount") * 100) * 300 + 500).alias("red"),
        F.floor(F.col("l_extendedprice") / 10).cast("double").alias("nir"),
        (F.round(F.col("l_tax") * 100) * 400 + 200).alias("swir1"),
        (ln * 500).cast("double").alias("swir2"),
        *[F.col(x) for x in extra],
    )


PX_SQL = """
SELECT l_suppkey % 4 AS scene, l_shipdate AS acquired,
       CAST(l_partkey % 128 AS INT) AS c, CAST(floor(l_partkey / 128.0) AS INT) AS r,
       CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity * 100 END AS blue,
       (l_quantity + l_linenumber) * 100 AS green,
       round(l_discount * 100) * 300 + 500 AS red,
       CAST(floor(l_extendedprice / 10) AS DOUBLE) AS nir,
       round(l_tax * 100) * 400 + 200 AS swir1,
       CAST(l_linenumber * 500 AS DOUBLE) AS swir2
FROM lineitem
"""


def tile8(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        (F.col("vec_id") % 16).cast("int").alias("col_key"),
        F.floor(F.col("vec_id") / 16).cast("int").alias("row_key"),
        F.lit(8).alias("cols"),
        F.lit(8).alias("rows"),
        F.col("embedding").cast("array<double>").alias("cells"),
        F.col("label"),
    )


TILE8_SQL = """
SELECT CAST(vec_id % 16 AS INT) AS col_key, CAST(floor(vec_id / 16) AS INT) AS row_key,
       8 AS cols, 8 AS rows, CAST(embedding AS DOUBLE[]) AS cells, label
FROM embeddings
"""


def band_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_cell = px(spark, sf_dir).groupBy("scene", "c", "r").agg(
        *[F.max(b).alias(b) for b in BANDS])
    stacked = per_cell.select(
        "scene", "c", "r",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("band"), F.col(b).alias("v"))
            for n, b in zip(BAND_NUMBERS, BANDS)])).alias("s"))
    return stacked.select(
        F.concat(F.lit("/img/scene_"), F.col("scene").cast("string"), F.lit("/S_B"),
                 F.col("s.band").cast("string"), F.lit("_REF.TIF")).alias("path"),
        (F.col("c").cast("double") + 0.5 + F.lit(1e-7) * F.col("s.band")).alias("cx"),
        (F.col("r").cast("double") + 0.5).alias("cy"),
        (F.col("s.band") - 2).alias("band_index"),
        F.col("s.v").alias("v"),
    )


BAND_FILE_SQL = """
SELECT '/img/scene_' || CAST(scene AS VARCHAR) || '/S_B' || CAST(band AS VARCHAR) || '_REF.TIF' AS path,
       CAST(c AS DOUBLE) + 0.5 + 1e-7 * band AS cx,
       CAST(r AS DOUBLE) + 0.5 AS cy,
       band - 2 AS band_index, v
FROM (
  SELECT scene, c, r, 2 AS band, max(blue) AS v FROM px GROUP BY scene, c, r
  UNION ALL SELECT scene, c, r, 3, max(green) FROM px GROUP BY scene, c, r
  UNION ALL SELECT scene, c, r, 4, max(red) FROM px GROUP BY scene, c, r
  UNION ALL SELECT scene, c, r, 5, max(nir) FROM px GROUP BY scene, c, r
  UNION ALL SELECT scene, c, r, 6, max(swir1) FROM px GROUP BY scene, c, r
  UNION ALL SELECT scene, c, r, 7, max(swir2) FROM px GROUP BY scene, c, r
) t
"""


def max_nir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per cell: the maximum ``nir`` over time (``nm``), the usual
    single-layer input of focal, pyramid and classification work."""
    return px(spark, sf_dir).groupBy("c", "r").agg(F.max("nir").alias("v"))


NM_SQL = "SELECT c, r, max(nir) AS v FROM px GROUP BY c, r"

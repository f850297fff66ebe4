"""Registered queries: a table of polygons (from ``customer``) over the cells of ``px``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dunegrid.operators import polygons
from dunegrid.plans.registry import register, with_ctes
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)

# A region per customer: a seven-cornered ring with a triangular hole, placed and
# sized by the key; corners in eighths of a cell, so both engines hold them exactly.
# Fixed values: (ring, ord, x, y) of the shape around its centre.
SHAPE = ((0, 0, -8, -3), (0, 1, -1, -5), (0, 2, 7, -4), (0, 3, 9, 1), (0, 4, 3, 2), (0, 5, 5, 5), (0, 6, -7, 4),
         (1, 0, -4, -2), (1, 1, 2, -3), (1, 2, 0, 2))
VERTICES = ("vertices", f"""
SELECT c_custkey AS polygon, s.ring, s.ord,
  (c_custkey * 37 % 1061) / 8.0 + s.x * (1 + c_custkey % 5) / 4.0 AS x,
  (c_custkey * 53 % 131) / 8.0 + s.y * (1 + c_custkey % 3) / 4.0 AS y
FROM customer, (VALUES {", ".join(map(str, SHAPE))}) s(ring, ord, x, y)""")
FEATURES = ("features", "SELECT c_custkey AS polygon, c_nationkey AS value FROM customer")
# Crossing number of every centre against every edge.
INSIDE = ("inside", """
SELECT n.c, n.r, n.v, e.polygon
FROM nm n JOIN (
  SELECT polygon, x AS x1, y AS y1,
    coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
  FROM vertices WINDOW w AS (PARTITION BY polygon, ring ORDER BY ord)
) e ON (e.y1 > n.r + 0.5) <> (e.y2 > n.r + 0.5)
  AND n.c + 0.5 < e.x1 + ((n.r + 0.5) - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
GROUP BY n.c, n.r, n.v, e.polygon HAVING count(*) % 2 = 1""")


def vertices(spark: SparkSession, sf: str) -> DataFrame:
    shape = F.array(*[F.struct(F.lit(g).alias("ring"), F.lit(o).alias("ord"), F.lit(x).alias("sx"), F.lit(y).alias("sy"))
                      for g, o, x, y in SHAPE])
    k = F.col("c_custkey")
    return td.table(spark, sf, "customer").select("c_custkey", F.explode(shape).alias("s")).select(
        k.alias("polygon"), "s.ring", "s.ord", (k * 37 % 1061 / 8.0 + F.col("s.sx") * (1 + k % 5) / 4.0).alias("x"),
        (k * 53 % 131 / 8.0 + F.col("s.sy") * (1 + k % 3) / 4.0).alias("y"))


def features(spark: SparkSession, sf: str) -> DataFrame:
    return td.table(spark, sf, "customer").select(F.col("c_custkey").alias("polygon"), F.col("c_nationkey").alias("value"))


@register("polygon_table_cells", ops=("C3",), sql=with_ctes(
    PX, NM, VERTICES, INSIDE, body="SELECT polygon, c, r, v FROM inside"))
def polygon_table_cells(spark, sf):
    """Every cell with every region that holds it."""
    return polygons.join_polygons(td.max_nir(spark, sf), vertices(spark, sf), 8).select("polygon", "c", "r", "v")


@register("polygon_table_mask", ops=("C3",), sql=with_ctes(
    PX, NM, VERTICES, FEATURES, INSIDE, body="""
SELECT c, r, v, count(*) AS polygons, CAST(sum(value) AS BIGINT) AS value
FROM inside JOIN features USING (polygon) GROUP BY c, r, v"""))
def polygon_table_mask(spark, sf):
    """The layer masked by all regions, with their feature values summed per cell."""
    return polygons.mask_by_polygons(td.max_nir(spark, sf), vertices(spark, sf), features(spark, sf), ["v"], 8)


@register("polygon_table_tiles", ops=("B5",), sql=with_ctes(
    PX, NM, ("grid", "SELECT DISTINCT c // 4 AS col_key, r // 4 AS row_key FROM nm"),
    ("nm4", """SELECT col_key * 4 + i AS c, row_key * 4 + j AS r, 0 AS v FROM grid,
               (SELECT unnest(range(4)) AS i), (SELECT unnest(range(4)) AS j)"""),
    VERTICES, ("hit", INSIDE[1].replace("FROM nm n", "FROM nm4 n")), body="""
SELECT DISTINCT polygon, CAST(c // 4 AS INT) AS col_key, CAST(r // 4 AS INT) AS row_key FROM hit"""))
def polygon_table_tiles(spark, sf):
    """Tiles of 4 x 4 cells with every region that holds a cell of them."""
    tiles = td.max_nir(spark, sf).select(F.floor(F.col("c") / 4).cast("int").alias("col_key"),
                                         F.floor(F.col("r") / 4).cast("int").alias("row_key")).distinct()
    return polygons.tiles_of_polygons(tiles, vertices(spark, sf), 4).select("polygon", "col_key", "row_key")

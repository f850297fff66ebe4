"""Area, time and class selection: extent / polygon / period filters and masks.

Coordinates are in cell space: the cell (c, r) covers [c, c+1) x [r, r+1) and
its centre is (c + 0.5, r + 0.5); rows grow downward.  Polygons are lists of
rings (each a list of (x, y) vertices, closed implicitly); holes and several
parts are further rings, and the even-odd (crossing-number) rule decides
membership.  A cell belongs to a polygon when its centre does.

Polygon masking never compares every cell with every edge.  The polygon is
turned, on Spark, into a table of inside *spans* per grid row: for row r the
ray y = r + 0.5 crosses the edges at sorted x positions x1 < x2 < ...; the
centre is inside exactly when it lies in one of [x1, x2), [x3, x4), ...  The
cells then meet the spans with an equi-join on the row plus a range test, so
each cell matches at most one span and no aggregation over cells is needed.
The span table grows with the polygon (vertices x rows spanned), never with
the raster; it is broadcast when its counted size is under a bound and
shuffled on the row key otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Ring = Sequence[tuple[float, float]]
Polygon = Sequence[Ring]

EDGE_SCHEMA = T.StructType([
    T.StructField("ring", T.IntegerType()),
    T.StructField("x1", T.DoubleType()), T.StructField("y1", T.DoubleType()),
    T.StructField("x2", T.DoubleType()), T.StructField("y2", T.DoubleType()),
])


def filter_time(df: DataFrame, t0, t1, col: str = "acquired",
                inclusive: tuple[bool, bool] = (True, True)) -> DataFrame:
    """Keep rows acquired in the period; both ends inclusive by default."""
    t = F.col(col)
    lo = F.lit(str(t0)).cast(df.schema[col].dataType)
    hi = F.lit(str(t1)).cast(df.schema[col].dataType)
    cond = (t >= lo) if inclusive[0] else (t > lo)
    cond = cond & ((t <= hi) if inclusive[1] else (t < hi))
    return df.filter(cond)


def filter_extent(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float,
                  c: str = "c", r: str = "r") -> DataFrame:
    """Keep cells whose box [c, c+1) x [r, r+1) meets [xmin, xmax) x [ymin, ymax).

    Written as plain comparisons of the key columns with literals so the
    Parquet reader can prune row groups (and files, when the catalog is
    clustered by key).
    """
    return df.filter((F.col(c) > F.lit(xmin - 1)) & (F.col(c) < F.lit(xmax))
                     & (F.col(r) > F.lit(ymin - 1)) & (F.col(r) < F.lit(ymax)))


def polygon_bbox(polygon: Polygon) -> tuple[float, float, float, float]:
    xs = [p[0] for ring in polygon for p in ring]
    ys = [p[1] for ring in polygon for p in ring]
    return min(xs), min(ys), max(xs), max(ys)


def polygon_edges(spark: SparkSession, polygon: Polygon) -> DataFrame:
    """Edge table (ring, x1, y1, x2, y2) of a polygon literal."""
    rows = []
    for k, ring in enumerate(polygon):
        pts = [(float(x), float(y)) for x, y in ring]
        if len(pts) >= 2 and pts[0] == pts[-1]:
            pts = pts[:-1]
        if len(pts) < 3:
            raise ValueError(f"ring {k} has fewer than 3 vertices")
        for i, (x1, y1) in enumerate(pts):
            x2, y2 = pts[(i + 1) % len(pts)]
            rows.append((k, x1, y1, x2, y2))
    return spark.createDataFrame(rows, EDGE_SCHEMA)


def polygon_spans(spark: SparkSession, polygon: Polygon) -> DataFrame:
    """Inside spans per grid row: (r INT, x_lo DOUBLE, x_hi DOUBLE).

    A centre (cx, r + 0.5) is inside the polygon iff x_lo <= cx < x_hi for a
    span of row r (crossing number with the half-open vertex rule
    ``(y1 > cy) != (y2 > cy)`` and ``cx < x_cross``).
    """
    edges = polygon_edges(spark, polygon).filter(F.col("y1") != F.col("y2"))
    lo_y = F.least("y1", "y2")
    hi_y = F.greatest("y1", "y2")
    # rows whose centre line cy = r + .5 satisfies lo_y <= cy < hi_y
    r_first = F.ceil(lo_y - 0.5).cast("int")
    r_last = (F.ceil(hi_y - 0.5) - 1).cast("int")
    crossing = (edges
                # sequence() counts down when start > stop: guard the empty case
                .withColumn("r", F.explode(F.when(r_first <= r_last, F.sequence(r_first, r_last))))
                .withColumn("cy", F.col("r").cast("double") + 0.5)
                .select("r", (F.col("x1") + (F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1"))
                              / (F.col("y2") - F.col("y1"))).alias("x")))
    w = Window.partitionBy("r").orderBy("x")
    ranked = crossing.withColumn("k", F.row_number().over(w))
    pair = F.floor((F.col("k") - 1) / 2)
    return (ranked.groupBy("r", pair.alias("pair"))
            .agg(F.min("x").alias("x_lo"), F.max("x").alias("x_hi"))
            .filter(F.col("x_lo") < F.col("x_hi"))
            .select("r", "x_lo", "x_hi"))


def mask_polygon(cells: DataFrame, polygon: Polygon, c: str = "c", r: str = "r",
                 keep_outside: bool = False, value_cols: Sequence[str] = ()) -> DataFrame:
    """Cells whose centre lies inside ``polygon``.

    By default cells outside are dropped (absent = nodata in the cells form).
    With ``keep_outside=True`` every cell stays and ``value_cols`` become NULL
    outside, which is the tile-style "mask to nodata".  Whether the span table
    is broadcast is left to Spark, which knows its size at run time.
    """
    spark = cells.sparkSession
    xmin, ymin, xmax, ymax = polygon_bbox(polygon)
    sp = polygon_spans(spark, polygon).select(F.col("r").alias("_span_r"), "x_lo", "x_hi")
    cx = F.col(c).cast("double") + 0.5
    on = (F.col(r) == F.col("_span_r")) & (cx >= F.col("x_lo")) & (cx < F.col("x_hi"))
    if not keep_outside:
        # bbox prefilter: plain key comparisons that reach the Parquet scan
        pre = filter_extent(cells, math.floor(xmin), math.floor(ymin),
                            math.ceil(xmax) + 1, math.ceil(ymax) + 1, c, r)
        return pre.join(sp, on, "inner").drop("_span_r", "x_lo", "x_hi")
    joined = cells.join(sp, on, "left")
    inside = F.col("_span_r").isNotNull()
    out = [F.when(inside, F.col(k)).alias(k) if k in value_cols else F.col(k)
           for k in cells.columns]
    return joined.select(*out)


def filter_tiles_polygon(tiles: DataFrame, polygon: Polygon, cols: int, rows: int) -> DataFrame:
    """Tiles (``col_key``/``row_key`` of ``cols x rows`` cells) holding at least
    one cell whose centre lies in ``polygon``.

    The polygon's inside spans are mapped to the tile keys they cover (a
    table that grows with the polygon, not the raster) and the tiles are
    semi-joined to it, so no tile is exploded into cells.
    """
    spark = tiles.sparkSession
    spans = polygon_spans(spark, polygon)
    # centres c + .5 in [x_lo, x_hi): first and last covered columns
    c_first = F.ceil(F.col("x_lo") - 0.5).cast("int")
    c_last = (F.ceil(F.col("x_hi") - 0.5) - 1).cast("int")
    keys = (spans.filter(c_first <= c_last)
            .select(F.floor(F.col("r") / rows).cast("int").alias("row_key"),
                    F.explode(F.sequence(F.floor(c_first / cols).cast("int"),
                                         F.floor(c_last / cols).cast("int"))).alias("col_key"))
            .distinct())
    return tiles.join(keys, ["col_key", "row_key"], "left_semi")


def mask_by_class(cells: DataFrame, classes: DataFrame, value_cols: Sequence[str],
                  drop_class=0, class_col: str = "class",
                  keys: Sequence[str] = ("c", "r")) -> DataFrame:
    """Cell-aligned class mask: values become nodata where the class equals
    ``drop_class`` (or where no class is known).

    An equi-join on the cell key; when both sides come from aggregations on
    the same key they are already co-partitioned and Spark adds no exchange.
    """
    cls = classes.select(*keys, F.col(class_col).alias("_cls"))
    joined = cells.join(cls, list(keys), "left")
    keep = F.col("_cls").isNotNull() & (F.col("_cls") != F.lit(drop_class))
    return joined.select(*[F.when(keep, F.col(k)).alias(k) if k in value_cols else F.col(k)
                           for k in cells.columns])


def inside_polygon_sql(polygon: Polygon, cells_sql: str) -> str:
    """Reference SQL (brute-force crossing count) for the oracle."""
    vals = []
    for k, ring in enumerate(polygon):
        pts = list(ring)
        for i, (x1, y1) in enumerate(pts):
            x2, y2 = pts[(i + 1) % len(pts)]
            vals.append(f"({k}, CAST({x1} AS DOUBLE), CAST({y1} AS DOUBLE), "
                        f"CAST({x2} AS DOUBLE), CAST({y2} AS DOUBLE))")
    edges = "SELECT * FROM (VALUES " + ", ".join(vals) + ") e(ring, x1, y1, x2, y2)"
    return f"""
SELECT k.c, k.r FROM ({cells_sql}) k, ({edges}) e
WHERE (e.y1 > CAST(k.r AS DOUBLE) + 0.5) <> (e.y2 > CAST(k.r AS DOUBLE) + 0.5)
  AND CAST(k.c AS DOUBLE) + 0.5 < e.x1 + ((CAST(k.r AS DOUBLE) + 0.5) - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)
GROUP BY k.c, k.r HAVING count(*) % 2 = 1
"""


def class_when(value: Column, breaks: Sequence[float]) -> Column:
    """Class number 1..k of ``value`` for ascending break values
    [b0, b1, ..., bk] with right-closed classes (b_{j-1}, b_j]; the first class
    also takes b0 and anything below, the last anything above."""
    uppers = list(breaks)[1:-1]
    expr = F.lit(len(uppers) + 1)
    for j in range(len(uppers), 0, -1):
        expr = F.when(value <= F.lit(float(uppers[j - 1])), F.lit(j)).otherwise(expr)
    return F.when(value.isNotNull(), expr)

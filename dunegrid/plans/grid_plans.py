"""Registered queries: tiles <-> cells, pyramids, focal, regridding, reprojection, Z-order."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dunegrid.functions import indices as ix
from dunegrid.functions.geometry import EARTH_RADIUS, MERCATOR_HALF_WORLD, mercator_resolution
from dunegrid.operators import focal as fo
from dunegrid.operators import grid as gr
from dunegrid.operators import mask as mk
from dunegrid.operators.composite import composite
from dunegrid.plans.fixtures import POLYGON
from dunegrid.plans.registry import register, with_ctes
from dunegrid.session import scratch_table_path
from dunegrid.sources import testdata as td
from dunegrid.sources.catalog import read_catalog

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)
T8 = ("tile8", td.TILE8_SQL)

T8_CELLS_SQL = """
SELECT col_key, row_key, CAST(pos % 8 AS INT) AS col, CAST(pos // 8 AS INT) AS row,
       CAST(col_key * 8 + pos % 8 AS INT) AS c, CAST(row_key * 8 + pos // 8 AS INT) AS r, v
FROM (SELECT col_key, row_key, unnest(generate_series(0, len(cells) - 1)) AS pos, unnest(cells) AS v FROM tile8) t"""


@register("explode_tiles", ops=("I7", "I5"), sql=with_ctes(T8, body=T8_CELLS_SQL))
def explode_tiles(spark, sf):
    return gr.explode_tiles(td.tile8(spark, sf))


@register("assemble_tiles", ops=("D5",),
          sql=with_ctes(T8, ("cells8", T8_CELLS_SQL), body="""
SELECT a.col_key, a.row_key, a.col, a.row, CASE WHEN a.v > 0 THEN a.v END AS v
FROM cells8 a JOIN (SELECT DISTINCT col_key, row_key FROM cells8 WHERE v > 0) t USING (col_key, row_key)"""))
def assemble_tiles(spark, sf):
    """Every cell of the assembled tiles, nodata included."""
    cells = gr.explode_tiles(td.tile8(spark, sf)).filter(F.col("v") > 0)
    return gr.explode_tiles(gr.assemble_tiles(cells, 8, 8)).select("col_key", "row_key", "col", "row", "v")


@register("pyramid_level", ops=("I4",),
          sql=with_ctes(PX, NM, body="""
SELECT CAST(floor(c / 2) AS INT) AS c, CAST(floor(r / 2) AS INT) AS r, round(avg(v), 6) AS v
FROM nm GROUP BY 1, 2"""))
def pyramid_level(spark, sf):
    lvl = gr.pyramid_level(td.max_nir(spark, sf), ["v"])
    return lvl.select("c", "r", F.round("v", 6).alias("v"))


def _pyramid_sql(most: int = 31) -> str:
    """Levels until one cell is left, whatever the bounds (``most`` covers any
    32-bit cell coordinate)."""
    ctes = [PX, ("p0", td.NM_SQL)]
    for k in range(1, most + 1):
        ctes.append((f"b{k}", f"SELECT max(c) > min(c) OR max(r) > min(r) AS more FROM p{k - 1}"))
        ctes.append((f"p{k}", f"SELECT CAST(floor(c / 2) AS INT) AS c, CAST(floor(r / 2) AS INT) AS r, "
                              f"avg(v) AS v FROM p{k - 1} WHERE (SELECT more FROM b{k}) GROUP BY 1, 2"))
    body = " UNION ALL ".join(f"SELECT {k} AS level, c, r, round(v, 6) AS v FROM p{k}"
                              for k in range(1, most + 1))
    return ("WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n[0] == 'p' and n != 'px' else ''}({q.strip()})"
                                 for n, q in ctes) + "\n" + body)


@register("pyramid", ops=("I4",), sql=_pyramid_sql())
def pyramid(spark, sf):
    out = gr.build_pyramid(td.max_nir(spark, sf), ["v"])
    return out.select("level", "c", "r", F.round("v", 6).alias("v"))


PYRAMID_BOX, PYRAMID_QUERY_ZOOM = (3.0, 1.0, 20.0, 6.0), 2


@register("pyramid_catalog_area", ops=("I4", "A9", "A10", "F4"),
          sql=_pyramid_sql().rsplit("\n", 1)[0] + f"""
SELECT c, r, round(v, 6) AS v FROM p{PYRAMID_QUERY_ZOOM}
WHERE c > {PYRAMID_BOX[0] - 1} AND c < {PYRAMID_BOX[2]} AND r > {PYRAMID_BOX[1] - 1} AND r < {PYRAMID_BOX[3]}""")
def pyramid_catalog_area(spark, sf):
    """The pyramid written to a catalog, one zoom of it queried by area."""
    path = scratch_table_path(spark, "pyramid")
    gr.build_pyramid(td.max_nir(spark, sf), ["v"], out_path=path, layer="nir", tile_size=8)
    q = read_catalog(spark, path, "nir", PYRAMID_QUERY_ZOOM, extent=PYRAMID_BOX)
    return q.select("c", "r", F.round("v", 6).alias("v"))


FOCAL_TILE = 32


@register("focal_median", ops=("E1", "E2"),
          sql=with_ctes(PX, NM, body=fo.focal_sql("SELECT c, r, v FROM nm", 2)))
def focal_median(spark, sf):
    return fo.focal(td.max_nir(spark, sf), "v", radius=2, stat="median", tile_size=FOCAL_TILE)


# Fixed parameter: cells on each side of the large window's centre.
LARGE_RADIUS = 9


@register("focal_median_large", ops=("E1", "E2"), sql=with_ctes(PX, NM, body=fo.focal_sql("SELECT c, r, v FROM nm", LARGE_RADIUS)))
def focal_median_large(spark, sf):
    """A 19 x 19 median: the running histogram, over tile borders."""
    return fo.focal(td.max_nir(spark, sf), "v", LARGE_RADIUS, "median", FOCAL_TILE)


_YEAR_LAYERS_SQL = "SELECT scene, CAST(year(acquired) AS INT) AS year, c, r, " + ", ".join(
    f"max(CASE WHEN {b} <= 10000 THEN {b} END) AS {b}" for b in td.BANDS) + " FROM px GROUP BY 1, 2, 3, 4"


@register("threshold_focal_median", ops=("E3", "B8", "E2"),
          sql=with_ctes(PX, ("nt", _YEAR_LAYERS_SQL), body=f"""
SELECT t.scene, t.year, t.c, t.r, {", ".join(f"median(s.{b}) AS {b}" for b in td.BANDS)}
FROM nt t JOIN nt s ON s.scene = t.scene AND s.year = t.year
  AND s.c BETWEEN t.c - 2 AND t.c + 2 AND s.r BETWEEN t.r - 2 AND t.r + 2
GROUP BY t.scene, t.year, t.c, t.r"""))
def threshold_focal_median(spark, sf):
    """All six bands of every scene and year, in one pass."""
    p = td.px(spark, sf).select("scene", F.year("acquired").alias("year"), "c", "r",
                                *[ix.threshold(b, 10000).alias(b) for b in td.BANDS])
    nt = p.groupBy("scene", "year", "c", "r").agg(*[F.max(b).alias(b) for b in td.BANDS])
    return fo.focal(nt, list(td.BANDS), radius=2, stat="median", tile_size=FOCAL_TILE, keys=("scene", "year"))


@register("tile_focal_mean", ops=("E1", "E2", "I7"),
          sql=with_ctes(T8, ("cells8", T8_CELLS_SQL), body="""
SELECT t.c, t.r, round(avg(s.v), 9) AS v
FROM cells8 t JOIN cells8 s ON s.c BETWEEN t.c - 1 AND t.c + 1 AND s.r BETWEEN t.r - 1 AND t.r + 1
GROUP BY t.c, t.r"""))
def tile_focal_mean(spark, sf):
    cells = gr.explode_tiles(td.tile8(spark, sf))
    out = fo.focal(cells, "v", radius=1, stat="mean", tile_size=FOCAL_TILE)
    return out.select("c", "r", F.round("v", 9).alias("v"))


@register("tile_halo_focal_median", ops=("E1", "E2"),
          sql=with_ctes(T8, ("cells8", T8_CELLS_SQL), body="""
SELECT t.c, t.r, round(median(s.v), 9) AS v
FROM cells8 t JOIN cells8 s ON s.c BETWEEN t.c - 2 AND t.c + 2 AND s.r BETWEEN t.r - 2 AND t.r + 2
GROUP BY t.c, t.r"""))
def tile_halo_focal_median(spark, sf):
    out = gr.explode_tiles(fo.focal_tiles(td.tile8(spark, sf), radius=2, stat="median"))
    return out.select("c", "r", F.round("v", 9).alias("v"))


NEAREST_DST = gr.Grid(0.25, 0.25, 1.5, 1.5)


def _axis(col: str, step: float, name: str, first: str = "-2") -> str:
    """Target indices that cover the layer's cells on one axis, from its bounds."""
    return (f"SELECT unnest(range({first}, {first} + CAST(ceil(((SELECT max({col}) FROM nm) + 2) / {step!r}) AS BIGINT) + 32)) "
            f"AS {name}")


@register("regrid_nearest", ops=("I1",),
          sql=with_ctes(PX, NM, body=f"""
SELECT tc, tr, nm.v FROM ({_axis("c", NEAREST_DST.dx, "tc")}) a, ({_axis("r", NEAREST_DST.dy, "tr")}) b, nm
WHERE nm.c = CAST(floor((CAST({NEAREST_DST.x0!r} AS DOUBLE) + (tc + 0.5) * CAST({NEAREST_DST.dx!r} AS DOUBLE) - 0.0) / 1.0) AS INT)
  AND nm.r = CAST(floor((CAST({NEAREST_DST.y0!r} AS DOUBLE) + (tr + 0.5) * CAST({NEAREST_DST.dy!r} AS DOUBLE) - 0.0) / 1.0) AS INT)"""))
def regrid_nearest(spark, sf):
    out = gr.regrid_nearest(td.max_nir(spark, sf), ["v"], gr.Grid(), NEAREST_DST)
    return out.select(F.col("tc").cast("bigint").alias("tc"), F.col("tr").cast("bigint").alias("tr"), "v")


SCENES = ("s", """
SELECT scene, c, r, max(nir) AS nir, CASE WHEN count(blue) = count(*) THEN max(blue) END AS blue
FROM px GROUP BY scene, c, r""")
NEAREST_MERGE_SQL = f"""
SELECT tc, tr, arg_max(s.nir, s.scene) AS nir, arg_max(s.blue, s.scene) FILTER (WHERE s.blue IS NOT NULL) AS blue
FROM ({_axis("c", NEAREST_DST.dx, "tc")}) a, ({_axis("r", NEAREST_DST.dy, "tr")}) b, s
WHERE s.c = CAST(floor((CAST({NEAREST_DST.x0!r} AS DOUBLE) + (tc + 0.5) * CAST({NEAREST_DST.dx!r} AS DOUBLE) - 0.0) / 1.0) AS INT)
  AND s.r = CAST(floor((CAST({NEAREST_DST.y0!r} AS DOUBLE) + (tr + 0.5) * CAST({NEAREST_DST.dy!r} AS DOUBLE) - 0.0) / 1.0) AS INT)
GROUP BY tc, tr"""


@register("regrid_nearest_merge", ops=("I1", "G2"), sql=with_ctes(PX, NM, SCENES, body=NEAREST_MERGE_SQL))
def regrid_nearest_merge(spark, sf):
    scenes = composite(td.px(spark, sf), ["nir", "blue"], "max", keys=("scene", "c", "r"))
    out = gr.regrid_nearest(scenes, ["nir", "blue"], gr.Grid(), NEAREST_DST, priority_col="scene")
    return out.select(F.col("tc").cast("bigint").alias("tc"), F.col("tr").cast("bigint").alias("tr"), "nir", "blue")


BILINEAR_DST = gr.Grid(0.3, 0.3, 0.75, 0.75)


def _corners_sql(keys: str) -> str:
    return f"""
SELECT {keys}, fx, fy, i0 AS i, j0 AS j, 0 AS corner, (1.0 - fx) * (1.0 - fy) AS w FROM t
UNION ALL SELECT {keys}, fx, fy, i0 + 1, j0, 1, fx * (1.0 - fy) FROM t
UNION ALL SELECT {keys}, fx, fy, i0, j0 + 1, 2, (1.0 - fx) * fy FROM t
UNION ALL SELECT {keys}, fx, fy, i0 + 1, j0 + 1, 3, fx * fy FROM t"""


def _slot(k: int, what: str) -> str:
    return f"max(CASE WHEN corner = {k} THEN {what} END)"


def _corner_value() -> str:
    v = [_slot(k, "nm.v") for k in range(4)]
    w = [_slot(k, "w") for k in range(4)]

    def lerp(a, b, f):
        return f"({a} + {f} * ({b} - {a}))"

    fx, fy = "max(fx)", "max(fy)"
    top, bottom = lerp(v[0], v[1], fx), lerp(v[2], v[3], fx)
    num = " + ".join(f"coalesce({w[k]} * {v[k]}, 0.0)" for k in range(4))
    den = " + ".join(f"coalesce({w[k]}, 0.0)" for k in range(4))
    p = [f"({v[k]} IS NOT NULL)" for k in range(4)]
    n = "(" + " + ".join(f"CAST({x} AS INT)" for x in p) + ")"
    return (f"CASE WHEN {n} = 4 THEN {lerp(top, bottom, fy)} "
            f"WHEN {n} = 2 AND {p[0]} AND {p[1]} THEN {top} "
            f"WHEN {n} = 2 AND {p[2]} AND {p[3]} THEN {bottom} "
            f"WHEN {n} = 2 AND {p[0]} AND {p[2]} THEN {lerp(v[0], v[2], fy)} "
            f"WHEN {n} = 2 AND {p[1]} AND {p[3]} THEN {lerp(v[1], v[3], fy)} "
            f"WHEN {n} = 1 THEN coalesce({v[0]}, {v[1]}, {v[2]}, {v[3]}) "
            f"WHEN ({den}) = 0 THEN NULL ELSE ({num}) / ({den}) END")


_CORNER_SUM = _corner_value()


def _bilinear_sql(dst: gr.Grid) -> str:
    return with_ctes(PX, NM, ("t", f"""
SELECT tc, tr, u, v, CAST(floor(u) AS INT) AS i0, CAST(floor(v) AS INT) AS j0,
       u - floor(u) AS fx, v - floor(v) AS fy
FROM (SELECT tc, tr,
        (CAST({dst.x0!r} AS DOUBLE) + (tc + 0.5) * CAST({dst.dx!r} AS DOUBLE) - 0.0) / 1.0 - 0.5 AS u,
        (CAST({dst.y0!r} AS DOUBLE) + (tr + 0.5) * CAST({dst.dy!r} AS DOUBLE) - 0.0) / 1.0 - 0.5 AS v
      FROM ({_axis("c", dst.dx, "tc")}) a, ({_axis("r", dst.dy, "tr")}) b) q"""),
                     ("nb", _corners_sql("tc, tr")),
                     body=f"""
SELECT tc, tr, {_CORNER_SUM} AS v
FROM nb JOIN nm ON nm.c = nb.i AND nm.r = nb.j
WHERE w > 0 AND nm.v IS NOT NULL GROUP BY tc, tr""")


@register("regrid_bilinear", ops=("I2",), sql=_bilinear_sql(BILINEAR_DST))
def regrid_bilinear(spark, sf):
    out = gr.regrid_bilinear(td.max_nir(spark, sf), ["v"], gr.Grid(), BILINEAR_DST)
    return out.select(F.col("tc").cast("bigint").alias("tc"), F.col("tr").cast("bigint").alias("tr"), "v")


# Fixed parameter of the size resample: the target size.
RS_DST = (186, 169)


def resample_sql(cells: str, value: str) -> str:
    return f"""
SELECT CAST(tc AS INT) AS c, CAST(tr AS INT) AS r, {value} FROM range(0, {RS_DST[0]}) a(tc), range(0, {RS_DST[1]}) b(tr), {cells} s
WHERE s.c = CAST(floor((tc + 0.5) * ((SELECT CAST(max(c) + 1 AS DOUBLE) FROM {cells}) / {RS_DST[0]})) AS INT)
  AND s.r = CAST(floor((tr + 0.5) * ((SELECT CAST(max(r) + 1 AS DOUBLE) FROM {cells}) / {RS_DST[1]})) AS INT)"""


@register("resample_to_size", ops=("I6",), sql=with_ctes(PX, NM, body=resample_sql("nm", "s.v")))
def resample_to_size(spark, sf):
    return gr.resample_to_size(td.max_nir(spark, sf), ["v"], *RS_DST)


# Fixed parameters: the nm layer read as a lon/lat raster with 0.01 degree
# cells whose north-west corner is at (-3.0, 40.0), reprojected to zoom 8.
LL_GRID = gr.Grid(-3.0, 40.0, 0.01, -0.01)
MERC_ZOOM = 8


def _reproject_sql() -> str:
    res = mercator_resolution(MERC_ZOOM)
    half = MERCATOR_HALF_WORLD
    g = LL_GRID
    def d(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    lon = f"degrees(({d(-half)} + (px + 0.5) * {d(res)}) / {d(EARTH_RADIUS)})"
    lat = (f"degrees(atan(exp(({d(half)} - (py + 0.5) * {d(res)}) / {d(EARTH_RADIUS)})) * 2 "
           f"- {d(math.pi / 2)})")
    # pixels per cell along x; along y they grow with 1 / cos(lat), below 2 for these latitudes
    px_per_cell = g.dx * half / 180.0 / res
    x_lo = int((-3.0 + 180) / 360 * 256 * 2 ** MERC_ZOOM) - 3
    y_lo = int((1 - math.log(math.tan(math.radians(40.0)) + 1 / math.cos(math.radians(40.0))) / math.pi)
               / 2 * 256 * 2 ** MERC_ZOOM) - 3
    return with_ctes(PX, NM, ("t", f"""
SELECT px, py, u, v, CAST(floor(u) AS INT) AS i0, CAST(floor(v) AS INT) AS j0,
       u - floor(u) AS fx, v - floor(v) AS fy
FROM (SELECT px, py,
        ({lon} - {d(g.x0)}) / {d(g.dx)} - 0.5 AS u,
        ({lat} - {d(g.y0)}) / {d(g.dy)} - 0.5 AS v
      FROM ({_axis("c", 1 / px_per_cell, "px", str(x_lo))}) a,
           ({_axis("r", 1 / (2 * px_per_cell), "py", str(y_lo))}) b) q"""),
                     ("nb", _corners_sql("px, py")),
                     body=f"""
SELECT {MERC_ZOOM} AS zoom, px, py, CAST(floor(px / 256) AS INT) AS col_key,
       CAST(floor(py / 256) AS INT) AS row_key, floor(({_CORNER_SUM}) * 100.0 + 0.5) / 100.0 AS v
FROM nb JOIN nm ON nm.c = nb.i AND nm.r = nb.j
WHERE w > 0 AND nm.v IS NOT NULL GROUP BY px, py""")


@register("reproject_web_mercator", ops=("I3",), sql=_reproject_sql())
def reproject_web_mercator(spark, sf):
    out = gr.reproject_lonlat_to_mercator(td.max_nir(spark, sf), ["v"], LL_GRID, MERC_ZOOM)
    return out.select("zoom", F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"),
                      "col_key", "row_key", (F.floor(F.col("v") * 100.0 + 0.5) / 100.0).alias("v"))


def _morton_sql(x: str) -> str:
    e = f"CAST({x} AS BIGINT)"
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
                        (2, 0x3333333333333333), (1, 0x5555555555555555)):
        e = f"((({e}) << {shift}) | ({e})) & {mask}"
    return e


@register("zorder_keys", ops=("F4",),
          sql=with_ctes(PX, NM, body=f"SELECT c, r, (({_morton_sql('c')}) << 1) | ({_morton_sql('r')}) AS z FROM nm"))
def zorder_keys(spark, sf):
    return gr.with_zorder(td.max_nir(spark, sf)).select("c", "r", "z")


# Fixed parameters: the nm layer read as a UTM zone 48N raster of 30 m cells
# whose north-west corner is at (500000, 4500000), reprojected to zoom 12.
UTM_GRID = gr.Grid(500000.0, 4500000.0, 30.0, -30.0)
UTM_ZONE = 48
UTM_ZOOM = 12


def utm_ctes(g: gr.Grid, zone: int, zoom: int, name: str = "") -> list[tuple[str, str]]:
    """CTEs up to ``t<name>``: the source coordinates of the pixels around a UTM raster of nm's size."""
    import numpy as np

    from dunegrid.functions import geometry as geo

    def d(x: float) -> str:
        return f"CAST({x!r} AS DOUBLE)"

    res = mercator_resolution(zoom)
    half = MERCATOR_HALF_WORLD
    # the raster's corner on the target grid; it reaches below two pixels per
    # cell from there (30 m cells, 38 m pixels, 1 / cos(lat) below 1.5)
    lon, lat = geo.utm_inverse_np(np.array([g.x0]), np.array([g.y0]), zone)
    px0 = int(((np.radians(lon) * EARTH_RADIUS + half) / res)[0]) - 12
    py0 = int(((half - np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * EARTH_RADIUS) / res)[0]) - 12
    e2, ep2 = geo._E2, geo._EP2
    lam0 = math.radians(geo.utm_central_meridian(zone))
    ll = f"""
SELECT px, py,
  radians(degrees(({d(-half)} + (px + 0.5) * {d(res)}) / {d(EARTH_RADIUS)})) - {d(lam0)} AS lam,
  radians(degrees(atan(exp(({d(half)} - (py + 0.5) * {d(res)}) / {d(EARTH_RADIUS)})) * 2 - {d(math.pi / 2)})) AS phi
FROM ({_axis("c", 0.5, "px", str(px0))}) a, ({_axis("r", 0.5, "py", str(py0))}) b"""
    terms = f"""
SELECT px, py, phi, tan(phi) AS tn,
  {d(EARTH_RADIUS)} / sqrt(1 - {d(e2)} * sin(phi) * sin(phi)) AS n,
  tan(phi) * tan(phi) AS t, {d(ep2)} * cos(phi) * cos(phi) AS c, lam * cos(phi) AS aa,
  {d(EARTH_RADIUS)} * ({d(geo._M1)} * phi - {d(geo._M2)} * sin(2 * phi) + {d(geo._M3)} * sin(4 * phi)
                      - {d(geo._M4)} * sin(6 * phi)) AS m
FROM ll{name}"""
    xy = f"""
SELECT px, py,
  {d(geo.UTM_K0)} * n * (aa + (1 - t + c) * pow(aa, 3) / 6
      + (5 - 18 * t + t * t + 72 * c - 58 * {d(ep2)}) * pow(aa, 5) / 120) + {d(geo.UTM_FALSE_EASTING)} AS ux,
  {d(geo.UTM_K0)} * (m + n * tn * (aa * aa / 2 + (5 - t + 9 * c + 4 * c * c) * pow(aa, 4) / 24
      + (61 - 58 * t + t * t + 600 * c - 330 * {d(ep2)}) * pow(aa, 6) / 720)) AS uy
FROM terms{name}"""
    tt = f"""
SELECT px, py, u, v, CAST(floor(u) AS INT) AS i0, CAST(floor(v) AS INT) AS j0,
       u - floor(u) AS fx, v - floor(v) AS fy
FROM (SELECT px, py, (ux - {d(g.x0)}) / {d(g.dx)} - 0.5 AS u, (uy - {d(g.y0)}) / {d(g.dy)} - 0.5 AS v FROM xy{name}) q"""
    return [(f"ll{name}", ll), (f"terms{name}", terms), (f"xy{name}", xy), (f"t{name}", tt)]


def _utm_reproject_sql() -> str:
    return with_ctes(PX, NM, *utm_ctes(UTM_GRID, UTM_ZONE, UTM_ZOOM), ("nb", _corners_sql("px, py")), body=f"""
SELECT {UTM_ZOOM} AS zoom, px, py, CAST(floor(px / 256) AS INT) AS col_key,
       CAST(floor(py / 256) AS INT) AS row_key, floor(({_CORNER_SUM}) * 100.0 + 0.5) / 100.0 AS v
FROM nb JOIN nm ON nm.c = nb.i AND nm.r = nb.j
WHERE w > 0 AND nm.v IS NOT NULL GROUP BY px, py""")


@register("reproject_utm_web_mercator", ops=("I3",), sql=_utm_reproject_sql())
def reproject_utm_web_mercator(spark, sf):
    out = gr.reproject_utm_to_mercator(td.max_nir(spark, sf), ["v"], UTM_GRID, UTM_ZONE, UTM_ZOOM)
    return out.select("zoom", F.col("px").cast("bigint").alias("px"), F.col("py").cast("bigint").alias("py"),
                      "col_key", "row_key", (F.floor(F.col("v") * 100.0 + 0.5) / 100.0).alias("v"))


@register("polygon_tiles", ops=("B5",),
          sql=with_ctes(T8, ("cells8", T8_CELLS_SQL),
                        ("inside", mk.inside_polygon_sql(POLYGON, "SELECT DISTINCT c, r FROM cells8")),
                        body="""
SELECT DISTINCT cells8.col_key, cells8.row_key, tile8.label
FROM cells8 JOIN inside USING (c, r) JOIN tile8 ON tile8.col_key = cells8.col_key AND tile8.row_key = cells8.row_key"""))
def polygon_tiles(spark, sf):
    return mk.filter_tiles_polygon(td.tile8(spark, sf), POLYGON, 8, 8).select("col_key", "row_key", "label")

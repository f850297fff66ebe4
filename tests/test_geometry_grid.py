import pytest
import math
import random

import numpy as np
from pyspark.sql import functions as F

from dunegrid.functions import geometry as geo
from dunegrid.operators import focal, grid, mask


def test_morton(spark):
    df = spark.createDataFrame([(5, 3), (0, 0), (1, 0), (0, 1), (65535, 65535)], "c int, r int")
    got = [r[0] for r in df.select(geo.morton2("c", "r")).collect()]
    assert got[:4] == [39, 0, 2, 1]
    assert got[4] == (1 << 32) - 1


def test_mercator_round_trip(spark):
    df = spark.createDataFrame([(12.5, 41.9), (-3.0, 40.0), (179.0, -85.0)], "lon double, lat double")
    out = df.select(geo.mercator_to_lon(geo.lonlat_to_mercator_x("lon")).alias("lon2"),
                    geo.mercator_to_lat(geo.lonlat_to_mercator_y("lat")).alias("lat2"), "lon", "lat").collect()
    for r in out:
        assert abs(r.lon2 - r.lon) < 1e-9 and abs(r.lat2 - r.lat) < 1e-9


def _inside_brute(poly, x, y):
    inside = False
    for ring in poly:
        for i in range(len(ring)):
            (x1, y1), (x2, y2) = ring[i], ring[(i + 1) % len(ring)]
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


def test_polygon_mask_matches_crossing_count(spark):
    rnd = random.Random(5)
    cells = spark.createDataFrame([(c, r, float(c * 100 + r)) for c in range(30) for r in range(25)],
                                  "c int, r int, v double")
    for _ in range(3):
        ring = [(rnd.uniform(0, 30), rnd.uniform(0, 25)) for _ in range(7)]
        hole = [(10, 10), (14, 10), (14, 14), (10, 14)]
        poly = (ring, hole)
        got = {(r.c, r.r) for r in mask.mask_polygon(cells, poly).collect()}
        exp = {(c, r) for c in range(30) for r in range(25) if _inside_brute(poly, c + .5, r + .5)}
        assert got == exp


def test_explode_assemble_identity(spark):
    rows = [(ck, rk, 4, 3, [float(ck * 100 + rk * 10 + i) if i % 5 else None for i in range(12)])
            for ck in range(3) for rk in range(2)]
    tiles = spark.createDataFrame(rows, "col_key int, row_key int, cols int, rows int, cells array<double>")
    cells = grid.explode_tiles(tiles)
    back = grid.assemble_tiles(cells, 4, 3).select("col_key", "row_key", "cells")
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], r[4]) for r in rows)


def test_pyramid_mean_and_bilinear_downsample(spark):
    data = [(c, r, float((c * 7 + r * 3) % 11)) for c in range(8) for r in range(6)]
    cells = spark.createDataFrame(data, "c int, r int, v double")
    lvl = {(r.c, r.r): r.v for r in grid.pyramid_level(cells, ["v"]).collect()}
    bil = {(r.tc, r.tr): r.v for r in grid.regrid_bilinear(cells, ["v"], grid.Grid(), grid.Grid(0, 0, 2, 2)).collect()}
    assert set(lvl) == set(bil)
    for k in lvl:
        assert math.isclose(lvl[k], bil[k], abs_tol=1e-12)
    total = sum(v for _, _, v in data) / len(data)
    assert math.isclose(sum(lvl.values()) / len(lvl), total, abs_tol=1e-12)


def test_nearest_identity(spark):
    data = [(c, r, float(c + 10 * r)) for c in range(5) for r in range(4)]
    cells = spark.createDataFrame(data, "c int, r int, v double")
    out = {(r.tc, r.tr): r.v for r in grid.regrid_nearest(cells, ["v"], grid.Grid(), grid.Grid()).collect()}
    assert out == {(c, r): v for c, r, v in data}


def test_focal_matches_numpy_across_tiles(spark):
    rnd = np.random.default_rng(2)
    H, W = 23, 37
    arr = rnd.integers(0, 50, (H, W)).astype(float)
    arr[rnd.random((H, W)) < 0.2] = np.nan
    rows = [(c, r, None if np.isnan(arr[r, c]) else float(arr[r, c])) for r in range(H) for c in range(W)
            if not (r == 5 and c == 5)]
    cells = spark.createDataFrame(rows, "c int, r int, v double")
    for ts in (4, 7, 64):
        got = {(x.c, x.r): x.v for x in focal.focal(cells, "v", 2, "median", tile_size=ts).collect()}
        present = np.zeros((H, W), bool)
        for c, r, _ in rows:
            present[r, c] = True
        exp = {}
        for c, r, _ in rows:
            win = arr[max(0, r - 2):r + 3, max(0, c - 2):c + 3]
            mask_ = present[max(0, r - 2):r + 3, max(0, c - 2):c + 3]
            vals = win[mask_ & ~np.isnan(win)]
            exp[(c, r)] = float(np.median(vals)) if len(vals) else None
        assert got == exp, ts


def test_utm_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(15.0, 45.0), (13.4, 52.5), (16.9, 47.1)], "lon double, lat double")
    out = geo.with_utm_forward(df, "lon", "lat", 33)
    out = geo.with_utm_inverse(out, "x", "y", 33, out_lon="lon2", out_lat="lat2")
    for r in out.collect():
        assert abs(r.lon2 - r.lon) < 1e-6 and abs(r.lat2 - r.lat) < 1e-6
        if r.lon == 15.0:  # central meridian: false easting, northing = k0 * meridian arc
            assert abs(r.x - 500000.0) < 1e-6 and abs(r.y - 4982950.4) < 1.0
    south = spark.createDataFrame([(105.2, -6.3)], "lon double, lat double")
    s2 = geo.with_utm_inverse(geo.with_utm_forward(south, "lon", "lat", 48, True), "x", "y", 48, True,
                              "lon2", "lat2").first()
    assert abs(s2.lon2 - 105.2) < 1e-6 and abs(s2.lat2 + 6.3) < 1e-6 and s2.y > 9e6


def test_generic_reproject_identity_and_lonlat_agree(spark):
    data = [(c, r, float((c * 13 + r * 7) % 17)) for c in range(12) for r in range(9)]
    cells = spark.createDataFrame(data, "c int, r int, v double")
    def ident(df, x, y, ox, oy):
        return df.withColumn(ox, F.col(x)).withColumn(oy, F.col(y))

    got = {(x.tc, x.tr): x.v for x in grid.reproject_cells(cells, ["v"], grid.Grid(), grid.Grid(), ident, ident).collect()}
    assert got == {(c, r): v for c, r, v in data}
    # the generic path reproduces the separable lon/lat -> mercator path
    src = grid.Grid(-3.0, 40.0, 0.01, -0.01)
    a = {(x.px, x.py): x.v for x in grid.reproject_lonlat_to_mercator(cells, ["v"], src, 9).collect()}
    res = geo.mercator_resolution(9)
    dst = grid.Grid(-geo.MERCATOR_HALF_WORLD, geo.MERCATOR_HALF_WORLD, res, -res)
    def fwd(df, x, y, ox, oy):
        return df.withColumn(ox, geo.lonlat_to_mercator_x(F.col(x))).withColumn(oy, geo.lonlat_to_mercator_y(F.col(y)))

    def inv(df, X, Y, ox, oy):
        return df.withColumn(ox, geo.mercator_to_lon(F.col(X))).withColumn(oy, geo.mercator_to_lat(F.col(Y)))

    b = {(x.tc, x.tr): x.v for x in grid.reproject_cells(cells, ["v"], src, dst, fwd, inv).collect()}
    assert set(a) == set(b)
    assert all(math.isclose(a[k], b[k], abs_tol=1e-9) for k in a)


def test_focal_tiles_equals_cell_focal(spark):
    rnd = np.random.default_rng(9)
    rows = []
    for ck in range(3):
        for rk in range(2):
            if (ck, rk) == (2, 1):
                continue  # a missing tile: its neighbours see nodata there
            vals = rnd.integers(0, 30, 20).astype(float).tolist()
            vals[3] = None
            rows.append((ck, rk, 5, 4, vals))
    tiles = spark.createDataFrame(rows, "col_key int, row_key int, cols int, rows int, cells array<double>")
    a = {(x.c, x.r): x.v for x in grid.explode_tiles(focal.focal_tiles(tiles, 2, "median")).collect()}
    b = {(x.c, x.r): x.v for x in focal.focal(grid.explode_tiles(tiles), "v", 2, "median", tile_size=7).collect()}
    assert a == b


def test_filter_tiles_polygon_matches_cell_test(spark):
    rnd = random.Random(11)
    rows = [(ck, rk, 4, 4, [0.0] * 16) for ck in range(10) for rk in range(8)]
    tiles = spark.createDataFrame(rows, "col_key int, row_key int, cols int, rows int, cells array<double>")
    for _ in range(3):
        ring = [(rnd.uniform(0, 40), rnd.uniform(0, 32)) for _ in range(6)]
        poly = (ring,)
        got = {(r.col_key, r.row_key) for r in mask.filter_tiles_polygon(tiles, poly, 4, 4).collect()}
        exp = {(c // 4, r // 4) for c in range(40) for r in range(32) if _inside_brute(poly, c + .5, r + .5)}
        assert got == exp


def test_layers_stay_apart(spark):
    """Two scenes in, two scenes out, everywhere; without keys they are refused."""
    rows = [(s, c, r, float(100 * s + c + 7 * r)) for s in (0, 1) for c in range(9) for r in range(8)]
    cells = spark.createDataFrame(rows, "scene int, c int, r int, v double")
    one = [cells.filter(F.col("scene") == s).drop("scene") for s in (0, 1)]

    def split(df, s):
        return sorted(tuple(r) for r in df.filter(F.col("scene") == s).drop("scene").collect())

    dst = grid.Grid(0.3, 0.3, 0.8, 0.8)
    runs = {
        "focal": lambda d, k: focal.focal(d, "v", 1, "median", tile_size=4, keys=k),
        "pyramid": lambda d, k: grid.pyramid_level(d, ["v"], keys=k),
        "nearest": lambda d, k: grid.regrid_nearest(d, ["v"], grid.Grid(), dst, keys=k),
        "bilinear": lambda d, k: grid.regrid_bilinear(d, ["v"], grid.Grid(), dst, keys=k),
        "mercator": lambda d, k: grid.reproject_lonlat_to_mercator(d, ["v"], grid.Grid(0, 40, .01, -.01), 8, keys=k),
        "bilinear cells": lambda d, k: grid.regrid_bilinear_cells(d, ["v"], grid.Grid(), dst, keys=k),
        "utm": lambda d, k: grid.reproject_utm_to_mercator(d, ["v"], grid.Grid(5e5, 45e5, 30, -30), 48, 12, keys=k),
    }
    for name, fn in runs.items():
        both = fn(cells, ("scene",))
        for s in (0, 1):
            assert split(both, s) == sorted(tuple(r) for r in fn(one[s], ()).collect()), name
    tiles = grid.assemble_tiles(cells, 4, 4, keep=("scene",))
    both = focal.focal_tiles(tiles, 1, "max", keys=("scene",))
    for s in (0, 1):
        alone = focal.focal_tiles(tiles.filter(F.col("scene") == s), 1, "max")
        assert split(both.select("scene", "col_key", "row_key", "cells"), s) == sorted(
            tuple(r) for r in alone.select("col_key", "row_key", "cells").collect())
    for mixed in (focal.focal(cells, "v", 1), focal.focal_tiles(tiles, 1),
                  grid.regrid_bilinear(cells, ["v"], grid.Grid(), dst)):
        with pytest.raises(Exception):
            mixed.collect()


def test_mosaic_shows_data_below_nodata(spark):
    from dunegrid.operators import composite
    df = spark.createDataFrame([(0, 0, 0, 5.0, 1.0), (1, 0, 0, None, 2.0)], "scene int, c int, r int, v double, w double")
    assert tuple(composite.mosaic(df, ["v", "w"], "last").first()) == (0, 0, 5.0, 2.0)
    got = grid.regrid_nearest(df, ["v", "w"], grid.Grid(), grid.Grid(), priority_col="scene").first()
    assert (got.v, got.w) == (5.0, 2.0)


def test_zoom_and_pyramid_levels_come_from_the_layer(spark):
    cells = spark.createDataFrame([(c, r, 1.0) for c in range(130) for r in (0, 3)], "c int, r int, v double")
    assert grid.pyramid_levels(cells) == 8 and grid.pyramid_levels(cells.limit(0)) == 0
    assert grid.build_pyramid(cells, ["v"]).filter("level = 8").count() == 1
    assert grid.zoom_for_cell_size(30.0) == 12 and grid.zoom_for_cell_size(156543.0) == 0


def test_single_pass_plans(spark):
    import __spark_entry__ as E
    from tests.conftest import SF_SMALL

    def counts(name):
        plan = E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        plan = plan.split("== Initial Plan ==")[-1]
        return plan.count("FileScan parquet"), plan.count("Exchange hashpartitioning")

    assert counts("max_composite_bands") == (1, 1)
    assert counts("data_cells") == (1, 1)
    assert counts("mosaic_last") == (1, 2)
    assert counts("multiclass_metrics") == (1, 2)
    scans, exchanges = counts("assemble_tiles")
    assert scans == 1 and exchanges <= 2


def test_tile_form_equals_cell_form(spark):
    """Several bands with nodata and gaps, tiles smaller than the raster."""
    rnd = np.random.default_rng(6)
    rows = [(s, c, r, None if rnd.random() < .2 else float(rnd.integers(0, 40)), float(c * r))
            for s in (0, 1) for c in range(40) for r in range(30) if rnd.random() > .1]
    cells = spark.createDataFrame(rows, "scene int, c int, r int, a double, b double")
    for dst in (grid.Grid(0.3, 0.3, 0.75, 0.75), grid.Grid(-2.0, 1.0, 2.5, 1.5), grid.Grid(0, 30, 1.0, -1.0)):
        one = grid.regrid_bilinear_cells(cells, ["a", "b"], grid.Grid(), dst, keys=["scene"])
        exp = {(x.scene, x.tc, x.tr): (x.a, x.b) for x in one.collect()}
        for tile in (7, 128):
            two = grid.resample_on_tiles(cells, ["a", "b"], grid.Grid(), dst, grid._same, grid._same, keys=["scene"],
                                         tile=tile)
            got = {(x.scene, x.tc, x.tr): (x.a, x.b) for x in two.collect()}
            assert got.keys() == exp.keys()
            assert all((p is None) == (q is None) and (p is None or math.isclose(p, q, abs_tol=1e-12))
                       for k in exp for p, q in zip(got[k], exp[k]))


@pytest.mark.parametrize("radius, shape", [(4, (30, 41)), (15, (70, 52)), (15, (9, 8)), (0, (5, 5))])
def test_running_median_equals_sorted_windows(radius, shape):
    rng = np.random.default_rng(radius)
    arr = rng.integers(0, 300, shape) / 7.0
    arr[rng.random(shape) < 0.2] = np.nan
    arr[:3, :3] = np.nan
    padded = np.pad(arr, radius, constant_values=np.nan)
    got = focal.running_median(arr, radius)
    for y in range(shape[0]):
        for x in range(shape[1]):
            window = padded[y:y + 2 * radius + 1, x:x + 2 * radius + 1]
            window = window[~np.isnan(window)]
            want = np.median(window) if len(window) else np.nan
            assert got[y, x] == want or (np.isnan(got[y, x]) and np.isnan(want))
    assert np.isnan(focal.running_median(np.full((4, 4), np.nan), 5)).all()


def test_running_median_holds_no_windows():
    import tracemalloc

    arr = np.random.default_rng(1).random((96, 96))
    tracemalloc.start()
    focal.running_median(arr, 15)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 96 * 96 * 31 * 31 * 8 / 4  # a quarter of the windows' copies

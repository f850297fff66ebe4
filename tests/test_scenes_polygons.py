"""The GeoTIFF data source, scenes of several coordinate systems, polygon tables."""

import glob
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from dunegrid.functions.geometry import mercator_resolution
from dunegrid.operators import grid as gr
from dunegrid.operators import polygons, scenes
from dunegrid.sources import geotiff, geotiff_source

TILES = ("file string, cols int, rows int, cells array<double>, xmin double, ymax double, dx double, dy double")


def files(path):
    return sorted(os.path.relpath(f, path) for f in glob.glob(f"{path}/**", recursive=True, include_hidden=True)
                  if os.path.isfile(f))


def folders(path):
    return [f for f in glob.glob(f"{path}/**", recursive=True, include_hidden=True) if os.path.isdir(f)]


def tiles_of(spark, names):
    rng = np.random.default_rng(3)
    return spark.createDataFrame(
        [(n, 5, 7, [None if k % 9 == 4 else float(x) for k, x in enumerate(rng.integers(0, 99, 35))], 10.0 * i, 3.0, 1.0, -1.0)
         for i, n in enumerate(names)], TILES)


NAMES = [f"s{s}/x_B{b}_REF.TIF" for s in range(3) for b in (2, 4)]


def test_source_round_trip_and_pushdown(spark, tmpdir_fresh):
    geotiff_source.register(spark)
    tiles = tiles_of(spark, NAMES)
    tiles.repartition(3).write.format("geotiff").option("crs", 32648).mode("append").save(tmpdir_fresh)
    assert files(tmpdir_fresh) == sorted(NAMES)
    read = spark.read.format("geotiff").option("tile_size", 4).load(tmpdir_fresh)
    got = {(r.scene_id, r.band, r.c, r.r): r.v for r in gr.explode_tiles(read, keep=("scene_id", "band")).collect()}
    want = {(n[:2], int(n[6]), k % 5, k // 5): v for n, row in zip(NAMES, tiles.collect()) for k, v in enumerate(row.cells)}
    assert got == want and {r.crs for r in read.select("crs").collect()} == {32648}
    # what can be told without decoding is decided by the scan: no filter is left above it
    some = read.filter("band = 4 AND scene_id IN ('s0', 's2') AND col_key = 1 AND row_key < 1 AND sample = 0")
    assert {(r.scene_id, r.band, r.col_key, r.row_key) for r in some.collect()} == {("s0", 4, 1, 0), ("s2", 4, 1, 0)}
    assert ") Filter " not in some._jdf.queryExecution().executedPlan().toString()
    left = read.filter("band = 4 AND cols = 1")
    assert left.count() == 3 * 2 and ") Filter " in left._jdf.queryExecution().executedPlan().toString()
    # files are dropped by their names: one that is no TIFF does no harm unless it is asked for
    with open(f"{tmpdir_fresh}/s1/bad_B7_REF.TIF", "wb") as f:
        f.write(b"no tiff")
    assert spark.read.format("geotiff").load(tmpdir_fresh).filter("band < 5").count() == 6
    with pytest.raises(Exception):
        spark.read.format("geotiff").load(tmpdir_fresh).count()
    assert spark.read.format("geotiff").load(tmpdir_fresh).filter("band = 99").count() == 0


def test_pushed_comparisons():
    reader = geotiff_source.GeoTiffReader({"path": "/x"})
    given = [ds.EqualTo(("band",), 4), ds.In(("scene_id",), ("a", "b")), ds.EqualTo(("cols",), 3), ds.LessThan(("col_key",), 2),
             ds.StringStartsWith(("path",), "/x/"), ds.IsNull(("band",)), ds.IsNotNull(("band",))]
    assert list(reader.pushFilters(given)) == [given[2], given[5]]
    assert reader._keeps(geotiff_source.file_facts("/x/a/q_B4_REF.TIF"))
    for path in ("/x/a/q_B5_REF.TIF", "/x/c/q_B4_REF.TIF", "/y/a/q_B4_REF.TIF", "/x/a/none.TIF"):
        assert not reader._keeps(geotiff_source.file_facts(path))
    assert reader._keeps({"col_key": 1}) and not reader._keeps({"col_key": 2})


def test_large_files_are_shared_by_rows_of_windows(tmpdir_fresh):
    with open(f"{tmpdir_fresh}/a.TIF", "wb") as f:
        f.write(geotiff.encode_geotiff(np.arange(400.0).reshape(40, 10), 0, 0, 1, -1, compress="none"))
    reader = geotiff_source.GeoTiffReader({"path": tmpdir_fresh, "tile_size": "8", "task_bytes": "1000"})
    parts = reader.partitions()
    assert len(parts) == 4 and {p.files[0][2] for p in parts} == {4}
    rows = [b for p in parts for b in reader.read(p)]
    assert sorted((b.column("row_key")[0].as_py(), b.column("col_key")[0].as_py()) for b in rows) == [
        (r, c) for r in range(5) for c in range(2)]
    assert sum(sum(b.column("cells")[0].as_py()) for b in rows) == sum(range(400))


def until_empty(path):
    """Tasks that were running when the job was aborted remove their own files when they end."""
    for _ in range(60):
        if not os.path.exists(f"{path}/_temporary"):
            break
        time.sleep(0.5)
    assert files(path) == []


def test_aborted_write_leaves_nothing(spark, tmpdir_fresh):
    geotiff_source.register(spark)
    tiles = tiles_of(spark, NAMES)
    bad = tiles.withColumn("rows", F.when(F.col("file").startswith("s2"), 6).otherwise(F.col("rows")))
    with pytest.raises(Exception):
        bad.repartition(4).write.format("geotiff").mode("append").save(tmpdir_fresh)
    until_empty(tmpdir_fresh)
    assert folders(tmpdir_fresh) == [f"{tmpdir_fresh}/"]
    with pytest.raises(Exception, match="one file name"):
        tiles.unionByName(tiles).write.format("geotiff").mode("append").save(tmpdir_fresh)
    until_empty(tmpdir_fresh)
    tiles.write.format("geotiff").mode("append").save(tmpdir_fresh)
    tiles.limit(1).write.format("geotiff").mode("overwrite").save(tmpdir_fresh)
    assert len(files(tmpdir_fresh)) == 1
    with pytest.raises(Exception, match="missing"):
        tiles.drop("dx").write.format("geotiff").mode("append").save(tmpdir_fresh)


def test_attempts_that_spark_did_not_choose_are_removed(tmpdir_fresh):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"file": "a/b.TIF", "cols": 2, "rows": 1, "cells": [1.0, None], "xmin": 0.0,
                                         "ymax": 0.0, "dx": 1.0, "dy": -1.0}])
    writer = geotiff_source.GeoTiffWriter({"path": tmpdir_fresh}, False)
    lost, chosen = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(files(tmpdir_fresh)) == 3 and all(f.startswith("_temporary") for f in files(tmpdir_fresh))
    assert geotiff_source.GeoTiffReader({"path": tmpdir_fresh}).listed() == []  # not seen before the commit
    assert lost.files[0][0] != chosen.files[0][0]
    writer.commit([chosen, None])
    assert files(tmpdir_fresh) == ["a/b.TIF"] and not os.path.exists(f"{tmpdir_fresh}/_temporary")
    with pytest.raises(RuntimeError, match="ended"):  # an attempt after the job's end
        writer.write(iter([batch]))
    late = geotiff_source.GeoTiffWriter({"path": tmpdir_fresh}, False)

    def slow():
        yield batch
        late.abort([])
    with pytest.raises(RuntimeError, match="ended"):
        late.write(slow())
    assert files(tmpdir_fresh) == ["a/b.TIF"] and not os.path.exists(f"{tmpdir_fresh}/_temporary")
    writer = geotiff_source.GeoTiffWriter({"path": tmpdir_fresh}, False)
    with pytest.raises(ValueError, match="below"):
        writer.write(iter([pa.RecordBatch.from_pylist([{**batch.to_pylist()[0], "file": "../b.TIF"}])]))


GRIDS = "scene_id string, crs int, x0 double, y0 double, dx double, dy double, width int, height int"


def test_scenes_of_several_systems_meet_on_one_layer(spark):
    """Each scene alone gives what the plain reprojections give; together the higher one wins."""
    rng = np.random.default_rng(1)
    cells = spark.createDataFrame(
        [(s, c, r, float(v), None if v < 20 else float(2 * v)) for s in ("a", "b", "c")
         for (c, r), v in zip([(c, r) for c in range(20) for r in range(12)], rng.integers(0, 99, 240))],
        "scene_id string, c int, r int, v double, w double")
    grids = spark.createDataFrame([("a", 32648, 752000.0, 4500000.0, 30.0, -30.0, 20, 12),
                                   ("b", 32649, 245100.0, 4499900.0, 30.0, -30.0, 20, 12),
                                   ("c", 4326, 107.981, 40.606, 0.0003, -0.0003, 20, 12)], GRIDS)
    got = {(r.px, r.py): (r.v, r.w) for r in scenes.reproject_scenes(cells, ["v", "w"], grids).collect()}
    zoom = scenes.mercator_layout(grids).first()
    assert zoom.zoom == 12 and zoom.dx == mercator_resolution(12)
    want = {}
    for s, f in (("a", lambda d: gr.reproject_utm_to_mercator(d, ["v", "w"], gr.Grid(752000.0, 4500000.0, 30.0, -30.0), 48, 12)),
                 ("b", lambda d: gr.reproject_utm_to_mercator(d, ["v", "w"], gr.Grid(245100.0, 4499900.0, 30.0, -30.0), 49, 12)),
                 ("c", lambda d: gr.reproject_lonlat_to_mercator(d, ["v", "w"], gr.Grid(107.981, 40.606, 0.0003, -0.0003), 12))):
        for r in f(cells.filter(F.col("scene_id") == s)).collect():
            old = want.get((r.px, r.py), (None, None))
            want[r.px, r.py] = tuple(o if n is None else n for o, n in zip(old, (r.v, r.w)))
    assert got == want and len(got) > 300
    with pytest.raises(Exception, match="no grid"):
        scenes.reproject_scenes(cells, ["v"], grids.filter("scene_id <> 'b'")).collect()
    with pytest.raises(Exception, match="several grids"):
        scenes.reproject_scenes(cells, ["v"], grids.unionByName(grids), layout=scenes.mercator_layout(grids)).collect()
    with pytest.raises(ValueError, match="EPSG:2056"):
        scenes.mercator_maps(2056)


def test_scene_grids_from_blocks(spark):
    rows = [("a", 1, 100.0 + 60 * i, 900.0 - 90 * j, 30.0, -30.0, 2, 3) for i in range(3) for j in range(2)]
    schema = "scene_id string, crs int, xmin double, ymax double, dx double, dy double, cols int, rows int"
    row = scenes.scene_grids(spark.createDataFrame(rows, schema)).first()
    assert tuple(row) == ("a", 1, 100.0, 900.0, 30.0, -30.0, 6, 6)
    for other in (("a", 2, 100.0, 900.0, 30.0, -30.0, 2, 3), ("a", 1, 110.0, 900.0, 30.0, -30.0, 2, 3)):
        with pytest.raises(Exception, match="differ in grid"):
            scenes.scene_grids(spark.createDataFrame([*rows, other], schema)).collect()


def test_sparse_window_of_a_coarse_target(spark):
    """Memory follows the rows, not the span: two far cells of a fine raster, one target tile."""
    cells = spark.createDataFrame([(0, 0, 1.0), (1_000_000, 1_000_000, 2.0)], "c int, r int, v double")
    out = gr.regrid_bilinear(cells, ["v"], gr.Grid(), gr.Grid(0.25, 0.25, 0.5, 0.5)).collect()
    assert {r.v for r in out} == {1.0, 2.0}
    far = gr.regrid_bilinear(cells, ["v"], gr.Grid(), gr.Grid(-9999.5, -9999.5, 20000.0, 20000.0)).collect()
    assert [(r.tc, r.tr, r.v) for r in far] == [(0, 0, 1.0), (50, 50, 2.0)]


def crossing(ring_list, x, y):
    inside = False
    for ring in ring_list:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                inside = not inside
    return inside


@pytest.mark.parametrize("tile", [1, 4, 32])
def test_polygon_join_against_crossing_numbers(spark, tile):
    rng = random.Random(tile)
    shapes = {}
    for k in range(60):
        cx, cy, size = rng.uniform(-5, 45), rng.uniform(-5, 35), rng.choice([0.4, 3, 12, 40])
        shapes[k] = [[(cx + rng.uniform(-size, size), cy + rng.uniform(-size, size)) for _ in range(rng.randint(3, 9))]
                     for _ in range(rng.randint(1, 3))]
    shapes[60] = [[(5, 5), (25, 5), (25, 25), (5, 25)], [(10, 10), (20, 10), (20, 20), (10, 20)]]  # whole corners
    shapes[61] = [[(5.5, 5.5), (25.5, 5.5), (25.5, 25.5), (5.5, 25.5)]]  # through centres
    shapes[62] = [[(0, 0), (40, 0)]]  # no area
    shapes[63] = [[(-1000, -1000), (1000, -1000), (1000, 1000), (-1000, 1000)]]
    shapes[64] = [[(8, 3), (8, 3), (30, 3), (30, 3.2), (8, 3.2)]]  # between centre lines
    rows = [(k, g, o, float(x), float(y), "z") for k, s in shapes.items() for g, ring in enumerate(s) for o, (x, y) in enumerate(ring)]
    vertices = spark.createDataFrame(rows, "polygon long, ring int, ord int, x double, y double, c string").repartition(3)
    cells = spark.createDataFrame([(c, r, None if c == 3 else 1.0) for c in range(-3, 40) for r in range(-2, 30)],
                                  "c int, r int, polygon_value double")
    want = {(k, c, r) for k, s in shapes.items() for c in range(-3, 40) for r in range(-2, 30) if crossing(s, c + .5, r + .5)}
    got = [(r.polygon, r.c, r.r) for r in polygons.join_polygons(cells, vertices, tile).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    grid = spark.createDataFrame([(c, r) for c in range(-3, 40 // tile) for r in range(-2, 30 // tile)], "col_key int, row_key int")
    hit = {(k, c // tile, r // tile) for k, c, r in want}
    tiles = {(r.polygon, r.col_key, r.row_key) for r in polygons.tiles_of_polygons(grid, vertices, tile).collect()}
    assert hit <= tiles | {h for h in hit if h[1] >= 40 // tile or h[2] >= 30 // tile}
    for k, c, r in tiles:
        assert any(crossing(shapes[k], x + .5, y + .5) for x in range(c * tile, (c + 1) * tile) for y in range(r * tile, (r + 1) * tile))


def test_only_boundary_tiles_are_tested(spark):
    ring = [(0, 0.0, 0.0), (1, 320.0, 0.0), (2, 320.0, 320.0), (3, 0.0, 320.0)]
    vertices = spark.createDataFrame([(1, 0, *v) for v in ring], "polygon int, ring int, ord int, x double, y double")
    cover = polygons.tile_cover(vertices, 32).cache()
    assert cover.filter("lines IS NULL").count() >= 64  # of 10 x 10 tiles
    assert cover.filter("lines IS NOT NULL").count() <= 40 + 8
    assert {len(r.lines) for r in cover.filter("lines IS NOT NULL").collect()} == {32}
    cells = spark.range(320 * 320).select((F.col("id") % 320).cast("int").alias("c"), F.floor(F.col("id") / 320).cast("int").alias("r"))
    assert polygons.join_polygons(cells, vertices, 32).count() == 320 * 320
    assert polygons.join_polygons(cells, vertices.limit(0), 32).count() == 0
    with pytest.raises(Exception, match="vertices need"):
        polygons.join_polygons(cells, vertices.withColumn("x", F.lit(None).cast("double")), 32).count()
    features = spark.createDataFrame([(1, 7)], "polygon int, value int")
    one = polygons.mask_by_polygons(cells.withColumn("v", F.lit(2.0)), vertices, features, ["v"]).first()
    assert (one.v, one.polygons, one.value) == (2.0, 1, 7)

import io
import os

import numpy as np
from pyspark.sql import functions as F

from dunegrid.sources import catalog, delimited, geotiff


def test_geotiff_encode_decode(tmpdir_fresh):
    rnd = np.random.default_rng(1)
    arr = rnd.normal(size=(37, 21))
    arr[3, 4] = np.nan
    for compress in (True, False):
        blob = geotiff.encode_geotiff(arr, 500000.0, 4000000.0, 30.0, -30.0, crs=32648, compress=compress,
                                      rows_per_strip=8)
        fh = io.BytesIO(blob)
        info = geotiff.read_header(fh)
        assert (info.width, info.height, info.crs) == (21, 37, 32648)
        assert (info.xmin, info.ymax, info.dx, info.dy) == (500000.0, 4000000.0, 30.0, -30.0)
        win = geotiff.read_window(fh, info, 5, 6, 10, 20)
        np.testing.assert_array_equal(win, arr[None, 6:26, 5:15])


def test_geotiff_encodings():
    rnd = np.random.default_rng(2)
    arr = rnd.integers(-30000, 30000, (33, 18, 3)).astype(float)
    arr[rnd.random(arr.shape) < 0.1] = np.nan
    for how in ("none", "lzw", "deflate"):
        for dtype, predictor in (("f8", False), ("i4", False), ("i4", True), ("i2", True)):
            blob = geotiff.encode_geotiff(arr, 0.0, 0.0, 1.0, -1.0, compress=how, rows_per_strip=7, dtype=dtype,
                                          predictor=predictor, nodata=None if dtype == "f8" else -32768)
            fh = io.BytesIO(blob)
            win = geotiff.read_window(fh, geotiff.read_header(fh), 2, 3, 15, 28)
            np.testing.assert_array_equal(win, np.moveaxis(arr[3:31, 2:17], 2, 0))


def test_lzw_round_trip():
    rnd = np.random.default_rng(3)
    for data in (b"", b"a", b"aaaa" * 5000, bytes(range(256)) * 40, rnd.integers(0, 4, 60_000).astype("u1").tobytes(),
                 rnd.integers(0, 256, 30_000).astype("u1").tobytes()):
        assert geotiff.lzw_decode(geotiff.lzw_encode(data)) == data
    # the published example of the TIFF 6.0 text: 7 7 7 8 8 7 7 6 6
    assert geotiff.lzw_decode(geotiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]))) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_uris():
    import pytest
    from pyarrow import fs
    for uri in ("s3://bucket/a/b.TIF", "s3a://bucket/a/b.TIF", "s3n://bucket/a/b.TIF"):
        filesystem, inner = geotiff.resolve(uri, {"anonymous": True, "region": "us-west-2"})
        assert isinstance(filesystem, fs.S3FileSystem) and inner == "bucket/a/b.TIF"
        assert filesystem.region == "us-west-2"
    assert geotiff.resolve("file:///tmp/x.TIF")[1] == "/tmp/x.TIF" == geotiff.resolve("/tmp/x.TIF")[1]

    class Session:
        class sparkContext:
            master = "spark://host:7077"
    with pytest.raises(ValueError):
        geotiff.shared_target(Session, "/tmp/out")
    assert geotiff.shared_target(Session, "file:///shared/out") == "file:///shared/out"


def test_geotiff_scan_windows(spark, tmpdir_fresh):
    arr = np.arange(50 * 40, dtype=float).reshape(40, 50)
    os.makedirs(f"{tmpdir_fresh}/scene_a", exist_ok=True)
    with open(f"{tmpdir_fresh}/scene_a/X_B4_REF.TIF", "wb") as fh:
        fh.write(geotiff.encode_geotiff(arr, 0.0, 0.0, 1.0, -1.0))
    tiles = geotiff.with_scene_and_band(geotiff.read_geotiff(spark, tmpdir_fresh, tile_size=16, glob="*.TIF"))
    rows = tiles.collect()
    assert len(rows) == 4 * 3
    assert {r.scene_id for r in rows} == {"scene_a"} and {r.band for r in rows} == {4}
    from dunegrid.operators import grid
    got = {(x.c, x.r): x.v for x in grid.explode_tiles(tiles).collect()}
    assert got == {(c, r): arr[r, c] for c in range(50) for r in range(40)}
    from dunegrid.operators import focal
    med = {(x.c, x.r): x.v for x in grid.explode_tiles(focal.focal_tiles(tiles, 1, "mean")).collect()}
    exp = {(c, r): float(np.mean(arr[max(0, r - 1):r + 2, max(0, c - 1):c + 2])) for c in range(50) for r in range(40)}
    assert med.keys() == exp.keys() and all(abs(med[k] - exp[k]) < 1e-9 for k in exp)


def test_geotiff_sink_round_trip(spark, tmpdir_fresh):
    df = spark.createDataFrame([(0, 0, 3, 2, [1.0, None, 3.0, 4.0, 5.0, 6.0], 0.0, 0.0, 1.0, -1.0)],
                               "col_key int, row_key int, cols int, rows int, cells array<double>, "
                               "xmin double, ymax double, dx double, dy double")
    written = geotiff.write_geotiff(df, tmpdir_fresh).collect()
    assert len(written) == 1
    back = geotiff.read_geotiff(spark, tmpdir_fresh, tile_size=8).collect()
    assert back[0].cells == [1.0, None, 3.0, 4.0, 5.0, 6.0]


def test_catalog_pruning(spark, tmpdir_fresh):
    cells = spark.createDataFrame([(c, r, float(c * r)) for c in range(64) for r in range(64)],
                                  "c int, r int, v double")
    path = f"{tmpdir_fresh}/cat"
    catalog.write_catalog(cells, path, "ndvi", 3, tile_size=16)
    catalog.write_catalog(cells.withColumn("v", F.lit(0.0)), path, "other", 3, tile_size=16)
    q = catalog.read_catalog(spark, path, "ndvi", 3, extent=(16, 2, 40, 12))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters" in plan
    assert "row_key" in plan and "IsNotNull(c)" in plan
    got = q.select("c", "r", "v").collect()
    assert len(got) == 24 * 10
    assert all(16 <= r.c < 40 and 2 <= r.r < 12 and r.v == r.c * r.r for r in got)
    assert "zkey" in plan
    layout = catalog.read_layout(spark, path, "ndvi").first()
    assert (layout.tile_size, layout.n_records, layout.col_max, layout.row_key_max) == (16, 64 * 64, 63, 3)
    # any tile size is read back right: the reader takes it from the catalog
    catalog.write_catalog(cells, path, "ndvi", 4, tile_size=32)
    assert catalog.read_catalog(spark, path, "ndvi", 4, extent=(40, 40, 200, 200)).count() == 24 * 24
    assert catalog.read_catalog(spark, path, "ndvi", 3).count() == 64 * 64  # other zooms are untouched
    import pytest
    with pytest.raises(Exception):
        catalog.write_catalog(cells.withColumn("c", F.col("c") - 1), path, "bad", 0)
    with pytest.raises(ValueError):
        catalog.read_catalog(spark, path, "ndvi", 9)


def test_windowed_sink_writes_absent_windows_as_nodata(spark, tmpdir_fresh):
    from dunegrid.operators import grid
    cells = spark.createDataFrame([(f, c, r, float(c + 100 * r)) for f in ("a/X.TIF", "Y.TIF") for c in range(50)
                                   for r in range(70) if not (16 <= c < 32 and r >= 32)],
                                  "file string, c int, r int, v double")
    tiles = grid.assemble_tiles(cells, 16, 16, keep=("file",))
    assert geotiff.write_geotiff_windows(tiles, tmpdir_fresh, "file", 50, 70, 16).count() == 2
    back = grid.explode_tiles(geotiff.read_geotiff(spark, tmpdir_fresh, tile_size=37), keep=("path",))
    assert back.count() == 2 * 50 * 70
    got = {(x.path.endswith("X.TIF"), x.c, x.r): x.v for x in back.filter("v is not null").collect()}
    assert got == {(x.file == "a/X.TIF", x.c, x.r): x.v for x in cells.collect()}


def test_layer_is_a_file_per_block_of_rows(spark, tmpdir_fresh):
    import os

    from dunegrid.plans import io_plans
    cells = spark.createDataFrame([(c, r, float(c + 1000 * r)) for c in range(60) for r in (0, 47, 95, 96, 200, 300, 301)],
                                  "c int, r int, v double")
    got = io_plans.edge_windows(spark, cells, tmpdir_fresh).collect()
    assert sorted((x.c, x.r, x.v) for x in got) == sorted((x.c, x.r, x.v) for x in cells.collect())
    assert sorted(f for f in os.listdir(tmpdir_fresh) if f.endswith(".TIF")) == [
        f"layer_{i}.TIF" for i in (0, 1, 2, 3)]


def test_delimited(spark, tmpdir_fresh):
    p = f"{tmpdir_fresh}/iris.txt"
    with open(p, "w") as fh:
        fh.write("5.1,3.5,1.4,0.2,Iris-setosa\n6.2,2.9,4.3,1.3,Iris-versicolor\n")
    df = delimited.read_labelled_csv(spark, p, ["sl", "sw", "pl", "pw"])
    rows = df.collect()
    assert rows[0].label == "Iris-setosa" and list(rows[1].features) == [6.2, 2.9, 4.3, 1.3]


def test_discovery_strict(spark):
    from dunegrid.operators import assembly
    paths = spark.createDataFrame([("/d/s1/A_B4_REF.TIF",), ("/d/s1/A_B5_REF.TIF",), ("/d/s2/A_B4_REF.TIF",),
                                   ("/d/s2/B_B4_REF.TIF",), ("/d/s2/A_B5_REF.TIF",)], "path string")
    import pytest
    with pytest.raises(Exception):  # two files of one band
        assembly.discover_band_files(paths, [4, 5]).collect()
    with pytest.raises(Exception):  # a scene without any requested band
        extra = paths.limit(2).unionByName(spark.createDataFrame([("/d/s3/A_B9_REF.TIF",)], "path string"))
        assembly.discover_band_files(extra, [4, 5]).collect()
    with pytest.raises(Exception):  # no file at all
        assembly.discover_band_files(paths.limit(0), [4, 5]).collect()
    ok = assembly.discover_band_files(paths.filter(~F.col("path").startswith("/d/s2/B")), [5, 4])
    assert {(r.scene_id, r.band, r.band_index) for r in ok.collect()} == {
        ("s1", 4, 1), ("s1", 5, 0), ("s2", 4, 1), ("s2", 5, 0)}


def test_merge_metadata(spark):
    import pytest
    from dunegrid.operators import assembly
    parts = spark.createDataFrame([(0.0, 0.0, 10.0, 5.0, 32648, 30.0, -30.0), (5.0, -3.0, 12.0, 4.0, 32648, 30.0, -30.0)],
                                  "xmin double, ymin double, xmax double, ymax double, crs int, dx double, dy double")
    row = assembly.merge_metadata(parts).first()
    assert (row.xmin, row.ymin, row.xmax, row.ymax, row.crs) == (0.0, -3.0, 12.0, 5.0, 32648)
    bad = parts.unionByName(spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 32649, 30.0, -30.0)], parts.schema))
    with pytest.raises(Exception):
        assembly.merge_metadata(bad).collect()

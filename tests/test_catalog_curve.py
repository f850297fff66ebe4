"""Morton ranges and what a catalog query reads."""

import glob
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dunegrid.functions.curve import in_ranges, morton_code, z_ranges
from dunegrid.functions.geometry import morton2, morton3
from dunegrid.sources import catalog


@pytest.mark.parametrize("n, side", [(2, 40), (3, 12)])
def test_ranges_cover_boxes(n, side):
    rng = random.Random(n)
    keys = [()]
    for _ in range(n):
        keys = [(*k, x) for k in keys for x in range(side)]
    for _ in range(60):
        ends = [sorted(rng.choices(range(side), k=2)) for _ in range(n)]
        lo, hi = [e[0] for e in ends], [e[1] for e in ends]
        inside = {morton_code(k) for k in keys if all(a <= x <= b for x, a, b in zip(k, lo, hi))}
        size = [10**9]
        for budget in (1, 8, 64, 10**6):
            found = z_ranges(lo, hi, budget)
            assert len(found) <= budget and found == sorted(found)
            assert all(any(a <= c <= b for a, b in found) for c in inside)
            size.append(sum(b - a + 1 for a, b in found))
        assert size == sorted(size, reverse=True) and size[-1] == len(inside)  # exact without a budget
    assert z_ranges([3], [2]) == [] and z_ranges([5, 5], [5, 5]) == [(51, 51)]
    with pytest.raises(ValueError):
        z_ranges([-1, 0], [3, 3])


def test_codes_equal_columns(spark):
    rng = random.Random(1)
    keys = [tuple(rng.randrange(1 << 21) for _ in range(3)) for _ in range(50)] + [(5, 3, 1), (0, 0, 0)]
    rows = spark.createDataFrame(keys, "a int, b int, t int").select(
        "*", morton2("a", "b").alias("z2"), morton3("a", "b", "t").alias("z3")).collect()
    for r in rows:
        assert r.z2 == morton_code((r.a, r.b)) and r.z3 == morton_code((r.a, r.b, r.t))
    assert {(r.a, r.z3) for r in rows if r.b == 3} == {(5, 279)}


def groups_read(path: str, ranges) -> tuple[int, int]:
    """Row groups whose ``zkey`` statistics meet a range, and all row groups."""
    some = total = 0
    for name in glob.glob(f"{path}/layer=*/zoom=*/*.parquet"):
        meta = pq.ParquetFile(name).metadata
        column = meta.schema.names.index("zkey")
        for k in range(meta.num_row_groups):
            s = meta.row_group(k).column(column).statistics
            total += 1
            some += any(s.min <= b and s.max >= a for a, b in ranges)
    return some, total


def layer(spark):
    n = 128
    return spark.range(n * n * 4, numPartitions=4).select(
        (F.col("id") % n).cast("int").alias("c"), (F.floor(F.col("id") / n) % n).cast("int").alias("r"),
        F.expr("timestamp_ntz '2001-01-01 00:00:00' + make_interval(0, 0, 0, CAST(id DIV 16384 AS INT) * 120, 5)").alias("acquired"),
        F.col("id").cast("double").alias("v"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """The layer in both key orders, in small row groups."""
    path = str(tmp_path_factory.mktemp("catalog"))
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    hadoop.set("parquet.block.size", "4096")
    hadoop.set("parquet.page.size", "1024")
    hadoop.set("parquet.block.size.row.check.min", "64")
    hadoop.set("parquet.page.size.row.check.min", "64")
    try:
        catalog.write_catalog(layer(spark), f"{path}/space", "x", 0, tile_size=4)
        catalog.write_catalog(layer(spark), f"{path}/time", "x", 0, tile_size=4, time_days=30)
    finally:
        for k in ("parquet.block.size", "parquet.page.size", "parquet.block.size.row.check.min",
                  "parquet.page.size.row.check.min"):
            hadoop.unset(k)
    return path


def test_random_boxes_give_the_same_rows(spark, stored):
    rng = random.Random(4)
    cells = layer(spark).cache()
    for k in range(12):
        x, y = sorted(rng.uniform(-5, 133) for _ in range(2)), sorted(rng.uniform(-5, 133) for _ in range(2))
        extent = (x[0], y[0], x[1], y[1]) if k % 4 else None
        period = ("2001-04-01", "2001-09-01") if k % 2 else None
        want = cells
        if extent:
            want = want.filter((F.col("c") > x[0] - 1) & (F.col("c") < x[1]) & (F.col("r") > y[0] - 1) & (F.col("r") < y[1]))
        if period:
            want = want.filter("acquired BETWEEN timestamp_ntz '2001-04-01' AND timestamp_ntz '2001-09-01'")
        want = sorted(map(tuple, want.collect()))
        for order in ("space", "time"):
            got = catalog.read_catalog(spark, f"{stored}/{order}", "x", 0, extent, period, budget=rng.choice([4, 64]))
            assert sorted(map(tuple, got.select("c", "r", "acquired", "v").collect())) == want
    cells.unpersist()


def test_ranges_prune_row_groups_of_a_box_across_quadrants(spark, stored):
    extent = (60, 60, 68, 68)  # the middle of the layer: its corners' codes span half of all
    row = catalog.read_layout(spark, f"{stored}/space", "x").first()
    ranges = catalog.key_ranges(row, extent)
    few, total = groups_read(f"{stored}/space", ranges)
    one, _ = groups_read(f"{stored}/space", [(ranges[0][0], ranges[-1][1])])
    assert total > 100 and few <= 16 < total / 3 < one
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    try:
        read = catalog.read_catalog(spark, f"{stored}/space", "x", 0, extent)
        plan = read._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters"):].split("\n")[0]
    assert "Or(" in pushed and "EqualTo(zkey,768)" in pushed


def test_period_prunes_with_the_area_in_space_time_order(spark, stored):
    extent, period = (60, 60, 68, 68), ("2001-05-01", "2001-05-02")
    row = catalog.read_layout(spark, f"{stored}/time", "x").first()
    (both, total), (area, _), (whole, _) = (groups_read(f"{stored}/time", catalog.key_ranges(row, e, p))
                                            for e, p in ((extent, period), (extent, None), (None, period)))
    assert both < area and both < whole < total / 2
    row = catalog.read_layout(spark, f"{stored}/space", "x").first()
    assert catalog.key_ranges(row, extent, period) == catalog.key_ranges(row, extent)  # space alone knows no period
    assert groups_read(f"{stored}/space", catalog.key_ranges(row, None, period))[0] > total / 2


def test_layout_comes_from_file_footers(spark, stored):
    cells = layer(spark)
    for order, days in (("space", None), ("time", 30)):
        row = catalog.read_layout(spark, f"{stored}/{order}", "x").first()
        assert (row.n_records, row.col_min, row.col_max, row.row_max, row.col_key_max) == (cells.count(), 0, 127, 127, 31)
        assert row.time_days == days and (row.step_min is None) == (days is None)
    folder = f"{stored}/time/layer=x/zoom=0"
    with catalog._footer_aggregates(spark):
        plan = catalog.footer_bounds(spark, folder, [("c", "a", "b"), ("step", "s", "t")])._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(c), MAX(c), MIN(step), MAX(step)]" in plan  # nothing is scanned
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    empty = f"{stored}/empty"
    catalog.write_catalog(cells.limit(0), empty, "x", 0)
    assert catalog.read_layout(spark, empty, "x").first().n_records == 0


def test_no_ranges_is_no_row(spark):
    assert spark.range(3).filter(in_ranges(F.col("id"), [])).count() == 0
    with pytest.raises(Exception, match="1970"):
        bad = layer(spark).limit(1).withColumn("acquired", F.lit("1960-01-01").cast("timestamp_ntz"))
        import tempfile
        catalog.write_catalog(bad, tempfile.mkdtemp(prefix="dunegrid-test-"), "x", 0, time_days=1)

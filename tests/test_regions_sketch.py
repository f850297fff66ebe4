"""Regions of a class raster, the quantile summary, blocked folds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunegrid.operators import ml, regions, sketch, stats


def flood(cells):
    """Regions of {(c, r): class} by flood fill."""
    out, seen = [], set()
    for start in sorted(cells, key=lambda p: (p[1], p[0])):
        if start in seen:
            continue
        todo, mine, sides = [start], set(), 0
        seen.add(start)
        while todo:
            c, r = todo.pop()
            mine.add((c, r))
            for p in ((c - 1, r), (c + 1, r), (c, r - 1), (c, r + 1)):
                if cells.get(p) != cells[start]:
                    sides += 1
                elif p not in seen:
                    seen.add(p)
                    todo.append(p)
        cs, rs = [p[0] for p in mine], [p[1] for p in mine]
        out.append((start[1] * 2**31 + start[0], cells[start], len(mine), min(cs), max(cs), min(rs), max(rs), sides))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("component", "class", "cells", "col_min", "col_max", "row_min", "row_max",
                                              "perimeter").collect())


@pytest.mark.parametrize("tile", [4, 16])
def test_regions_against_flood_fill(spark, tile):
    rng = random.Random(tile)
    cells = {(c, r): rng.choice([1, 1, 1, 2, 5]) for c in range(40) for r in range(24) if rng.random() < 0.93}
    for k in range(24):  # a spiral arm through many tiles and a comb
        cells[k, 0] = cells[39, k] = 9
    df = spark.createDataFrame([(c, r, k, "x") for (c, r), k in cells.items()] + [(50, 50, None, "y")],
                               "c int, r int, class int, label string").repartition(5)
    assert rows_of(regions.class_regions(df, "class", tile)) == flood(cells)


def test_one_region_across_all_tiles(spark):
    n = 96
    df = spark.range(n * n).select((F.col("id") % n).cast("int").alias("c"), F.floor(F.col("id") / n).cast("int").alias("r"),
                                   F.lit(3).alias("class"))
    assert rows_of(regions.class_regions(df, "class", 8)) == [(0, 3, n * n, 0, n - 1, 0, n - 1, 4 * n)]
    local = regions.local_regions(df, "class", 8)
    assert local.count() == (n // 8) ** 2 and regions.border_links(local, 8).count() == 2 * (n // 8 - 1) * n
    assert regions.class_regions(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="several rows"):
        regions.class_regions(df.unionByName(df), "class", 8).collect()


def test_contraction_of_paths(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (60, 40), (60, 70)], "a long, b long")
    got = {r.label: r.component for r in regions.contract(links).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 50: 40, 60: 40, 70: 40}


@pytest.mark.parametrize("size, parts", [(64, 1), (64, 40), (100_000, 7)])
def test_sketch_ranks_are_within_the_bound(spark, size, parts):
    rng = np.random.default_rng(size + parts)
    values = np.concatenate([rng.normal(size=9000), np.full(4000, 0.25), rng.exponential(50, 3000)])
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(parts)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")  # many merges
    try:
        row = sketch.quantile_sketch(df, "v", size, fan=4).collect()[0]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert row.n == len(values) == sum(row.weights) and len(row["values"]) <= max(size, 10) and row.bound < 0.5 * row.n
    upto, at = np.cumsum(row.weights), np.sort(values)
    for x in [*rng.choice(values, 300), -1e9, 1e9, 0.25]:
        told = upto[np.searchsorted(row["values"], x, side="right") - 1] if x >= row["values"][0] else 0
        assert abs(int(told) - int(np.searchsorted(at, x, side="right"))) <= row.bound
    if size > len(values):
        assert row.bound == 0


def test_sketch_of_few_and_no_values(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "v double")
    got = {r.p: r.value for r in sketch.sketch_percentiles(sketch.quantile_sketch(df, "v"), [0.0, 0.5, 0.9, 1.0]).collect()}
    assert got == {0.0: 1.0, 0.5: 1.0, 0.9: 3.0, 1.0: 3.0}
    assert sketch.quantile_sketch(df.limit(0), "v").collect() == []


def test_fvc_may_take_the_sketch(spark):
    df = spark.range(1000).select((F.col("id") / 1000).alias("ndvi"))
    exact = {r.ndvi: r.fvc for r in stats.fvc_from_quantiles(df).collect()}
    near = {r.ndvi: r.fvc for r in stats.fvc_from_quantiles(df, sketch_size=200).collect()}
    assert max(abs(exact[k] - near[k]) for k in exact) < 0.05


def test_folds_are_whole_blocks_apart(spark):
    cells = spark.range(64 * 64).select((F.col("id") % 64).cast("int").alias("c"), F.floor(F.col("id") / 64).cast("int").alias("r"))
    rows = ml.with_spatial_fold(cells, 8, 4, buffer=1).collect()
    fold = {(r.c, r.r): r.fold for r in rows}
    assert len(rows) == 64 * 6 * 6 and set(fold.values()) == {0, 1, 2, 3}
    for (c, r), f in fold.items():
        for dc in range(-2, 3):
            for dr in range(-2, 3):
                assert fold.get((c + dc, r + dr), f) == f
    assert ml.with_spatial_fold(cells, 8, 4).count() == 64 * 64

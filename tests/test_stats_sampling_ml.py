import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dunegrid.operators import ml, ordering, sampling, stats


def test_with_position_and_running_sums(spark):
    vals = [(float(v), int(w)) for v, w in zip(np.random.default_rng(0).integers(0, 1000, 500), range(1, 501))]
    df = spark.createDataFrame(vals, "v double, w long").repartition(7)
    out = ordering.with_position(df, ["v", "w"], ["w"]).orderBy("pos").collect()
    exp = sorted(vals)
    assert [r.pos for r in out] == list(range(1, 501))
    assert [(r.v, r.w) for r in out] == exp
    assert out[-1].cum_w == sum(w for _, w in vals)


def test_exact_percentiles(spark):
    x = np.random.default_rng(4).normal(size=1001)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    got = dict(stats.exact_percentiles(df, "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect())
    for p, v in got.items():
        assert math.isclose(v, float(np.quantile(x, p)), abs_tol=1e-12)


def test_sampling(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(300)], "id int, v double")
    s = sampling.sample_exact(df, 50, ["id"]).collect()
    assert len({r.id for r in s}) == 50
    d = sampling.sample_with_repeats(df, 400, ["id"]).collect()
    assert len(d) == 400 and len({r.draw for r in d}) == 400
    split = sampling.random_split(df, [0.7, 0.3], ["id"], labels=["a", "b"]).groupBy("split").count().collect()
    counts = {r.split: r["count"] for r in split}
    assert 150 < counts["a"] < 250


def test_linear_regression_fixture(spark):
    # FIXTURES section 1: rows (x, -5x + 4) for x = 0..998, and a last row (0, 0)
    line = spark.range(999).select(F.col("id").cast("double").alias("x"),
                                   (F.col("id") * -5 + 4).cast("double").alias("y"))
    line = line.unionByName(spark.createDataFrame([(0.0, 0.0)], "x double, y double"))
    _, rep, residuals = ml.linear_regression(line, ["x"], "y")
    r = rep.first()
    assert abs(r.coefficients[0] - -4.998936877614123) < 1e-6 and len(r.objective_history) >= 1
    assert residuals.count() == 1000
    assert abs(r.intercept - 3.4660324275183845) < 1e-3
    cf = ml.regression_closed_form(line, "y", "x").first()
    assert abs(cf.slope - -4.999976071641505) < 1e-9 and abs(cf.intercept - 3.9840716893618264) < 1e-9


def test_kmeans_rows_nearest_centre(spark):
    rnd = np.random.default_rng(1)
    pts = [(i, 0, float(a), float(b)) for i, (a, b) in enumerate(rnd.normal(size=(200, 2)) * 3)]
    df = spark.createDataFrame(pts, "c int, r int, x double, y double")
    model, pred, cost = ml.kmeans_pixels(df, ["x", "y"], k=4, seed=3)
    centres = model.stages[-1].clusterCenters()
    for row in pred.collect():
        d = [(row.x - cx) ** 2 + (row.y - cy) ** 2 for cx, cy in centres]
        assert row.prediction == int(np.argmin(d))
    assert cost > 0


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_positions_with_payload_columns(spark, coalesce):
    """3 M rows with a payload column: ids are 0 ... n-1 in key order, each with its own row."""
    n = 3_000_000
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        key = F.pmod(F.col("id") * 7_368_787, F.lit(n))
        df = spark.range(n).select(key.alias("k"), F.concat(F.lit("p"), key.cast("string")).alias("payload"))
        out = sampling.dense_ids(df, ["k"])
        bad = out.filter((F.col("id") != F.col("k")) | (F.col("payload") != F.concat(F.lit("p"), F.col("id"))))
        assert (out.count(), bad.count()) == (n, 0)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_sample_with_repeats_keeps_every_draw(spark):
    df = spark.range(400_000).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    out = sampling.sample_with_repeats(df, 50_000, ["k"])
    assert out.count() == 50_000
    assert out.filter("v <> 3 * k").count() == 0


def test_sample_exact_takes_the_first_in_hash_order(spark):
    df = spark.range(20_000).select(F.col("id"), (F.col("id") * 2).alias("v"))
    got = {r.id for r in sampling.sample_exact(df, 500, ["id"], seed=3).collect()}
    exp = {r.id for r in df.orderBy(sampling.hash_key(3, ["id"])).limit(500).collect()}
    assert got == exp
    assert sampling.sample_exact(df.limit(5), 5, ["id"]).count() == 5


def test_release_tables(spark):
    import os
    from dunegrid import session
    df = session.materialize(spark.range(5), "to-release")
    path = session._SCRATCH[-1]
    assert df.count() == 5 and os.path.isdir(session.local_path(path))
    kept, session._SCRATCH[:] = session._SCRATCH[:-1], [path]
    assert session.release_tables(spark) == 1 and not os.path.isdir(session.local_path(path))
    session._SCRATCH[:] = kept

from pyspark.sql import functions as F

from dunegrid.sources import testdata as td
from dunegrid.streaming import composite
from tests.conftest import SF_SMALL


def test_stream_composite_equals_batch(spark, tmpdir_fresh):
    px = td.px(spark, SF_SMALL).select("scene", "acquired", "c", "r",
                                       F.when(F.col("red") < 3400, F.col("red")).alias("red"), "nir")
    src = f"{tmpdir_fresh}/obs"
    for k in range(4):  # scenes arrive one after the other
        px.filter(F.col("scene") == k).write.mode("append").parquet(src)
    q = composite.start_composite(spark, src, f"{tmpdir_fresh}/ckpt", "comp_test", trigger_once=True)
    q.awaitTermination(120)
    got = {(r.c, r.r): r.ndvi for r in spark.sql("SELECT * FROM comp_test").collect()}
    from dunegrid.operators.composite import max_ndvi_composite
    exp = {(r.c, r.r): r.ndvi for r in max_ndvi_composite(px, "1900-01-01", "2100-01-01").collect()}
    assert got == exp


def test_stream_period_composite_with_watermark(spark, tmpdir_fresh):
    px = td.px(spark, SF_SMALL).select("scene", "acquired", "c", "r", "red", "nir")
    src = f"{tmpdir_fresh}/obs"
    px.write.mode("append").parquet(src)
    q = composite.start_composite(spark, src, f"{tmpdir_fresh}/ckpt", "comp_period", period_days=365,
                                  trigger_once=True)
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM comp_period").collect()
    # append mode emits only periods closed by the watermark (max time - 30 days)
    assert got
    from dunegrid.functions.indices import ndvi
    one = got[0]
    exp = (px.filter((F.col("c") == one.c) & (F.col("r") == one.r))
           .filter((F.col("acquired").cast("timestamp") >= F.lit(one.period_start))
                   & (F.col("acquired").cast("timestamp") < F.lit(one.period_start) + F.expr("INTERVAL 365 DAYS")))
           .agg(F.max(ndvi("red", "nir"))).first()[0])
    assert exp == one.ndvi

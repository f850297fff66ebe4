import math

import pytest
from pyspark.sql import functions as F

from dunegrid.functions import indices as ix

# Golden values (FIXTURES section 3): blue, green, red, nir, swir1, swir2
CASES = [
    ((.05, .08, .10, .40, .30, .20), dict(ndvi=0.6, albedo=0.2181, msavi=0.4417424305, tgsi=0.2173913043, s=1.13)),
    ((.20, .25, .30, .35, .40, .38), dict(ndvi=0.0769230769, albedo=0.30031, msavi=0.0610133081, tgsi=0.1333333333, s=1.88)),
    ((0.0,) * 6, dict(ndvi=None, albedo=-0.0018, msavi=0.0, tgsi=None, s=0.0)),
    ((None, .08, .10, .40, .30, .20), dict(ndvi=0.6, albedo=None, msavi=0.4417424305, tgsi=None, s=None)),
    ((.05, .08, None, .40, .30, .20), dict(ndvi=None, albedo=None, msavi=None, tgsi=None, s=None)),
]


@pytest.mark.parametrize("bands,expected", CASES)
def test_golden(spark, bands, expected):
    df = spark.createDataFrame([bands], "blue double, green double, red double, nir double, swir1 double, swir2 double")
    row = df.select(
        ix.ndvi("red", "nir").alias("ndvi"),
        ix.albedo("blue", "red", "nir", "swir1", "swir2").alias("albedo"),
        ix.msavi("red", "nir").alias("msavi"),
        ix.tgsi("blue", "green", "red").alias("tgsi"),
        ix.band_sum("blue", "green", "red", "nir", "swir1", "swir2").alias("s"),
    ).first()
    for k, v in expected.items():
        if v is None:
            assert row[k] is None, k
        else:
            assert math.isclose(row[k], v, abs_tol=1e-9), (k, row[k], v)


def test_fvc_and_guards(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.9), (0.5, 0.3, 0.3)], "n double, s double, v double")
    got = [r[0] for r in df.select(ix.fvc("n", "s", "v")).collect()]
    assert math.isclose(got[0], 0.5) and got[1] is None


def test_threshold_clamp_rescale(spark):
    df = spark.createDataFrame([(12000.0,), (5000.0,), (None,), (3000.0,)], "z double")
    rows = df.select(ix.threshold("z", 10000).alias("t"), ix.clamp("z", 4000, 15176).alias("c"),
                     ix.rescale(ix.clamp("z", 4000, 15176), 4000, 15176).alias("b")).collect()
    assert rows[0]["t"] is None and rows[1]["t"] == 5000.0 and rows[2]["t"] is None
    assert rows[2]["c"] is None and rows[3]["c"] == 4000.0 and rows[0]["c"] == 12000.0
    assert rows[3]["b"] == 0 and rows[0]["b"] == int((12000 - 4000) * 255 / 11176)


def test_nodata_from(spark):
    df = spark.createDataFrame([(float("nan"),), (-9999.0,), (1.0,)], "z double")
    got = [r[0] for r in df.select(ix.nodata_from("z", -9999)).collect()]
    assert got == [None, None, 1.0]


def test_ndvi_range_property(spark):
    from hypothesis import given, settings, strategies as st

    @settings(max_examples=10, deadline=None)
    @given(st.lists(st.tuples(st.floats(0, 1e4), st.floats(0, 1e4)), min_size=1, max_size=20))
    def check(pairs):
        df = spark.createDataFrame(pairs, "red double, nir double")
        for (v,) in df.select(ix.ndvi("red", "nir")).collect():
            assert v is None or -1.0 <= v <= 1.0

    check()

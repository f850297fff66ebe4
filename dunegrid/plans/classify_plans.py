"""Registered queries: Jenks natural breaks, class assignment, sampling, ordering."""

from __future__ import annotations

from pyspark.sql import functions as F

from dunegrid.functions import indices as ix
from dunegrid.operators import jenks, sampling
from dunegrid.plans.registry import register, with_ctes
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
NM = ("nm", td.NM_SQL)
NDVI_SQL = "CASE WHEN nir + red = 0 THEN NULL ELSE (nir - red) / (nir + red) END"

K = 6


@register("jenks_breaks", ops=("J1", "F1"),
          sql=jenks.jenks_sql("SELECT v AS value FROM nm", K, lead=(PX, NM)))
def jenks_breaks(spark, sf):
    return jenks.jenks_breaks_df(td.max_nir(spark, sf), "v", K)


@register("jenks_classes", ops=("J2", "J1"),
          sql=jenks.jenks_sql("SELECT v AS value FROM nm", K, lead=(PX, NM),
                              classify_sql="SELECT c, r, v AS value FROM nm"))
def jenks_classes(spark, sf):
    nm = td.max_nir(spark, sf)
    b = jenks.jenks_breaks(nm, "v", K)
    return jenks.classify(nm.select("c", "r", F.col("v").alias("value")), "value", b)


@register("jenks_band_sum", ops=("J3", "H3", "B9", "J1"),
          sql=jenks.jenks_sql("SELECT blue + green + red + nir + swir1 + swir2 AS value FROM px", K, lead=(PX,)))
def jenks_band_sum(spark, sf):
    # six-band sum over every data cell, k = 6 (no sampling: the operator
    # scales through value compression and divide-and-conquer layers)
    s = td.px(spark, sf).select(ix.band_sum(*td.BANDS).alias("s")).filter(F.col("s").isNotNull())
    return jenks.jenks_breaks_df(s, "s", K)


GROUP_K = 4
# Scene by scene and half by half, each group by brute force.
_GROUP_SQL = "SELECT CAST(round(avg(nir) / 100) AS DOUBLE) AS value FROM px WHERE scene = {0} AND c % 2 = {1} GROUP BY c, r"
_GROUPS = " UNION ALL ".join(
    f"SELECT {s} AS scene, {h} AS half, break_index, break_value FROM ("
    + jenks.jenks_sql(_GROUP_SQL.format(s, h), GROUP_K, lead=(PX,)) + ")" for s in range(4) for h in range(2))


@register("jenks_breaks_by_group", ops=("J1", "J2"), sql=_GROUPS)
def jenks_breaks_by_group(spark, sf):
    """Breaks per scene and half of the columns, all groups in the same jobs."""
    cells = td.px(spark, sf).groupBy(F.col("scene").cast("int").alias("scene"), (F.col("c") % 2).alias("half"), "c", "r").agg(
        F.round(F.avg("nir") / 100).alias("v"))
    return jenks.jenks_breaks_by(cells, "v", GROUP_K, ["scene", "half"])


@register("value_sort", ops=("F1",),
          sql=with_ctes(PX, NM, body="SELECT value, row_number() OVER (ORDER BY value) AS rank "
                                      "FROM (SELECT DISTINCT v AS value FROM nm WHERE v IS NOT NULL) t"))
def value_sort(spark, sf):
    return sampling.value_ranks(td.max_nir(spark, sf), "v")


@register("dense_ids_payload", ops=("F1", "F3"),
          sql=with_ctes(PX, body="""
SELECT row_number() OVER (ORDER BY c, r) - 1 AS id, c, r, red, nir, swir1
FROM (SELECT c, r, max(red) AS red, max(nir) AS nir, max(swir1) AS swir1 FROM px GROUP BY c, r) t"""))
def dense_ids_payload(spark, sf):
    """Ids in key order on rows that carry columns outside the key."""
    cells = td.px(spark, sf).groupBy("c", "r").agg(*[F.max(b).alias(b) for b in ("red", "nir", "swir1")])
    return sampling.dense_ids(cells, ["c", "r"])


SEED = 7


@register("sample_exact", ops=("F2",),
          sql=with_ctes(PX, NM, body=f"""
SELECT c, r, v FROM nm
ORDER BY md5('{SEED}:' || CAST(c AS VARCHAR) || ',' || CAST(r AS VARCHAR)), c, r LIMIT 100"""))
def sample_exact(spark, sf):
    return sampling.sample_exact(td.max_nir(spark, sf), 100, ["c", "r"], seed=SEED)


@register("sample_with_repeats", ops=("F3",),
          sql=with_ctes(PX, NM, ("ided", "SELECT c, r, v, row_number() OVER (ORDER BY c, r) - 1 AS id FROM nm"),
                        body=f"""
SELECT d.draw, ided.c, ided.r, ided.v
FROM (SELECT range AS draw,
             ('0x' || substr(md5('{SEED}:' || CAST(range AS VARCHAR)), 1, 15))::BIGINT % (SELECT count(*) FROM ided) AS id
      FROM range(0, 500)) d JOIN ided ON ided.id = d.id"""))
def sample_with_repeats(spark, sf):
    return sampling.sample_with_repeats(td.max_nir(spark, sf), 500, ["c", "r"], seed=SEED)


@register("random_split_hash", ops=("F5",),
          sql=with_ctes(PX, NM, body=f"""
SELECT c, r, CASE WHEN ('0x' || substr(md5('{SEED}:' || CAST(c AS VARCHAR) || ',' || CAST(r AS VARCHAR)), 1, 8))::BIGINT
                      / 4294967296.0 < 0.7 THEN 'train' ELSE 'test' END AS split
FROM nm"""))
def random_split_hash(spark, sf):
    out = sampling.random_split(td.max_nir(spark, sf), [0.7, 0.3], ["c", "r"], seed=SEED,
                                labels=["train", "test"])
    return out.select("c", "r", "split")


@register("top_ndvi_cells", ops=("F6",),
          sql=with_ctes(PX, body=f"""
SELECT c, r, max({NDVI_SQL}) AS ndvi FROM px GROUP BY c, r ORDER BY ndvi DESC, c, r LIMIT 20"""))
def top_ndvi_cells(spark, sf):
    comp = td.px(spark, sf).groupBy("c", "r").agg(F.max(ix.ndvi("red", "nir")).alias("ndvi"))
    return comp.orderBy(F.col("ndvi").desc(), "c", "r").limit(20)

"""Layer statistics: min/max, normalisation, exact percentiles, histograms, FVC.

Exact percentiles never gather the column into one aggregation buffer (what
``percentile`` does): values are first compressed to (value, count) with a
partial aggregation, the distinct values get running counts through
:func:`dunegrid.operators.ordering.with_position`, and only the few rows that
hold the requested ranks are read back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dunegrid.functions.indices import fvc, safe_div
from dunegrid.operators.ordering import with_position
from dunegrid.operators.sketch import quantile_sketch, sketch_percentiles
from dunegrid.session import materialize


def min_max(df: DataFrame, col: str) -> DataFrame:
    """One row (vmin, vmax, n_data, n_cells) over the layer."""
    return df.agg(F.min(col).alias("vmin"), F.max(col).alias("vmax"),
                  F.count(col).alias("n_data"), F.count(F.lit(1)).alias("n_cells"))


def normalize(df: DataFrame, col: str, out: str | None = None,
              by: Sequence[str] | None = None) -> DataFrame:
    """(v - min) / (max - min); min == max is nodata.

    ``by=None`` scales over the whole layer with two scalar subqueries (Spark
    runs them as separate small jobs and inlines the numbers: no join, no
    single-partition step).  ``by=[keys]`` scales within each group (e.g. per
    tile) with a grouped aggregate joined back on the keys.
    """
    out = out or col
    v = F.col(col)
    if by is None:
        lo = df.select(F.min(col)).scalar()
        hi = df.select(F.max(col)).scalar()
        return df.withColumn(out, safe_div(v - lo, hi - lo))
    stats = df.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
    return (df.join(stats, list(by))
            .withColumn(out, safe_div(v - F.col("_lo"), F.col("_hi") - F.col("_lo")))
            .drop("_lo", "_hi"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Distinct data values with their counts (value, w)."""
    return (df.filter(F.col(col).isNotNull())
            .groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("w")))


def exact_percentiles(df: DataFrame, col: str, probs: Sequence[float]) -> DataFrame:
    """Exact interpolated percentiles (``quantile_cont``): one row (p, value) per prob.

    Rank h = p (N - 1) (0-based); result = x[floor h] + (h - floor h)(x[ceil h] - x[floor h]).
    """
    spark = df.sparkSession
    # written once: both the total and the rank look-ups read the same table
    vc = materialize(value_counts(df, col), "percentile-values")  # one pass over the source
    vc = materialize(with_position(vc, ["value"], ["w"]), "percentile-ranks")
    # cum_w is the inclusive running count: value covers ranks [cum_w - w, cum_w - 1]
    n_total = vc.select(F.max("cum_w")).scalar()
    targets = spark.createDataFrame([(float(p),) for p in probs], "p double")
    h = F.col("p") * (n_total - 1)
    targets = targets.select("p", h.alias("h"),
                             F.floor(h).alias("k_lo"), F.ceil(h).alias("k_hi"))
    lo_b = vc.select(F.col("value").alias("x_lo"), (F.col("cum_w") - F.col("w")).alias("a_lo"),
                     (F.col("cum_w") - 1).alias("b_lo"))
    hi_b = vc.select(F.col("value").alias("x_hi"), (F.col("cum_w") - F.col("w")).alias("a_hi"),
                     (F.col("cum_w") - 1).alias("b_hi"))
    t = F.broadcast(targets)
    lo = lo_b.join(t, (F.col("k_lo") >= F.col("a_lo")) & (F.col("k_lo") <= F.col("b_lo")))
    lo = lo.select("p", "h", "k_lo", "k_hi", "x_lo")
    hi = hi_b.join(F.broadcast(targets.select("p", "k_hi")),
                   (F.col("k_hi") >= F.col("a_hi")) & (F.col("k_hi") <= F.col("b_hi")))
    hi = hi.select(F.col("p").alias("_p"), "x_hi")
    res = lo.join(hi, lo["p"] == hi["_p"])
    frac = F.col("h") - F.col("k_lo")
    return res.select("p", (F.col("x_lo") + frac * (F.col("x_hi") - F.col("x_lo"))).alias("value"))


def percentile_values(df: DataFrame, col: str, probs: Sequence[float]) -> list[float]:
    """The percentiles as driver floats (a handful of numbers)."""
    rows = {r["p"]: r["value"] for r in exact_percentiles(df, col, probs).collect()}
    return [rows[float(p)] for p in probs]


def quantile_breaks(df: DataFrame, col: str, n: int) -> DataFrame:
    """``n``-quantile breaks (break_index 1..n-1, value): exact percentiles at i / n."""
    res = exact_percentiles(df, col, [i / n for i in range(1, n)])
    return res.select((F.round(F.col("p") * n)).cast("int").alias("break_index"), F.col("value"))


def histogram(df: DataFrame, col: str, lo: float, width: float) -> DataFrame:
    """Fixed-width histogram (bin, n); bin = floor((v - lo) / width)."""
    b = F.floor((F.col(col) - F.lit(lo)) / F.lit(width)).cast("long")
    return (df.filter(F.col(col).isNotNull()).groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def fvc_from_quantiles(df: DataFrame, ndvi_col: str = "ndvi", p_soil: float = 0.10,
                       p_veg: float = 0.95, out: str = "fvc", sketch_size: int | None = None) -> DataFrame:
    """FVC with soil / vegetation end-members taken as NDVI percentiles of the layer.

    The original read breaks 1 and n-2 of a 20-quantile histogram of the
    NDVI raster (an integer histogram of values in [-1, 1], which loses the
    information); here they are exact percentiles at ``p_soil``/``p_veg``, or
    with ``sketch_size`` those of a one-pass summary of that many values.
    """
    if sketch_size is None:
        soil, veg = percentile_values(df, ndvi_col, [p_soil, p_veg])
    else:
        found = sketch_percentiles(quantile_sketch(df, ndvi_col, sketch_size), [p_soil, p_veg]).collect()
        soil, veg = ({r["p"]: r["value"] for r in found}.get(p) for p in (p_soil, p_veg))
    return df.withColumn(out, fvc(F.col(ndvi_col), F.lit(soil), F.lit(veg)))

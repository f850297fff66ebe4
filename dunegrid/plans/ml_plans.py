"""Registered queries: k-means, regression, logistic pipeline, evaluation, label encoding."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from dunegrid.functions import indices as ix
from dunegrid.operators import grid as gr
from dunegrid.operators import ml, sampling
from dunegrid.plans.grid_plans import RS_DST, resample_sql
from dunegrid.plans.registry import register, with_ctes
from dunegrid.session import materialize
from dunegrid.sources import testdata as td

PX = ("px", td.PX_SQL)
PXL = ("pxl", td.PX_SQL.replace("FROM lineitem", ", l_returnflag AS label, l_discount, l_tax FROM lineitem"))


def _features(spark, sf):
    """Per-pixel features: max red and max nir over time (integer valued)."""
    return td.px(spark, sf).groupBy("c", "r").agg(F.max("red").alias("red"), F.max("nir").alias("nir"))


FEATS = ("feats", "SELECT c, r, max(red) AS red, max(nir) AS nir FROM px GROUP BY c, r")
K = 6


@register("kmeans_pixels", ops=("J4", "B17"),
          sql=with_ctes(PX, FEATS, body="SELECT c, r, true AS label_in_range, true AS nearest FROM feats"))
def kmeans_pixels(spark, sf):
    """Labels and centres depend on the seed; what every fit must satisfy does
    not: each pixel's label is in range and names its nearest centre."""
    model, pred, _ = ml.kmeans_pixels(_features(spark, sf), ["red", "nir"], k=K, seed=1)
    centres = [[float(x) for x in v] for v in model.stages[-1].clusterCenters()]
    own = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in centres]),
                       F.col("prediction") + 1)
    mine = (F.col("red") - own["a"]) * (F.col("red") - own["a"]) + (F.col("nir") - own["b"]) * (F.col("nir") - own["b"])
    _, best = ml.nearest_centre([F.col("red"), F.col("nir")], centres)
    return pred.select("c", "r", F.col("prediction").between(0, len(centres) - 1).alias("label_in_range"),
                       (mine <= best * (1 + 1e-9) + 1e-6).alias("nearest"))


@register("kmeans_cost", ops=("J4", "D10"),
          sql=with_ctes(PX, FEATS, body=f"""
SELECT count(*) AS n, {K} AS clusters, true AS cost_is_sse, true AS centres_are_means FROM feats"""))
def kmeans_cost(spark, sf):
    """The reported cost is the within-set sum of squares of the fitted centres,
    and the centres are their members' means up to the fit's tolerance."""
    model, pred, cost = ml.kmeans_pixels(_features(spark, sf), ["red", "nir"], k=K, seed=1, max_iter=100)
    centres = [[float(x) for x in v] for v in model.stages[-1].clusterCenters()]
    sse = ml.within_set_sse(pred, ["red", "nir"], centres).agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"),
                                                               F.count(F.lit(1)).alias("clusters"))
    own = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in centres]),
                       F.col("prediction") + 1)
    means = pred.select("prediction", "red", "nir", own.alias("own")).groupBy("prediction").agg(
        F.greatest(F.abs(F.avg("red") - F.max("own.a")), F.abs(F.avg("nir") - F.max("own.b"))).alias("gap"))
    gap = means.agg(F.max("gap").alias("gap"))
    return sse.crossJoin(gap).select(  # two one-row aggregates
        "n", F.col("clusters").cast("int").alias("clusters"),
        (F.abs(F.col("sse") - F.lit(float(cost))) <= 1e-6 * F.abs(F.col("sse"))).alias("cost_is_sse"),
        (F.col("gap") < 1.0).alias("centres_are_means"))


@register("cluster_map", ops=("J5", "D5", "I6", "I7"),
          sql=with_ctes(PX, FEATS, body=resample_sql("feats", "true AS same_class")))
def cluster_map(spark, sf):
    """The class raster as tiles, resampled to the target size; every target
    cell holds the class of the source cell under its centre."""
    _, pred, _ = ml.kmeans_pixels(_features(spark, sf), ["red", "nir"], k=K, seed=1)
    cls = materialize(pred.select("c", "r", F.col("prediction").cast("double").alias("v")), "classes")
    tiles = gr.assemble_tiles(cls, 32, 32)                   # class raster as tiles
    cells = gr.explode_tiles(tiles).filter(F.col("v").isNotNull())
    out = gr.resample_to_size(cells, ["v"], *RS_DST)
    size = cls.agg((F.max("c") + 1).cast("double").alias("w"), (F.max("r") + 1).cast("double").alias("h"))
    under = out.select("c", "r", "v",
                       F.floor((F.col("c") + 0.5) * (size.select("w").scalar() / RS_DST[0])).cast("int").alias("sc"),
                       F.floor((F.col("r") + 0.5) * (size.select("h").scalar() / RS_DST[1])).cast("int").alias("sr"))
    src = cls.select(F.col("c").alias("sc"), F.col("r").alias("sr"), F.col("v").alias("class"))
    return under.join(src, ["sc", "sr"]).select("c", "r", (F.col("v") == F.col("class")).alias("same_class"))


# Six centres in (max red, max nir) feature space.
CENTRES = ((3500.0, 9000.0), (3500.0, 10000.0), (3200.0, 8000.0),
           (2900.0, 9500.0), (3500.0, 10400.0), (3000.0, 7000.0))


def _centre_sql() -> str:
    ds = [f"((red - {a}) * (red - {a}) + (nir - {b}) * (nir - {b}))" for a, b in CENTRES]
    m = "least(" + ", ".join(ds) + ")"
    case = "CASE " + " ".join(f"WHEN {d} = {m} THEN {k}" for k, d in enumerate(ds)) + " END"
    return f"SELECT {case} AS cluster, {m} AS d FROM feats"


@register("kmeans_cost_fixed_centres", ops=("D10",),
          sql=with_ctes(PX, ("feats", "SELECT c, r, max(red) AS red, max(nir) AS nir FROM px GROUP BY c, r"),
                        ("a", _centre_sql()),
                        body="SELECT cluster, count(*) AS n, sum(d) AS sse FROM a GROUP BY cluster"))
def kmeans_cost_fixed_centres(spark, sf):
    return ml.within_set_sse(_features(spark, sf), ["red", "nir"], CENTRES)


@register("linreg_closed_form", ops=("J6",),
          sql=with_ctes(PX, body="""
SELECT round(regr_slope(nir, green), 6) AS slope, round(regr_intercept(nir, green), 6) AS intercept,
       round(regr_r2(nir, green), 9) AS r2, CAST(regr_count(nir, green) AS BIGINT) AS n FROM px"""))
def linreg_closed_form(spark, sf):
    r = ml.regression_closed_form(td.px(spark, sf), "nir", "green")
    return r.select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"),
                    F.round("r2", 9).alias("r2"), "n")


# Spark ML's one-feature elastic net in closed form: on standardised values the
# slope is the correlation, shrunk by the L1 share and scaled by the L2 share.
_REG, _ALPHA = 0.3, 0.8


@register("linreg_ml", ops=("J6",),
          sql=with_ctes(PX, ("m", """
SELECT corr(nir, green) AS rho, stddev_pop(nir) AS sy, stddev_pop(green) AS sx, avg(nir) AS my, avg(green) AS mx,
       count(*) AS n FROM px"""), ("w", f"""
SELECT *, sign(rho) * greatest(abs(rho) - {_REG} / sy * {_ALPHA}, 0) / (1 + {_REG} / sy * (1 - {_ALPHA})) * sy / sx AS b
FROM m"""), ("e", """
SELECT sqrt(avg((nir - my - b * (green - mx)) * (nir - my - b * (green - mx)))) AS rmse,
       avg(abs(nir - my - b * (green - mx))) AS mae, max(n) AS n FROM px, w"""), body="""
SELECT round(b, 4) AS coefficient, 1 AS n_coefficients, round(my - b * mx, 1) AS intercept, round(rmse, 2) AS rmse,
       round(mae, 2) AS mean_abs_residual, e.n AS n_residuals, true AS objective_falls
FROM w, e"""))
def linreg_ml(spark, sf):
    model, report, residuals = ml.linear_regression(td.px(spark, sf), ["green"], "nir", reg_param=_REG,
                                                    elastic_net=_ALPHA)
    res = residuals.agg(F.count(F.lit(1)).alias("n_residuals"), F.avg(F.abs("residual")).alias("mae"))
    falls = F.aggregate(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size("objective_history"))), F.lit(True),
                        lambda ok, i: ok & (F.coalesce(F.get("objective_history", i - 1), F.lit(-1e300))
                                            <= F.get("objective_history", i - 2) + 1e-9))
    return report.crossJoin(res).select(  # two one-row tables
        F.round(F.get("coefficients", F.lit(0)), 4).alias("coefficient"),
        F.size("coefficients").alias("n_coefficients"), F.round("intercept", 1).alias("intercept"),
        F.round("rmse", 2).alias("rmse"), F.round("mae", 2).alias("mean_abs_residual"), "n_residuals",
        falls.alias("objective_falls"))


# The class of an observation: does its NDVI pass 0.5?
_NDVI = "(CASE WHEN nir + red = 0 THEN NULL ELSE (nir - red) / (nir + red) END)"
_FEATURES = ["red", "nir", "swir1", "green"]
_SPLIT_SQL = """
SELECT *, CASE WHEN ('0x' || substr(md5('7:' || CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_linenumber AS VARCHAR)
    || ',' || CAST(c AS VARCHAR) || ',' || CAST(r AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < 0.7
    THEN 'train' ELSE 'test' END AS split FROM pxk"""
PXK = ("pxk", td.PX_SQL.replace("FROM lineitem", ", l_orderkey, l_linenumber FROM lineitem"))


def _labelled(spark, sf):
    p = td.px(spark, sf, extra=("l_orderkey", "l_linenumber"))
    p = p.withColumn("cover", F.when(ix.ndvi("red", "nir") > 0.5, "green").otherwise("bare"))
    return sampling.random_split(p, [0.7, 0.3], ["l_orderkey", "l_linenumber", "c", "r"], seed=7,
                                 labels=["train", "test"])


@register("logistic_pipeline", ops=("J7", "B7", "B17", "F5", "J10"),
          sql=with_ctes(PXK, ("s", _SPLIT_SQL), body=f"""
SELECT c, r, CASE WHEN {_NDVI} > 0.5 THEN 'green' ELSE 'bare' END AS label, true AS label_is_most_probable,
       true AS probabilities_sum_to_1 FROM s WHERE split = 'test'"""))
def logistic_pipeline(spark, sf):
    model, pred, _ = ml.logistic_pipeline(_labelled(spark, sf), _FEATURES, "cover")
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    p = vector_to_array("probability")
    likely = F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + x)
    return pred.select("c", "r", F.col("cover").alias("label"),
                       (F.col("predictedLabel") == likely).alias("label_is_most_probable"),
                       (F.abs(total - 1) < 1e-9).alias("probabilities_sum_to_1"))


@register("logistic_report", ops=("J9", "J8"),
          sql=with_ctes(PXK, ("s", _SPLIT_SQL), body="""
SELECT 2 AS num_classes, 4 AS num_features, 4 AS n_coefficients, 1 AS n_intercepts,
       count(*) FILTER (WHERE split = 'test') AS n_test, true AS nir_raises_green, true AS beats_majority_by_10_points,
       true AS error_is_rest FROM s"""))
def logistic_report(spark, sf):
    data = _labelled(spark, sf)
    model, pred, report = ml.logistic_pipeline(data, _FEATURES, "cover")
    pred = materialize(pred.select("cover", "indexedLabel", "prediction", "predictedLabel"), "logistic-test")
    metrics = ml.evaluate_multiclass(pred)
    green = float(model.stages[0].labels.index("green")) * 2 - 1  # +1 if "green" is the positive class
    major = pred.groupBy("cover").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("n_test"))
    return report.crossJoin(metrics).crossJoin(major).select(  # one-row tables
        "num_classes", "num_features", F.size("coefficients").alias("n_coefficients"),
        F.size("intercepts").alias("n_intercepts"), "n_test",
        (F.get("coefficients", F.lit(1)) * green > 0).alias("nir_raises_green"),
        (F.col("accuracy") > F.col("most") / F.col("n_test") + 0.1).alias("beats_majority_by_10_points"),
        (F.abs(F.col("accuracy") + F.col("test_error") - 1) < 1e-12).alias("error_is_rest"))


RULE_SQL = "CASE WHEN l_discount > 0.05 THEN 'A' WHEN l_tax > 0.04 THEN 'N' ELSE 'R' END"


@register("multiclass_metrics", ops=("J8",),
          sql=with_ctes(PXL, ("lp", f"SELECT label, {RULE_SQL} AS prediction FROM pxl"),
                        ("per", "SELECT label, prediction, count(*) AS n FROM lp GROUP BY 1, 2"),
                        ("k", "SELECT label AS k FROM per UNION SELECT prediction FROM per"),
                        ("cls", """
SELECT k.k,
  coalesce((SELECT sum(n) FROM per WHERE per.label = k.k AND per.prediction = k.k), 0) AS tp,
  coalesce((SELECT sum(n) FROM per WHERE per.label = k.k), 0) AS n_true,
  coalesce((SELECT sum(n) FROM per WHERE per.prediction = k.k), 0) AS n_pred FROM k"""),
                        ("m", """
SELECT k, tp, n_true, CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0.0 END AS prec,
       CASE WHEN n_true > 0 THEN tp / n_true ELSE 0.0 END AS rec FROM cls"""),
                        body="""
SELECT round(sum(tp) / (SELECT count(*) FROM lp), 9) AS accuracy,
       round(sum(n_true * CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END)
             / (SELECT count(*) FROM lp), 9) AS f1
FROM m"""))
def multiclass_metrics(spark, sf):
    p = td.px(spark, sf, extra=("l_returnflag", "l_discount", "l_tax"))
    rule = (F.when(F.col("l_discount") > 0.05, "A").when(F.col("l_tax") > 0.04, "N").otherwise("R"))
    lp = p.select(F.col("l_returnflag").alias("label"), rule.alias("prediction"))
    m = ml.confusion_metrics(lp, "label", "prediction")
    return m.select(F.round("accuracy", 9).alias("accuracy"), F.round("f1", 9).alias("f1"))


@register("label_index", ops=("J10",),
          sql=with_ctes(PXL, body="""
SELECT label, row_number() OVER (ORDER BY n DESC, label) - 1 AS label_index, n
FROM (SELECT label, count(*) AS n FROM pxl GROUP BY label) t"""))
def label_index(spark, sf):
    p = td.px(spark, sf, extra=("l_returnflag",))
    return ml.label_index(p, "l_returnflag").select("label", F.col("label_index").cast("bigint"), "n")

"""Pixel classification and regression with Spark ML.

Features are assembled from cell columns (one row per pixel, NULL rows
dropped first); every estimator is Spark ML's own distributed implementation.
The feature table is written once for the iterative fits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler, VectorIndexer
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dunegrid.functions.geometry import morton2
from dunegrid.session import materialize


def kmeans_pixels(cells: DataFrame, feature_cols: Sequence[str], k: int = 6, seed: int = 1,
                  max_iter: int = 20, keys: Sequence[str] = ("c", "r")):
    """k-means on pixels: assemble features, fit, assign.  Returns
    (model, predictions with ``prediction``, training cost).

    The features are written once to the shared folder (the fit scans them
    once per iteration) and nothing stays cached.
    """
    data = materialize(cells.select(*keys, *feature_cols).dropna(subset=list(feature_cols)), "kmeans-features")
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=list(feature_cols), outputCol="features"),
        KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="features", predictionCol="prediction"),
    ])
    model = pipe.fit(data)
    pred = model.transform(data)
    cost = model.stages[-1].summary.trainingCost
    return model, pred, cost


def nearest_centre(features: Sequence[Column], centres: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """(cluster index, squared distance) to the nearest of fixed centres; ties
    go to the lower index."""
    cands = []
    for k, cen in enumerate(centres):
        d = None
        for f, cval in zip(features, cen):
            term = (f - F.lit(float(cval))) * (f - F.lit(float(cval)))
            d = term if d is None else d + term
        cands.append(F.struct(d.alias("d"), F.lit(k).alias("k")))
    best = F.array_min(F.array(*cands))
    return best["k"], best["d"]


def within_set_sse(cells: DataFrame, feature_cols: Sequence[str], centres) -> DataFrame:
    """Cost of fixed centres: per cluster (cluster, n, sse) and the total is
    their sum (what ``computeCost`` reported)."""
    k, d = nearest_centre([F.col(c) for c in feature_cols], centres)
    data = cells.dropna(subset=list(feature_cols))
    return data.groupBy(k.alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("sse"))


def linear_regression(df: DataFrame, feature_cols: Sequence[str], label_col: str,
                      max_iter: int = 10, reg_param: float = 0.3, elastic_net: float = 0.8):
    """Spark ML linear regression with the original job's settings; returns
    (model, one-row report with every coefficient and the objective history,
    residuals of all rows)."""
    data = VectorAssembler(inputCols=list(feature_cols), outputCol="features").transform(
        df.dropna(subset=[*feature_cols, label_col])).select("features", F.col(label_col).alias("label"))
    model = LinearRegression(maxIter=max_iter, regParam=reg_param, elasticNetParam=elastic_net).fit(data)
    s = model.summary
    report = df.sparkSession.createDataFrame(
        [([float(v) for v in model.coefficients], float(model.intercept), int(s.totalIterations),
          float(s.rootMeanSquaredError), float(s.r2), [float(v) for v in s.objectiveHistory])],
        "coefficients array<double>, intercept double, iterations int, rmse double, r2 double, "
        "objective_history array<double>")
    residuals = model.transform(data).select("label", "prediction", (F.col("label") - F.col("prediction")).alias("residual"))
    return model, report, residuals


def regression_closed_form(df: DataFrame, y: str, x: str) -> DataFrame:
    """Ordinary least squares of y on x as SQL aggregates (slope, intercept, r2, n)."""
    return df.agg(F.regr_slope(F.col(y), F.col(x)).alias("slope"),
                  F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
                  F.regr_r2(F.col(y), F.col(x)).alias("r2"),
                  F.regr_count(F.col(y), F.col(x)).alias("n"))


def logistic_pipeline(df: DataFrame, feature_cols: Sequence[str], label_col: str,
                      split_col: str = "split", max_iter: int = 10, reg_param: float = 0.3,
                      elastic_net: float = 0.8):
    """StringIndexer -> VectorIndexer -> LogisticRegression -> IndexToString.

    Indexers are fitted on all data (as in the original); training uses rows
    whose ``split_col`` is 'train' and predictions are made for 'test'.
    Returns (pipeline model, test predictions, report row).
    """
    data = VectorAssembler(inputCols=list(feature_cols), outputCol="raw").transform(
        df.dropna(subset=[*feature_cols, label_col]))
    label_idx = StringIndexer(inputCol=label_col, outputCol="indexedLabel",
                              stringOrderType="frequencyDesc").fit(data)
    feat_idx = VectorIndexer(inputCol="raw", outputCol="indexedFeatures", maxCategories=4).fit(data)
    lr = LogisticRegression(labelCol="indexedLabel", featuresCol="indexedFeatures",
                            maxIter=max_iter, regParam=reg_param, elasticNetParam=elastic_net)
    conv = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=label_idx.labels)
    pipe = Pipeline(stages=[label_idx, feat_idx, lr, conv])
    # written once: the fit scans it once per iteration, and nothing stays cached
    train = materialize(data.filter(F.col(split_col) == "train").select("raw", label_col), "logistic-train")
    model = pipe.fit(train)
    pred = model.transform(data.filter(F.col(split_col) == "test"))
    lrm = model.stages[2]
    spark = df.sparkSession
    report = spark.createDataFrame(
        [(int(lrm.numClasses), int(lrm.numFeatures),
          [float(v) for v in lrm.coefficientMatrix.toArray().ravel()],
          [float(v) for v in lrm.interceptVector.toArray()])],
        "num_classes int, num_features int, coefficients array<double>, intercepts array<double>")
    return model, pred, report


def evaluate_multiclass(pred: DataFrame, label_col: str = "indexedLabel",
                        prediction_col: str = "prediction") -> DataFrame:
    """Accuracy and weighted F1 with the metric named explicitly (the
    original printed 1 - f1 under the name "Test Error")."""
    ev = MulticlassClassificationEvaluator(labelCol=label_col, predictionCol=prediction_col)
    acc = ev.setMetricName("accuracy").evaluate(pred)
    f1 = ev.setMetricName("f1").evaluate(pred)
    return pred.sparkSession.createDataFrame([(float(acc), float(f1), float(1 - acc))],
                                             "accuracy double, f1 double, test_error double")


def label_index(df: DataFrame, label_col: str) -> DataFrame:
    """Label encoding as StringIndexer does it: frequency descending, ties
    alphabetical; (label, label_index, n).  The distinct-label table is small
    (one row per class)."""
    from pyspark.sql import Window
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy(F.col("n").desc(), F.col("label"))
    return counts.select("label", (F.row_number().over(w) - 1).alias("label_index"), "n")


def confusion_metrics(df: DataFrame, label_col: str, prediction_col: str) -> DataFrame:
    """Accuracy and weighted F1 from one confusion table (a row per pair of
    classes): each pair counts for its true class and for its predicted one."""
    per = df.groupBy(F.col(label_col).alias("y"), F.col(prediction_col).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("y").eqNullSafe(F.col("p"))
    sides = per.select(F.explode(F.array(
        F.struct(F.col("y").alias("k"), F.col("n").alias("n_true"), F.lit(0).cast("long").alias("n_pred"),
                 F.when(same, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("n_true"), F.col("n").alias("n_pred"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")).select("s.*")
    cls = sides.groupBy("k").agg(*[F.sum(x).alias(x) for x in ("n_true", "n_pred", "tp")])
    prec = F.when(F.col("n_pred") > 0, F.col("tp") / F.col("n_pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("n_true") > 0, F.col("tp") / F.col("n_true")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return cls.agg((F.sum("tp") / F.sum("n_true")).alias("accuracy"),
                   (F.sum(F.col("n_true") * f1) / F.sum("n_true")).alias("f1"))


def with_spatial_fold(cells: DataFrame, block: int, folds: int, buffer: int = 0, c: str = "c", r: str = "r",
                      out: str = "fold", seed: int = 1) -> DataFrame:
    """Add the cross-validation fold of every cell: blocks of ``block`` x
    ``block`` cells (by Morton code) go to folds as a whole.  Cells within
    ``buffer`` cells of a block's border are left out, so that cells of two
    folds are more than 2 * ``buffer`` cells apart."""
    code = morton2(F.floor(F.col(c) / block), F.floor(F.col(r) / block))
    inside = [(F.pmod(F.col(x), F.lit(block)) >= buffer) & (F.pmod(F.col(x), F.lit(block)) < block - buffer) for x in (c, r)]
    return cells.filter(inside[0] & inside[1]).withColumn(
        out, F.pmod(F.xxhash64(code, F.lit(seed)), F.lit(folds)).cast("int"))


def cross_validated_tree(cells: DataFrame, features: Sequence[str], label: str, fold: str, folds: int,
                         depths: Sequence[int] = (2, 4), min_rows: Sequence[int] = (1, 20), seed: int = 1):
    """(model, report) of a decision tree chosen by blocked cross-validation:
    the report has a row per setting (max_depth, min_rows, accuracy, is_best)
    with the best tree's depth and nodes.  Rows with a NULL feature or label
    are left out."""
    tree = DecisionTreeClassifier(featuresCol="_features", labelCol="_label", seed=seed)
    grid = ParamGridBuilder().addGrid(tree.maxDepth, list(depths)).addGrid(tree.minInstancesPerNode, list(min_rows)).build()
    rows = cells.select(fold, F.col(label).cast("double").alias("_label"), *features).dropna()
    rows = VectorAssembler(inputCols=list(features), outputCol="_features").transform(rows).select(fold, "_label", "_features")
    search = CrossValidator(
        estimator=Pipeline(stages=[tree]), estimatorParamMaps=grid, numFolds=folds, foldCol=fold, seed=seed,
        evaluator=MulticlassClassificationEvaluator(labelCol="_label", metricName="accuracy"))
    fitted = search.fit(rows.cache())
    best = fitted.bestModel.stages[0]
    chosen = max(range(len(grid)), key=lambda k: fitted.avgMetrics[k])
    report = [(int(g[tree.maxDepth]), int(g[tree.minInstancesPerNode]), float(m), k == chosen, best.depth, best.numNodes)
              for k, (g, m) in enumerate(zip(grid, fitted.avgMetrics))]
    rows.unpersist()
    return fitted.bestModel, cells.sparkSession.createDataFrame(
        report, "max_depth int, min_rows int, accuracy double, is_best boolean, depth int, nodes int")

"""Delimited text scan into a feature table (label + feature vector)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_labelled_csv(spark: SparkSession, path: str, feature_names: Sequence[str],
                      label_name: str = "label", sep: str = ",", assemble: bool = True) -> DataFrame:
    """Headerless ``f1,f2,...,label`` text: doubles then a string label.

    The schema is given explicitly (no inference pass over the data).
    """
    schema = T.StructType([T.StructField(f, T.DoubleType()) for f in feature_names]
                          + [T.StructField(label_name, T.StringType())])
    df = spark.read.csv(path, schema=schema, sep=sep, header=False, mode="FAILFAST")
    if not assemble:
        return df
    return VectorAssembler(inputCols=list(feature_names), outputCol="features").transform(df) \
        .select("features", label_name)

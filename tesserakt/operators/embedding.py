"""Reduction and clustering of embedding columns by Spark's own estimators."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_vector(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull()).withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def principal(df: DataFrame, column: str, k: int, out: str = "reduced") -> DataFrame:
    """The rows that have an embedding, with its first k principal components. Signs of components are arbitrary."""
    rows = _with_vector(df, column)
    model = PCA(k=k, inputCol="_v", outputCol="_r").fit(rows)
    return model.transform(rows).withColumn(out, vector_to_array("_r")).drop("_v", "_r")


def clusters(df: DataFrame, column: str, k: int, method: str = "mixture", components: int | None = None, seed: int = 42, out: str = "cluster") -> DataFrame:
    """The rows that have an embedding, with their cluster: a Gaussian mixture over `components` principal components, or k-means."""
    rows = principal(df, column, components, "_p") if components else df.withColumn("_p", F.transform(column, lambda x: x.cast("double")))
    rows = _with_vector(rows, "_p")
    maker = {"mixture": GaussianMixture, "means": KMeans}[method]
    model = maker(k=k, seed=seed, featuresCol="_v", predictionCol=out).fit(rows)
    return model.transform(rows).drop("_v", "_p", "probability")

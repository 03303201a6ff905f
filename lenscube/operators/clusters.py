"""General topics by clustering, and a plane to draw vectors on. Both methods are our choice."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cluster(vectors: DataFrame, key: str, vector: str, k: int, seed: int = 7) -> DataFrame:
    """(key, topic) by k-means."""
    table = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    return KMeans(k=k, seed=seed).fit(table).transform(table).select(key, F.col("prediction").alias("topic"))


def project(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y) on the two principal axes."""
    table = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    done = PCA(k=2, inputCol="features", outputCol="xy").fit(table).transform(table)
    xy = vector_to_array("xy")
    return done.select(key, xy[0].alias("x"), xy[1].alias("y"))

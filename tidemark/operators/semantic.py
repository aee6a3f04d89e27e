"""Vectors: similarity, clusters, coherence, rising features."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a vector is null, empty of length, or of another size."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def coherence(vectors: DataFrame, cluster: str, vector: str) -> DataFrame:
    """(cluster, size, coherence): mean cosine of all pairs in a cluster, 1.0 for one member.

    For unit vectors the mean over pairs is (|sum|^2 - n) / (n (n - 1)), so no pairs are built; vectors without length
    are left out."""
    unit = vectors.select(F.col(cluster).alias("cluster_id"), F.col(vector).alias("_v")).withColumn("_norm", F.sqrt(dot(F.col("_v"), F.col("_v"))))
    unit = unit.filter("_norm > 0")
    parts = unit.select("cluster_id", "_norm", F.posexplode("_v").alias("_i", "_x"))
    sums = parts.groupBy("cluster_id", "_i").agg(F.sum(F.col("_x").cast("double") / F.col("_norm")).alias("_s"))
    square = sums.groupBy("cluster_id").agg(F.sum(F.col("_s") * F.col("_s")).alias("_sq"))
    n = F.col("size")
    return unit.groupBy("cluster_id").agg(F.count("*").alias("size")).join(square, "cluster_id").select(
        "cluster_id", "size", F.when(n > 1, (F.col("_sq") - n) / (n * (n - 1))).otherwise(1.0).alias("coherence")
    )


def hashed_embeddings(texts: DataFrame, tokens: str, dimensions: int = 1024) -> DataFrame:
    """Adds ``embedding``, the unit vector of hashed token counts; a stand-in where no model is given."""
    counted = HashingTF(numFeatures=dimensions, inputCol=tokens, outputCol="_counts").transform(texts)
    return Normalizer(inputCol="_counts", outputCol="embedding").transform(counted).drop("_counts")


def clusters(vectors: DataFrame, vector: str, k: int, seed: int = 42) -> DataFrame:
    """Adds ``cluster_id`` by k-means with at most ``k`` clusters; rows with a null vector are left out."""
    given = vectors.filter(F.col(vector).isNotNull())
    points = given.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    few = given.limit(k + 1).count()
    if few < 2:
        return given.withColumn("cluster_id", F.lit(0))
    model = KMeans(k=max(2, min(k, few)), seed=seed, featuresCol="_features", predictionCol="cluster_id").fit(points)
    return model.transform(points).drop("_features")


def first_occurrences(rows: DataFrame, text: str, position: str) -> DataFrame:
    """Distinct texts by the place where each came first."""
    return rows.groupBy(text).agg(F.min(position).alias(position))


def semantic_trends(trends: DataFrame, clustered: DataFrame) -> DataFrame:
    """``trends`` (feature, count, rate_of_change) with cluster_id, coherence_score and cluster_size of their feature.

    Only rising features belong to clusters; others get cluster -1, coherence 0.0 and size 1."""
    rising = trends.filter("rate_of_change > 0").select("feature").distinct()
    of = clustered.join(rising, "feature", "left_semi").select("feature", "cluster_id", "coherence_score", "cluster_size")
    return trends.join(of, "feature", "left").fillna(-1, ["cluster_id"]).fillna(0.0, ["coherence_score"]).fillna(1, ["cluster_size"])


def cluster_stats(trends: DataFrame) -> DataFrame:
    return trends.groupBy("cluster_id").agg(
        F.round(F.avg("rate_of_change"), 3).alias("mean_rate"), F.count("rate_of_change").alias("features"), F.sum("count").alias("total_count")
    )

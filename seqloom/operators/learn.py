"""Learning motif columns from features: clusters of columns, and a classifier that predicts the cluster."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_clusters(rows: DataFrame, values: str, ks=(2, 3, 4), seed: int = 7) -> DataFrame:
    """rows with ``cluster``: the number of clusters is the one with the best silhouette, the least of equal ones."""
    prepared = rows.withColumn("_v", array_to_vector(F.col(values).cast("array<double>")))
    fits = [(k, KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster").fit(prepared)) for k in ks]
    judge = ClusteringEvaluator(featuresCol="_v", predictionCol="cluster")
    best = max(fits, key=lambda f: (round(judge.evaluate(f[1].transform(prepared)), 9), -f[0]))[1]
    return best.transform(prepared).drop("_v")


def train(rows: DataFrame, features: str, label: str, trees: int = 20, seed: int = 7) -> RandomForestClassificationModel:
    """A forest; ``save`` keeps it."""
    prepared = rows.select(array_to_vector(F.col(features).cast("array<double>")).alias("_v"), F.col(label).cast("double").alias("_y"))
    return RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, seed=seed).fit(prepared)


def predict(model: RandomForestClassificationModel, rows: DataFrame, features: str) -> DataFrame:
    prepared = rows.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    return model.transform(prepared).withColumn("predicted", F.col("prediction").cast("int")).drop("_v", "rawPrediction", "probability", "prediction")


def save(model: RandomForestClassificationModel, path: str) -> None:
    """Writes a forest to a folder."""
    model.write().overwrite().save(path)


def load(path: str) -> RandomForestClassificationModel:
    return RandomForestClassificationModel.load(path)


def predicted_columns(known: DataFrame, asked: DataFrame, features: str = "features", values: str = "probs") -> DataFrame:
    """asked with ``cluster`` and ``predicted`` values: columns are clustered by their values, a forest learns the cluster from the
    features, and a predicted column is the mean of its cluster. The means are a row for each cluster."""
    rows = column_clusters(known, values)
    cells = rows.select("cluster", F.posexplode(F.col(values).cast("array<double>")).alias("i", "x")).groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    means = cells.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("predicted"))
    found = predict(train(rows, features, "cluster"), asked, features).withColumnRenamed("predicted", "cluster")
    return found.join(F.broadcast(means), "cluster")

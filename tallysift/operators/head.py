"""A linear head on embeddings, trained in Spark."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysift.operators.metrics import class_weights


def train_head(rows: DataFrame, features: str = "features", label: str = "label", epochs: int = 100, decay: float = 1e-4) -> LogisticRegressionModel:
    """A logistic head on an array column; classes weigh as ``class_weights`` says. It is fitted by L-BFGS, not by steps of a
    neural optimiser, so its weights are not those of such a training."""
    weights = class_weights(rows, label).select(F.col("label").alias("y"), "weight")
    data = rows.filter(F.col(label).isNotNull()).join(F.broadcast(weights), F.col(label) == F.col("y"))
    data = data.select(array_to_vector(F.col(features).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"), "weight")
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=epochs, regParam=decay, standardization=True).fit(data)


def head_scores(model: LogisticRegressionModel, rows: DataFrame, features: str = "features") -> DataFrame:
    """rows with ``score``, the probability of class 1."""
    out = model.transform(rows.withColumn("x", array_to_vector(F.col(features).cast("array<double>"))))
    return out.withColumn("score", F.get(vector_to_array("probability"), 1)).drop("x", "rawPrediction", "probability", "prediction")

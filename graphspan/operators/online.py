"""Training over labelled batches: a logistic model that goes on where it stopped."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class OnlineClassifier:
    """Logistic regression by gradient steps (Adagrad) over batches of long-form features.

    The 2^nbits weights lie on the driver; a step joins them to the features by broadcast,
    and what comes back are gradients by feature. So a step's traffic is bounded by the
    width, however many graphs the batch has."""

    def __init__(self, nbits: int, rate: float = 0.3, penalty: float = 1e-6, epochs: int = 3):
        if not 2 <= nbits <= 22:
            raise ValueError("nbits lies between 2 and 22")
        self.nbits, self.rate, self.penalty, self.epochs = nbits, rate, penalty, epochs
        self.weights, self.squares = np.zeros(1 << nbits), np.full(1 << nbits, 1e-8)
        self.classes_: list | None = None
        self.trained_count = 0

    def _table(self, spark) -> DataFrame:
        used = np.flatnonzero(self.weights)
        return spark.createDataFrame([(int(i), float(self.weights[i])) for i in used], "feature_id int, w double")

    def decision_function(self, x: DataFrame) -> DataFrame:
        """(graph_id, score) of (graph_id, feature_id, value). Values are damped by log1p, and
        each graph's have a length of 1."""
        return self._scaled(x).join(F.broadcast(self._table(x.sparkSession)), "feature_id", "left").groupBy("graph_id").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("score"))

    @staticmethod
    def _scaled(x: DataFrame) -> DataFrame:
        damped = x.select("graph_id", "feature_id", (F.signum("value") * F.log1p(F.abs("value"))).alias("v"))
        norm = damped.groupBy("graph_id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
        return damped.join(norm, "graph_id").select("graph_id", "feature_id", (F.col("v") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("v"))

    def partial_fit(self, x: DataFrame, y: DataFrame, classes: list | None = None) -> OnlineClassifier:
        """Steps over one batch: x in long form, y (graph_id, label). The first batch names the
        two classes, or has both."""
        if self.classes_ is None:
            found = sorted(classes) if classes is not None else sorted(r[0] for r in y.select("label").distinct().limit(3).collect())
            if len(found) != 2:
                raise ValueError("two classes are needed")
            self.classes_ = list(found)
        target = y.select("graph_id", (F.col("label") == F.lit(self.classes_[1])).cast("double").alias("t"))
        scaled = self._scaled(x).persist()
        try:
            n = target.count()
            for _ in range(self.epochs if n else 0):
                z = scaled.join(F.broadcast(self._table(x.sparkSession)), "feature_id", "left").groupBy("graph_id").agg(F.sum(F.col("v") * F.coalesce("w", F.lit(0.0))).alias("z"))
                error = z.join(target, "graph_id").select("graph_id", (1 / (1 + F.exp(-F.col("z"))) - F.col("t")).alias("e"))
                rows = scaled.join(error, "graph_id").groupBy("feature_id").agg(F.sum(F.col("v") * F.col("e")).alias("g")).collect()
                at, g = np.array([r[0] for r in rows], int), np.array([r[1] for r in rows]) / n
                g = g + self.penalty * self.weights[at]
                self.squares[at] += g * g
                self.weights[at] -= self.rate * g / np.sqrt(self.squares[at])
            self.trained_count += n
        finally:
            scaled.unpersist()
        return self

    def predict(self, x: DataFrame) -> DataFrame:
        if self.classes_ is None:
            raise ValueError("fit before use")
        return self.decision_function(x).select("graph_id", F.when(F.col("score") > 0, F.lit(self.classes_[1])).otherwise(F.lit(self.classes_[0])).alias("label"))

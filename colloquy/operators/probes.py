"""Linear probes with out-of-fold predictions, by pyspark.ml."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.operators.scores import auc


def _vectors(rows: DataFrame, vector: str) -> DataFrame:
    return rows.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def fit_predict(train: DataFrame, test: DataFrame, vector: str, label: str, l2: float | None, scale: bool = True) -> DataFrame:
    """Adds ``probability`` of class 1 and ``predicted``. ``l2`` None is a strength of 1 over the number of rows."""
    train, test = _vectors(train, vector), _vectors(test, vector)
    if scale:
        scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(train)
        train, test = scaler.transform(train), scaler.transform(test)
    strength = 1 / max(train.count(), 1) if l2 is None else l2
    model = LogisticRegression(featuresCol="_s" if scale else "_v", labelCol=label, regParam=strength, standardization=False, maxIter=200, probabilityCol="_p", predictionCol="predicted", rawPredictionCol="_raw").fit(train)
    return model.transform(test).withColumn("probability", vector_to_array("_p")[1]).drop("_v", "_s", "_p", "_raw")


def softmax_predict(train: DataFrame, test: DataFrame, vector: str, label: str, l2: float = 1e-3) -> DataFrame:
    """Adds ``probabilities`` (one a class) and ``predicted`` for classes 0, 1, ...: mean log loss plus half of ``l2`` times
    the squared weights, without the intercepts."""
    train, test = _vectors(train, vector), _vectors(test, vector)
    model = LogisticRegression(featuresCol="_v", labelCol=label, regParam=l2, standardization=False, maxIter=200, family="multinomial", probabilityCol="_p", predictionCol="predicted", rawPredictionCol="_raw").fit(train)
    return model.transform(test).withColumn("probabilities", vector_to_array("_p")).drop("_v", "_p", "_raw")


def out_of_fold(rows: DataFrame, vector: str, label: str, fold: str = "fold", n: int = 5, l2: float | None = 1e-3, scale: bool = False) -> DataFrame:
    """Predictions for each row by the model that did not see its fold."""
    held = rows.persist()
    parts = [fit_predict(held.where(F.col(fold) != i), held.where(F.col(fold) == i), vector, label, l2, scale) for i in range(n)]
    return reduce(DataFrame.unionByName, parts)


def fold_scores(predicted: DataFrame, label: str, fold: str = "fold") -> DataFrame:
    """Per fold: accuracy and AUC."""
    right = predicted.groupBy(fold).agg(F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
    return right.join(auc(predicted, [fold], "probability", F.col(label) == 1), fold)


def run_scores(predicted: DataFrame, run: str, label: str) -> DataFrame:
    """Row probabilities averaged per run."""
    return predicted.groupBy(run).agg(F.avg("probability").alias("probability"), F.max(label).alias(label))


def transfer(rows: DataFrame, vector: str, label: str, domain: str, source: object, target: object, l2: float = 1e-3) -> DataFrame:
    """Trains on one domain's rows and predicts another's."""
    return fit_predict(rows.where(F.col(domain) == source), rows.where(F.col(domain) == target), vector, label, l2, scale=False)

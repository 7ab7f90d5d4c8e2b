"""Learned scores by the engine's own distributed trainers."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _scored(df: DataFrame, features: list[str], label: str, model, learn: DataFrame | None = None) -> DataFrame:
    stages = [VectorAssembler(inputCols=features, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    fitted = Pipeline(stages=stages).fit(df if learn is None else learn)
    return fitted.transform(df).withColumn("probability", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "prediction")


def logistic(df: DataFrame, features: list[str], label: str, l2: float = 0.01, weight: str | None = None, learn: DataFrame | None = None) -> DataFrame:
    """``df`` with the probability of label 1 by logistic regression with an L2 penalty, learnt from ``learn`` if given."""
    m = LogisticRegression(labelCol=label, regParam=l2, maxIter=50)
    return _scored(df, features, label, m.setWeightCol(weight) if weight else m, learn)


def boosted(df: DataFrame, features: list[str], label: str, rounds: int = 10, seed: int = 5) -> DataFrame:
    """``df`` with the probability of label 1 by boosted trees."""
    return _scored(df, features, label, GBTClassifier(labelCol=label, maxIter=rounds, maxDepth=3, seed=seed))


def split(df: DataFrame, key: str, label: str, share: float = 0.8, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(learn, test): the share of each label's rows, by rank in hash order; the same rows every time.

    A label's rows are ranked in 64 parts, so the share holds to one row a part.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))
    w = Window.partitionBy(label, F.substring(h, 1, 1), F.ascii(F.substring(h, 2, 1)) % 4)
    n = F.count("*").over(w)
    d = df.withColumn("__learn", F.row_number().over(w.orderBy(h, key)) <= F.ceil(n * share))
    return d.where("__learn").drop("__learn"), d.where("NOT __learn").drop("__learn")


def clusters(df: DataFrame, vector: str, k: int, seed: int = 5, learn: DataFrame | None = None) -> DataFrame:
    """``df`` without the vector, with its cluster; centres are learnt from ``learn`` if given."""
    ready = lambda x: x.withColumn("features", array_to_vector(F.col(vector).cast("array<double>")))
    d = ready(df)
    return KMeans(k=k, seed=seed, maxIter=10).fit(d if learn is None else ready(learn)).transform(d).drop("features", vector).withColumnRenamed("prediction", "cluster")

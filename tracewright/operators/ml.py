"""The linear baseline: logistic regression with an L2 penalty, no constant,
balanced weights, by Spark's own optimiser."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Adds a weight: rows over twice the rows of the label. One small aggregate,
    joined as a single row."""
    n = df.agg(F.count("*").alias("_n"), F.greatest(F.count(F.when(F.col(y) == 1, 1)), F.lit(1)).alias("_p"), F.greatest(F.count(F.when(F.col(y) == 0, 1)), F.lit(1)).alias("_q"))
    return df.crossJoin(F.broadcast(n)).withColumn("weight", F.col("_n") / (2 * F.when(F.col(y) == 1, F.col("_p")).otherwise(F.col("_q")))).drop("_n", "_p", "_q")


def fit_logistic(df: DataFrame, features: str, y: str, c: float = 1.0, steps: int = 200) -> LogisticRegressionModel:
    """features: an array column. The loss is the mean weighted log loss plus
    the squared length of the coefficients over 2 c n."""
    rows = balanced(df.select(F.col(y).cast("double").alias("label"), array_to_vector(F.col(features).cast("array<double>")).alias("features")), "label")
    n = rows.count()
    return LogisticRegression(maxIter=steps, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, fitIntercept=False, standardization=False, weightCol="weight", tol=1e-10).fit(rows)


def probabilities(model: LogisticRegressionModel, df: DataFrame, features: str, name: str = "prob") -> DataFrame:
    given = df.withColumn("features_", array_to_vector(F.col(features).cast("array<double>")))
    model.setFeaturesCol("features_")
    out = model.transform(given)
    return out.withColumn(name, F.get(vector_to_array("probability"), F.lit(1))).drop("features_", "probability", "rawPrediction", "prediction")

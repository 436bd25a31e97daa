"""Walk-forward evaluation and model gates on pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def terminal_rows(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def walk_forward(df: DataFrame, year: str, features: Sequence[str], target: str, years: Sequence[int], least: int = 100, ridge: float = 1e-3) -> DataFrame:
    """(year, n_train, n_test, rmse, r2) per fold: trained on all earlier years, tested on the year; folds with fewer than `least` training rows are left out."""
    spark, out = df.sparkSession, []
    model = Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip"), LinearRegression(featuresCol="x", labelCol=target, regParam=ridge, solver="normal")])
    counts = {r[0]: r[1] for r in df.groupBy(year).count().collect()}  # a row per year
    for y in years:
        n = sum(c for k, c in counts.items() if k < y)
        if n < least or not counts.get(y):
            continue
        fitted = model.fit(df.where(F.col(year) < y)).transform(df.where(F.col(year) == y))
        e = fitted.agg(F.count("*").alias("m"), F.sqrt(F.avg(F.pow(F.col(target) - F.col("prediction"), 2))).alias("rmse"), (1 - F.try_divide(F.sum(F.pow(F.col(target) - F.col("prediction"), 2)), F.var_pop(target) * F.count("*"))).alias("r2")).first()
        out.append((y, n, e["m"], e["rmse"], e["r2"]))
    return spark.createDataFrame(out, "year int, n_train long, n_test long, rmse double, r2 double")


def lasso_features(df: DataFrame, features: Sequence[str], target: str, penalty: float = 0.01) -> DataFrame:
    """(feature, coefficient) of an L1 fit on standardised columns."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), LinearRegression(featuresCol="x", labelCol=target, elasticNetParam=1.0, regParam=penalty)]
    weights = Pipeline(stages=stages).fit(df).stages[-1].coefficients
    return df.sparkSession.createDataFrame([(f, float(w)) for f, w in zip(features, weights, strict=True)], "feature string, coefficient double")


def explained_variance(df: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    stages = [VectorAssembler(inputCols=list(features), outputCol="raw", handleInvalid="skip"), StandardScaler(inputCol="raw", outputCol="x", withMean=True), PCA(k=k, inputCol="x", outputCol="p")]
    share = Pipeline(stages=stages).fit(df).stages[-1].explainedVariance
    return df.sparkSession.createDataFrame([(i + 1, float(v)) for i, v in enumerate(share)], "component int, share double")


def aligned(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exactly the expected columns as doubles; missing ones and nulls are 0."""
    return df.select(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in expected))


def predictions(df: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    total = F.lit(intercept)
    for c, w in weights.items():
        total = total + F.col(c) * w
    return df.withColumn("prediction", total)


def as_array(column: str):
    return vector_to_array(F.col(column))

"""The point-in-time feature store: long values with half-open validity."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import point_in_time

COLUMNS = ["entity", "prediction_year", "feature_name", "feature_value", "valid_from", "valid_until"]


def _shape(df: DataFrame) -> DataFrame:
    return df.where(F.col("feature_value").isNotNull()).select(*COLUMNS)


def lag_features(facts: DataFrame, entity: str, year: str, columns: Sequence[str], lags: Sequence[int]) -> DataFrame:
    """Each column k years back as `column_lag_k`, valid from 15 February after the source season for a year. One explode and one semi-join, not a statement per column and lag; gaps in the years give no row."""
    each = F.explode(F.array(*map(F.lit, lags))).alias("k")
    long = facts.select(F.col(entity).alias("entity"), F.col(year).alias("source_year"), each, *columns)
    long = long.withColumn("prediction_year", F.col("source_year") + F.col("k"))
    have = facts.select(F.col(entity).alias("entity"), F.col(year).alias("prediction_year"))
    long = long.join(have, ["entity", "prediction_year"], "left_semi").unpivot(["entity", "prediction_year", "source_year", "k"], list(columns), "column", "feature_value")
    day = lambda y: F.make_date(y, F.lit(2), F.lit(15))
    named = long.withColumn("feature_name", F.concat(F.col("column"), F.lit("_lag_"), F.col("k").cast("string")))
    return _shape(named.withColumn("valid_from", day(F.col("source_year") + 1)).withColumn("valid_until", day(F.col("source_year") + 2)))


def interaction_features(facts: DataFrame, entity: str, year: str, **products: Column) -> DataFrame:
    """Products of columns, valid from 15 March of their year for a year."""
    base = facts.select(F.col(entity).alias("entity"), F.col(year).alias("prediction_year"), *(c.cast("double").alias(n) for n, c in products.items()))
    long = base.unpivot(["entity", "prediction_year"], list(products), "feature_name", "feature_value")
    day = lambda y: F.make_date(y, F.lit(3), F.lit(15))
    return _shape(long.withColumn("valid_from", day(F.col("prediction_year"))).withColumn("valid_until", day(F.col("prediction_year") + 1)))


def matrix(spine: DataFrame, values: DataFrame, names: Sequence[str], as_of: Column | str) -> DataFrame:
    """Wide features of the spine (entity, prediction_year) as known at `as_of` (a value, or a column of the spine). Rows of the spine without a feature stay, with nulls."""
    found = point_in_time(spine, values, ["entity", "prediction_year"], as_of)
    pick = [F.min_by(F.col("feature_value"), F.when(F.col("feature_name") == n, F.col("valid_from"))).alias(n) for n in names]
    return found.groupBy(*spine.columns).agg(*pick)


def leaks(values: DataFrame) -> DataFrame:
    """Lag features that were valid only from 1 September of their prediction year on or later."""
    return values.where(F.col("feature_name").contains("_lag_") & (F.col("valid_from") >= F.make_date("prediction_year", F.lit(9), F.lit(1))))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

"""Window shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """One row per key, the first by `order`."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__r", r).where("__r = 1").drop("__r")


def running(value: str, keys: Sequence[str], *order: str) -> Column:
    """Running total; rows that tie in the order share it."""
    return F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(Window.partitionBy(*keys).orderBy(*order))


def trailing_without_current(value: str, n: int, keys: Sequence[str], *order: str) -> Column:
    """Sum of the n rows before the current one, 0 where there are none."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-n, -1)), F.lit(0.0))


def gap(number: Column, keys: Sequence[str], *order: str) -> Column:
    """Missing steps since the row before, at least 0."""
    return F.coalesce(F.greatest(F.lit(0), number - F.lag(number).over(Window.partitionBy(*keys).orderBy(*order)) - 1), F.lit(0))


def slope3(value: str, keys: Sequence[str], *order: str) -> Column:
    """Least-squares slope over the last three rows, null until there are three: (x2 - x0) / 2."""
    return (F.col(value) - F.lag(value, 2).over(Window.partitionBy(*keys).orderBy(*order))) / 2


def fill_forward(value: Column, keys: Sequence[str], *order: str) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def batch_number(n: int, keys: Sequence[str], *order: str) -> Column:
    """Chunks of n rows in order, from 0."""
    return F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / n).cast("int")

"""Aggregates that are not single built-ins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import mean_rank_share, running_totals, with_ranks


def quartile_by_index(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, median: str) -> DataFrame:
    """The sorted group's element number int(n * q), without interpolation, beside the interpolated median. The element is found by its rank, so no group is gathered in one row."""
    ranked = df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    counts = df.groupBy(*keys).agg(F.floor(F.count(value) * q).cast("int").alias("__i"), F.round(F.median(value), 4).alias(median))
    return ranked.join(counts, list(keys)).where(F.col("__r") == F.col("__i") + 1).select(*keys, F.col(value).alias(name), median)


def pivot_first(df: DataFrame, keys: Sequence[str], name: str, names: Sequence[str], value: str, order: str) -> DataFrame:
    """Long to wide: the first non-null value of each name by `order`."""
    pick = lambda n: F.min_by(F.col(value), F.when((F.col(name) == n) & F.col(value).isNotNull(), F.col(order)))
    return df.groupBy(*keys).agg(*(pick(n).alias(n) for n in names))


def histogram(df: DataFrame, value: str, member: str, buckets: int) -> DataFrame:
    """(bucket, n, first_member): fixed-width buckets of ceil(max / buckets), the last one takes what lies beyond; empty buckets have rows too. The members themselves are rows of `bucketed`, as one bucket may hold most of the table."""
    counts = bucketed(df, value, member, buckets).groupBy("bucket").agg(F.count("*").alias("n"), F.min(member).alias("first_member"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), "first_member")


def bucketed(df: DataFrame, value: str, member: str, buckets: int) -> DataFrame:
    """(bucket, member) of each row."""
    width = df.agg(F.ceil(F.max(value) / buckets).cast("double").alias("w"))  # one row
    return df.crossJoin(F.broadcast(width)).select(F.least(F.floor(F.col(value) / F.col("w")), F.lit(buckets - 1)).cast("int").alias("bucket"), member)


def skew_kurt(value: str) -> tuple[Column, Column]:
    """Bias-corrected skewness (n > 2) and excess kurtosis (n > 3) from the population forms."""
    n = F.count(value).cast("double")
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))
    return skew, kurt


def r2_by(df: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    n, res, tot = F.count("*"), F.sum(F.pow(F.col(y) - F.col(p), 2)), F.var_pop(y) * F.count("*")
    return df.groupBy(*keys).agg(F.when(n < 2, F.lit(None)).when(tot == 0, F.lit(0.0)).otherwise(F.round(1 - res / tot, 4)).alias("r2"))


def null_rates(df: DataFrame) -> DataFrame:
    """(column_name, null_rate) of every column in one pass."""
    total = F.greatest(F.count("*"), F.lit(1)).cast("double")
    one = df.agg(*(F.round(F.count_if(F.col(c).isNull()) / total, 4).alias(c) for c in df.columns))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_rate")) for c in df.columns))).alias("x")).select("x.*")


def cumulative_share(totals: DataFrame, value: str, tiebreak: Sequence[str]) -> DataFrame:
    """Running share of a table from the largest value on."""
    sums = running_totals(totals, [], [F.desc(value), *tiebreak], {"__v": F.col(value)})
    return sums.select(*totals.columns, ((F.col("__v_before") + F.col(value)) / F.col("__v_total")).alias("share"))


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    t, g = F.col(truth), F.col(guess)
    c = df.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(~t & ~g).alias("tn"), F.count_if(t & ~g).alias("fn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select("*", div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"), div(tp + tn, tp + tn + fp + fn).alias("accuracy"))


def rank_pct(df: DataFrame, value: str) -> DataFrame:
    """Average rank of ties over the number of rows, from counts per value."""
    return with_ranks(df, [], value, pct=mean_rank_share())


def top_factors(factors: Column, k: int) -> Column:
    """The k entries of largest absolute value of a map as `name: v.vv`, ties by name."""
    entries = F.array_sort(F.map_entries(factors), lambda a, b: F.when(F.abs(a.value) > F.abs(b.value), -1).when(F.abs(a.value) < F.abs(b.value), 1).when(a.key < b.key, -1).otherwise(1))
    return F.transform(F.slice(entries, 1, k), lambda e: F.concat(e.key, F.lit(": "), F.format_number(e.value, 2)))

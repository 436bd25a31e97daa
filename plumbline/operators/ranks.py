"""Ranks, running totals and exact quantiles of whole tables, without a window over a table and without a group in one buffer.

Rows are first counted by value, so that a value that fills a third of the table is one row. The counts are dealt by ranges of
(keys, value) and written once; each range adds up its own rows, and the sums of the ranges before it (a few numbers a range) are
added to that. A quantile is then the interpolation between the values at two neighbouring ranks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import scratch


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], measures: dict[str, Column]) -> DataFrame:
    """df with, for each measure m, `m_before` (its sum over the rows of the same keys that come before in `order`) and `m_total`.

    `order` must tell all rows of the same keys apart. Nulls of a measure add nothing.
    """
    names = list(measures)
    own = df.withColumns({f"__{m}": F.coalesce(c, F.lit(0)) for m, c in measures.items()})
    ranges = own.repartitionByRange(*keys, *order) if keys or order else own
    path = scratch(df.sparkSession)
    ranges.withColumn("__range", F.spark_partition_id()).write.parquet(path)  # ranges are drawn anew by each job: they must be kept
    kept = df.sparkSession.read.schema(own.withColumn("__range", F.lit(0)).schema).parquet(path)
    sums = kept.groupBy("__range", *keys).agg(*(F.sum(f"__{m}").alias(f"__{m}_sum") for m in names))
    # a row for each range and key in it: a key spans ranges next to one another
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select("__range", *keys, *(F.coalesce(F.sum(f"__{m}_sum").over(before), F.lit(0)).alias(f"__{m}_base") for m in names), *(F.sum(f"__{m}_sum").over(whole).alias(f"{m}_total") for m in names))
    sums = sums.select(F.col("__range").alias("__r"), *(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in sums.columns if c != "__range" and c not in keys))
    same = F.col("__range") == F.col("__r")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    inside = Window.partitionBy("__range", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    within = kept.withColumns({f"__{m}_in": F.coalesce(F.sum(f"__{m}").over(inside), F.lit(0)) for m in names})
    out = within.join(sums, same)
    return out.select(*df.columns, *(x for m in names for x in ((F.col(f"__{m}_base") + F.col(f"__{m}_in")).alias(f"{m}_before"), F.col(f"{m}_total"))))


def counted(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, n_before, n_total) of each different non-null value of each key: rows with it, with smaller ones, with any."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return running_totals(counts, keys, [value], {"n": F.col("n")})


def quantiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, one column per share): exact quantiles with linear interpolation. Keys without a value have no row; without keys there is one row, null for an empty table."""
    return from_counts(counted(df, keys, value), keys, value, shares)


def from_counts(counts: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    picks, out = [], []
    for name, q in shares.items():
        at = F.lit(q) * (F.col("n_total") - 1)
        for side, k in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n")), F.col(value).cast("double"))).alias(f"__{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"__{name}_part"))
        lo, hi, part = (F.col(f"__{name}_{x}") for x in ("lo", "hi", "part"))
        out.append(((1 - part) * lo + part * hi).alias(name))
    return counts.groupBy(*keys).agg(*picks).select(*keys, *out)


def with_ranks(df: DataFrame, keys: Sequence[str], value: str, **ranks: Column) -> DataFrame:
    """df with columns made of n, n_before and n_total of each row's value; rows with a null value get nulls."""
    marks = counted(df, keys, value).select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(value).alias("__value"), *(c.alias(name) for name, c in ranks.items()))
    same = F.col(value) == F.col("__value")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return df.join(marks, same, "left").select(*df.columns, *ranks)


def percent_rank() -> Column:
    """(first place of ties - 1) / (rows - 1); 0 for a single row."""
    return F.when(F.col("n_total") > 1, F.col("n_before") / (F.col("n_total") - 1)).otherwise(F.lit(0.0))


def mean_rank_share() -> Column:
    """Mean place of ties over the number of rows."""
    return (F.col("n_before") + (F.col("n") + 1) / 2.0) / F.col("n_total")


def two_samples(df: DataFrame, keys: Sequence[str], value: str, first: Column) -> DataFrame:
    """(keys, statistic, p_value, n1, n2): the two-sided Kolmogorov-Smirnov test of the rows where `first` holds against the others.

    The statistic is the greatest distance of both distributions over all different values; the p-value is the limit distribution's
    at statistic * sqrt(n1 * n2 / (n1 + n2)). Nulls take no part; with an empty side statistic and p-value are null.
    """
    counts = df.where(F.col(value).isNotNull() & first.isNotNull()).groupBy(*keys, value).agg(F.count_if(first).alias("a"), F.count_if(~first).alias("b"))
    sums = running_totals(counts, keys, [value], {"a": F.col("a"), "b": F.col("b")})
    apart = F.abs(F.try_divide(F.col("a_before") + F.col("a"), F.col("a_total")) - F.try_divide(F.col("b_before") + F.col("b"), F.col("b_total")))
    one = sums.groupBy(*keys).agg(F.max(apart).alias("statistic"), F.max("a_total").alias("n1"), F.max("b_total").alias("n2"))
    z2 = F.pow("statistic", F.lit(2)) * F.try_divide(F.col("n1") * F.col("n2"), F.col("n1") + F.col("n2"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda total, k: total + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z2))
    # the series converges slowly near 0, where the p-value is 1
    return one.select(*keys, "statistic", F.when(z2 < 0.04, 1.0).when(z2.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), series))).alias("p_value"), "n1", "n2")

"""Data-quality checks. Each gives rows (check_name, status, detail); a suite is their union."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractViolation(ValueError):
    """Columns that break their contract."""


def result(name: str, ok: Column, detail: Column) -> list[Column]:
    return [F.lit(name).alias("check_name"), F.when(ok, "pass").otherwise("fail").alias("status"), detail.cast("string").alias("detail")]


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per contract column with its number of nulls, from one pass."""
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    rows = one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).alias("n")) for c in columns))).alias("x")).select("x.*")
    return rows.select(F.concat(F.lit("not_null:"), "c").alias("check_name"), F.when(F.col("n") == 0, "pass").otherwise("fail").alias("status"), F.col("n").cast("string").alias("detail"))


def enforce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df itself, or an error that names every violated column."""
    bad = [f"{r['check_name'][9:]} ({r['detail']})" for r in not_null(df, columns).where("status = 'fail'").collect()]
    if bad:
        raise ContractViolation("null values in " + ", ".join(sorted(bad)))
    return df


@dataclass(frozen=True)
class Check:
    """A check that one aggregate of the table decides."""

    name: str
    measure: Column
    ok: Callable[[Column], Column]


def passes(df: DataFrame, *checks: Check) -> DataFrame:
    """The rows of several checks from one pass over the table."""
    one = df.agg(*(c.measure.alias(f"c{i}") for i, c in enumerate(checks)))
    rows = [F.struct(*result(c.name, c.ok(F.col(f"c{i}")), F.col(f"c{i}"))) for i, c in enumerate(checks)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def at_least(least: int) -> Check:
    return Check("row_count", F.count("*"), lambda n: n >= least)


def range_of(column: str, low: float, high: float) -> Check:
    return Check(f"range:{column}", F.count_if(~F.col(column).between(low, high)), lambda n: n == 0)


def domain_of(column: str, values: Sequence) -> Check:
    """Values outside the list; nulls are left to the null check."""
    return Check(f"domain:{column}", F.count_if(~F.col(column).isin(*values)), lambda n: n == 0)


def null_share(column: str, most: float) -> Check:
    return Check(f"null_rate:{column}", F.round(F.avg(F.col(column).isNull().cast("int")), 4), lambda r: r <= most)


def covers(column: str, expected: Sequence) -> Check:
    """The expected values that do not occur; only expected ones are gathered."""
    have = F.collect_set(F.when(F.col(column).isin(*expected), F.col(column)))
    missing = F.array_sort(F.transform(F.array_except(F.array(*map(F.lit, expected)), have), lambda x: x.cast("string")))
    return Check(f"coverage:{column}", F.array_join(missing, ","), lambda m: m == "")


def row_count(df: DataFrame, least: int) -> DataFrame:
    return passes(df, at_least(least))


def unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n"))
    return n.select(*result("unique:" + ",".join(keys), F.col("n") == 0, F.col("n")))


def coverage(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    return passes(df, covers(column, expected))


def in_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return passes(df, range_of(column, low, high))


def allowed(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return passes(df, domain_of(column, values))


def null_rate(df: DataFrame, column: str, most: float) -> DataFrame:
    return passes(df, null_share(column, most))


def has_columns(df: DataFrame, **kinds: str) -> DataFrame:
    have = dict(df.dtypes)
    rows = [(f"column:{c}", "pass" if have.get(c) == k else "fail", have.get(c, "missing")) for c, k in kinds.items()]
    return df.sparkSession.createDataFrame(rows, "check_name string, status string, detail string")


def suite(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def reconcile(totals: DataFrame, details: DataFrame, keys: Sequence[str], total: str, detail: str, tolerance: float) -> DataFrame:
    """Stated totals against sums of details; a team without details counts as 0."""
    sums = details.groupBy(*keys).agg(F.sum(detail).alias("__s"))
    j = totals.join(sums, list(keys), "left").withColumn("found", F.coalesce("__s", F.lit(0.0)))
    return j.select(*keys, F.round(total, 2).alias("stated"), F.round("found", 2).alias("found"), (F.abs(F.col(total) - F.col("found")) <= tolerance * F.abs(F.col(total))).alias("ok"))

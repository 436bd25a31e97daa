"""Money, safe arithmetic and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money_millions(c: Column) -> Column:
    """`$1,234,567` to 1.234567; suffix M as is, B times 1000, K by 1000, none by a million; anything else 0."""
    t = F.upper(F.regexp_replace(c, r"[$,\s]", ""))
    v = F.expr("1").cast("double") * F.regexp_replace(t, r"[MBK]$", "").try_cast("double")
    return F.coalesce(F.when(F.endswith(t, F.lit("M")), v).when(F.endswith(t, F.lit("B")), v * 1000).when(F.endswith(t, F.lit("K")), v / 1000).otherwise(v / 1_000_000), F.lit(0.0))


def money_plain(c: Column) -> Column:
    """`$` and commas stripped; blank or dash 0; brackets negative."""
    t = F.regexp_replace(F.trim(c), r"[$,]", "")
    v = F.regexp_replace(t, r"[()]", "").try_cast("double")
    return F.coalesce(F.when(t.rlike(r"^\(.*\)$"), -v).otherwise(v), F.lit(0.0))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def sigmoid(x: Column, k: float = 1.0) -> Column:
    return 1 / (1 + F.exp(-k * x))


def row_std(*cols: Column) -> Column:
    """Sample deviation across the non-null columns of a row, null for fewer than two."""
    v = F.filter(F.array(*cols), lambda x: x.isNotNull())
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n >= 2, F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (n - 1)))


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(p - outcome.cast("double"), F.lit(2))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        c = F.greatest(c, F.lit(low))
    return c if high is None else F.least(c, F.lit(high))

"""Sequence similarity: matching blocks found longest first (Ratcliff-Obershelp), as a vectorised UDF. It is asymmetric and not an edit distance."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def similarity(a: str | None, b: str | None) -> float | None:
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[tuple, float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = similarity(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    """0 to 1."""
    return F.pandas_udf(_ratio, T.DoubleType())(a, b)


def percent(a: Column, b: Column) -> Column:
    """0 to 100, rounded to a whole number."""
    return F.round(ratio(a, b) * 100).cast("int")

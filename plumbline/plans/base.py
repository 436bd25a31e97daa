"""Registration of queries and of their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one input directory, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """SQL in which {name} stands for a frame given here or for a table."""
        used = {n: frames.get(n) if n in frames else getattr(self, n) for n in set(re.findall(r"\{(\w+)\}", text))}
        return self.spark.sql(text, **used)


def query(oracle: str | None = None, name: str | None = None):
    """Register a function of Tables under its own name."""

    def add(f: Callable[[Tables], DataFrame]):
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """Register one SQL text for both engines; `spark_text` where the engines' spelling differs."""
    query(re.sub(r"\{(\w+)\}", r"\1", text), name)(lambda t: t.sql(spark_text or text))

"""A work queue over a stream: items are worked on until they yield something, and never again after that."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbered import Numbered

ERROR = "error"


class WorkQueue:
    """Processed-marker queue below one folder.

    Each batch takes its items and those still open, leaves out what is marked, and applies `work`, a function of a DataFrame of
    items that returns rows of (key, error, results ...). Items with rows are marked, failed ones (error not null) too, as trying
    them again would fail again; items without any row stay open and are offered again with the next batch. All tables are written
    under the batch's number, in an order that lets a repeated batch start over: it sees only what earlier batches wrote.

    Defined cases: rows with a null key are left out; items that share a key are one item; a batch without items writes empty tables.
    """

    def __init__(self, spark: SparkSession, root: str, key: str, item: T.StructType, result: str, work: Callable[[DataFrame], DataFrame]):
        self.key, self.work, self.item = key, work, item
        kind = item[key].dataType.simpleString()
        table = lambda name, schema: Numbered(spark, f"{root}/{name}", schema)
        self.pending = table("pending", item)
        self.outcomes = table("outcomes", f"{key} {kind}, {ERROR} string, {result}")
        self.markers = table("markers", f"{key} {kind}, failed boolean")
        self.open = table("open", item)
        self.log = table("log", "number long, items long, marked long, failed long, left_open long")

    def step(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        items = batch.select(*self.item.names).unionByName(self.open.of(number - 1)).where(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        # the marker table is reduced to the batch's keys first: it grows, they do not
        known = self.markers.before(number).select(self.key).join(items.select(self.key), self.key, "left_semi")
        self.pending.write(items.join(known, self.key, "left_anti"), number)
        pending = self.pending.of(number)
        self.outcomes.write(self.work(pending), number)
        marks = self.outcomes.of(number).groupBy(self.key).agg(F.bool_and(F.col(ERROR).isNotNull()).alias("failed"))
        self.markers.write(marks, number)
        marks = self.markers.of(number)
        self.open.write(pending.join(marks, self.key, "left_anti"), number)
        m = marks.agg(F.count("*").alias("marked"), F.count_if("failed").alias("failed"))
        n, o = pending.agg(F.count("*").alias("items")), self.open.of(number).agg(F.count("*").alias("left_open"))
        self.log.write(spark.range(1).select(F.lit(number).cast("long").alias("number")).crossJoin(n).crossJoin(m).crossJoin(o), number)  # one row each

    def last(self) -> int:
        """The number of the last whole batch; -1 before the first."""
        return self.log.all().agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0]

    def results(self) -> DataFrame:
        return self.outcomes.all().where(F.col(ERROR).isNull()).drop("batch", ERROR)

    def marked(self) -> DataFrame:
        return self.markers.all().drop("batch")

    def waiting(self) -> DataFrame:
        return self.open.of(self.last())

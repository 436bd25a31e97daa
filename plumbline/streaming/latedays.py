"""Daily totals of a feed in which rows come late, twice, or long after their day was closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbered import Numbered


class DailyTotals:
    """Totals per day and kind below one folder.

    Event time closes a day once `delay` has passed since its end, by the latest time of earlier batches. Rows of open days are summed
    into `days`; rows of closed ones are not dropped but summed into `corrections`, and `totals` merges both, so that every closed day
    is mended as its rows come in. Ids that an earlier batch brought are left out. All tables are written under the batch's number.

    Defined cases: rows with a null id or time take no part; ids that repeat within a batch count once; a null value adds nothing.
    """

    def __init__(self, spark: SparkSession, root: str, row_id: str, id_kind: str, ts: str, kind: str, value: str, delay: str = "1 day"):
        self.row_id, self.ts, self.kind, self.value, self.delay = row_id, ts, kind, value, delay
        sums = "day date, kind string, n long, total double"
        self.days, self.corrections = Numbered(spark, f"{root}/days", sums), Numbered(spark, f"{root}/corrections", sums)
        self.seen = Numbered(spark, f"{root}/seen", T.StructType.fromDDL(f"row_id {id_kind}, day date"))
        self.clock = Numbered(spark, f"{root}/clock", "latest timestamp")

    def step(self, batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col(self.row_id).alias("row_id"), F.col(self.ts).cast("timestamp").alias("ts"), F.col(self.kind).alias("kind"), F.col(self.value).cast("double").alias("value")).where("row_id IS NOT NULL AND ts IS NOT NULL")
        rows = rows.dropDuplicates(["row_id"]).withColumn("day", F.to_date("ts"))
        known = self.seen.before(number).join(rows.select("row_id", "day"), ["row_id", "day"], "left_semi")
        rows = rows.join(known, ["row_id", "day"], "left_anti")
        clock = self.clock.of(number - 1)  # at most one row
        closed = F.to_date(F.col("latest") - F.expr(f"interval {self.delay}"))
        marked = rows.join(F.broadcast(clock), F.lit(True), "left").withColumn("late", F.coalesce(F.col("day") < closed, F.lit(False)))
        sums = marked.groupBy("late", "day", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        self.seen.write(rows, number)
        self.days.write(sums.where("NOT late"), number)
        self.corrections.write(sums.where("late"), number)
        latest = batch.agg(F.max(F.col(self.ts).cast("timestamp")).alias("latest")).unionByName(clock).agg(F.max("latest").alias("latest"))
        self.clock.write(latest.where("latest IS NOT NULL"), number)

    def totals(self) -> DataFrame:
        """(day, kind, n, total, n_late)."""
        on_time, late = self.days.all().withColumn("late", F.lit(0)), self.corrections.all().withColumn("late", F.lit(1))
        return on_time.unionByName(late).groupBy("day", "kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("n") * F.col("late")).alias("n_late"))

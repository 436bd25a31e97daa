"""Rows out of free text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rankings(docs: DataFrame) -> DataFrame:
    """(doc_id, name, team, pos, value) of each money line of (doc_id, text): team and position one or two lines above it, the name above them, at most three lines back; one row per name and value."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", F.trim("line"))
    order = Window.partitionBy("doc_id").orderBy("no")
    money, pair = r"^\$([0-9][0-9,]*(?:\.[0-9]+)?)$", r"^([A-Z]+), ([A-Z]+)$"
    back = [F.lag("line", k).over(order) for k in (1, 2, 3)]
    wide = lines.select("doc_id", "no", "line", *(b.alias(f"b{k + 1}") for k, b in enumerate(back))).where(F.col("line").rlike(money))
    hit = lambda k: F.col(f"b{k}").rlike(pair)
    at = F.when(hit(1), F.struct(F.col("b1").alias("pair"), F.col("b2").alias("name"))).when(hit(2), F.struct(F.col("b2").alias("pair"), F.col("b3").alias("name")))
    rows = wide.withColumn("at", at).where(F.col("at.name").isNotNull() & (F.col("at.name") != ""))
    value = F.regexp_replace(F.regexp_extract("line", money, 1), ",", "").cast("double")
    return rows.select("doc_id", F.col("at.name").alias("name"), F.regexp_extract("at.pair", pair, 1).alias("team"), F.regexp_extract("at.pair", pair, 2).alias("pos"), F.round(value, 2).alias("value")).dropDuplicates(["doc_id", "name", "value"])

"""Sinks: plain Parquet has no MERGE, UPDATE or DELETE, so each is the table that results, by joins."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def create_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def replace_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replace exactly the partitions that df holds: the idempotent form of delete-slice and insert."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def merge_upsert(target: DataFrame, source: DataFrame, keys: list[str], keep: Iterable[str] = ()) -> DataFrame:
    """Matched rows take the source's values (but for `keep`), unmatched source rows are inserted, the rest stays."""
    keep = set(keep)
    t, s = target.alias("t"), source.withColumn("__new", F.lit(True)).alias("s")
    cond = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = t.join(s, cond, "full_outer")

    def pick(c: str) -> Column:
        if c in keys or c in keep:
            return F.coalesce(F.col(f"t.{c}"), F.col(f"s.{c}")).alias(c)
        return F.when(F.col("s.__new"), F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c)

    return joined.select(*(pick(c) for c in target.columns))


def scd2(current: DataFrame, batch: DataFrame, key: str, at: Column, order: Column) -> DataFrame:
    """History after a batch: a current row whose key arrives is closed at `at`; the batch's last row of each key becomes current."""
    last = batch.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("__r = 1").drop("__r")
    arriving = last.select(F.col(key).alias("__k")).withColumn("__hit", F.lit(True))
    old = current.join(arriving, F.col(key) == F.col("__k"), "left")
    closing = F.col("is_current") & F.coalesce("__hit", F.lit(False))
    old = old.withColumn("effective_end_date", F.when(closing, at).otherwise(F.col("effective_end_date"))).withColumn("is_current", F.col("is_current") & ~closing).select(*current.columns)
    new = last.withColumn("effective_start_date", at).withColumn("effective_end_date", F.lit(None).cast(current.schema["effective_end_date"].dataType)).withColumn("is_current", F.lit(True))
    return old.unionByName(new.select(*current.columns))


def update_from(target: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Matched rows take the named columns of the source where it has a value."""
    s = source.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    out = target.join(s, keys, "left")
    return out.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in target.columns))


def update_where(target: DataFrame, condition: Column, **values: Column) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return target.select(*(F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in target.columns))


def delete_where(target: DataFrame, condition: Column) -> DataFrame:
    """What stays: rows for which the condition is false or null."""
    return target.where(~F.coalesce(condition, F.lit(False)))


def delete_in(target: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return target.join(keys, on, "left_anti")


def add_column(target: DataFrame, name: str, kind: str, backfill: Column) -> DataFrame:
    """Additive evolution: an existing column is only backfilled."""
    value = F.coalesce(F.col(name), backfill) if name in target.columns else backfill
    return target.withColumn(name, value.cast(kind))


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The source rows whose key the target lacks, one per key."""
    return source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinite numbers as 0, as JSON has neither."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.select(*(F.when(bad(c), F.lit(0.0)).otherwise(F.col(c)).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def audit_rows(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row with old and new value as JSON for each changed key."""
    old = before.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("old_value"))
    new = after.select(key, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("new_value"))
    return old.join(new, key).where(F.col("old_value") != F.col("new_value"))

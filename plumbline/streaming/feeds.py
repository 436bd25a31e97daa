"""Structured Streaming counterparts of the feed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import scratch


def source(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet folder or file as a stream; times without a zone are taken as UTC."""
    folder, _, name = path.rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    # a file stream watches a folder: the table's own one, or the single file by a glob
    df = stream.parquet(f"{folder}/{name[:-1]}?")
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(stream: DataFrame, key: str, ts: str, within: str) -> DataFrame:
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key]).select(key, ts)


def daily(stream: DataFrame) -> DataFrame:
    g = stream.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str) -> DataFrame:
    return stream.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def drained(stream: DataFrame, mode: str, schema: str) -> DataFrame:
    """Process all that is there and return the sink's rows. Each micro-batch is written under its number, so a batch that runs again replaces itself."""
    spark, root = stream.sparkSession, scratch(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/{'all' if mode == 'complete' else f'batch={number}'}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True)
    writer.start().awaitTermination()
    path = f"{root}/out/all" if mode == "complete" else f"{root}/out"
    return spark.read.schema(schema).parquet(path)

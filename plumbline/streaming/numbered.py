"""Tables that streams write batch by batch, and streams that are run again as rows arrive."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


class Numbered:
    """A table with one folder per batch. Writing a batch again replaces it, so a repeated batch changes nothing."""

    def __init__(self, spark: SparkSession, path: str, schema: str | T.StructType):
        self.spark, self.path = spark, path
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        spark.createDataFrame([], self.schema).write.mode("ignore").parquet(f"{path}/batch=-1")  # there is a table before the first batch

    def write(self, df: DataFrame, number: int) -> None:
        df.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def of(self, number: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/batch={number}")

    def all(self) -> DataFrame:
        """All batches, with their number in `batch`."""
        return self.spark.read.schema(T.StructType([*self.schema.fields, T.StructField("batch", T.LongType())])).parquet(self.path)

    def before(self, number: int) -> DataFrame:
        """What earlier batches wrote: neither a first attempt at this batch nor a later one is seen."""
        return self.all().where(f"batch < {number}").drop("batch")


def folder_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Parquet files anywhere below a folder as a stream."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def run_once(stream: DataFrame, step: Callable[[DataFrame, int], None], state: str, mode: str = "append") -> None:
    """One trigger: everything that has arrived since the last one goes to step(batch, number), under the checkpoint in `state`."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", state).foreachBatch(step).trigger(availableNow=True).start().awaitTermination()


def in_arrivals(parts: Iterable[DataFrame], root: str, run: Callable[[DataFrame], None]) -> None:
    """Write one part after another below root and run(stream) after each: as many triggers as parts."""
    for k, part in enumerate(parts):
        part.write.parquet(f"{root}/arrival-{k}")
        run(folder_stream(part.sparkSession, root, part.schema))


def uncommit(spark: SparkSession, state: str, number: int) -> None:
    """Take back the commit of a batch, as a driver does that is lost after the batch's writes: the next trigger repeats it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/{number}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for p in (path, spark._jvm.org.apache.hadoop.fs.Path(f"{state}/commits/.{number}.crc")):
        fs.delete(p, False)

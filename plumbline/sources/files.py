"""File sources. Paths are resolved by Spark's file systems, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def csv_glob(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """All CSV files of a glob with a header; rows that do not fit the schema are dropped."""
    return spark.read.option("header", True).option("mode", "DROPMALFORMED").schema(schema).csv(pattern)


def csv_recursive(spark: SparkSession, root: str, name_glob: str, schema: str) -> DataFrame:
    """CSV files of any depth whose names match, without repeated rows."""
    return spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name_glob).schema(schema).csv(root).distinct()


def year_of_path(path: Column) -> Column:
    """The first `_YYYY` of a file's name, null without one."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.nullif(F.regexp_extract(name, r"_(\d{4})(?:[_.]|$)", 1), F.lit("")).cast("int")


def latest_files(files: DataFrame, key: Column) -> DataFrame:
    """Rows of the newest file of each key; files carry `_metadata`."""
    meta = files.select(key.alias("key"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("at"))
    newest = meta.groupBy("key").agg(F.max_by("path", F.struct("at", "path")).alias("path"))
    return files.withColumn("__path", F.col("_metadata.file_path")).join(F.broadcast(newest.select(F.col("path").alias("__path"))), "__path", "left_semi").drop("__path")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def first_existing(spark: SparkSession, paths: list[str]) -> str | None:
    """The first of the paths that exists."""
    return next((p for p in paths if exists(spark, p)), None)


def json_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of records."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def yaml_rows(text: str) -> list[dict[str, str]]:
    """The rows of a flat YAML list of mappings (`- key: value`, following keys indented): the shape of lookup files."""
    rows: list[dict[str, str]] = []
    for line in text.splitlines():
        bare = line.split(" #")[0].rstrip()
        if not bare.strip() or bare.lstrip().startswith("#"):
            continue
        item = bare.strip()
        if item.startswith("- "):
            rows.append({})
            item = item[2:]
        key, _, value = item.partition(":")
        if rows:
            rows[-1][key.strip()] = value.strip().strip("'\"")
    return rows


def rest_records(responses: DataFrame, body: str, records: str, schema: str, ingested_at: Column) -> DataFrame:
    """Records of a service's responses (one JSON object a row, its list of records under the key `records`), stamped with their time of arrival. A response that is no JSON, or has no such list, gives no rows."""
    parsed = F.from_json(F.col(body), f"{records} array<struct<{schema}>>")[records]
    return responses.select(F.explode(parsed).alias("r")).select("r.*").withColumn("_ingested_at", ingested_at)


def longest_body(summary: Column, content: Column) -> Column:
    """Of a feed entry's summary and content the longer one; the content on a tie."""
    a, b = F.coalesce(summary, F.lit("")), F.coalesce(content, F.lit(""))
    return F.when(F.length(a) > F.length(b), a).otherwise(b)
